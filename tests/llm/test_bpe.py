"""Byte-level BPE against the tiktoken library, and the stitching of chunks."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from riskloom.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def digests(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def odd_texts(rnd, n):
    pieces = ["a", "'", "re", " ", "  ", "\n", "x1", "é", "..", "'s", "word ", " 12", "日本", "😀", "\t\u00a0"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 120))) for _ in range(n)]
    return [*texts, "", " ", "q" * 500, "don't " * 60, "<|endoftext|>", "same", "same", "x" * 70 + " " * 70 + "y" * 70, "\n" + " " * 300 + "\n" + " " * 90 + "a", "a" + " \n" * 100]


@pytest.mark.parametrize("chunk,overlap,deal,deal_overlap", [(1024, 64, 65_536, 512), (40, 8, 100, 16), (16, 4, 40, 8), (24, 6, 10**6, 8)])
def test_texts_of_every_kind(spark, chunk, overlap, deal, deal_overlap):
    texts = [*odd_texts(random.Random(3), 60), None]
    rows = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(rows, RANKS, public_tokenizers.PATTERN, chunk, overlap, deal, deal_overlap).collect()}
    assert got == {i: digests(t) for i, t in enumerate(texts)}


def test_chunks_give_the_pretokens_of_the_whole():
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for text in odd_texts(random.Random(9), 400):
        for chunk, overlap in ((16, 4), (20, 10), (33, 7)):
            assert codec.pretokens(text, chunk, overlap) == codec.split.findall(text), (text, chunk)


def test_unbroken_runs_cost_what_they_are_long():
    codec, seen = bpe.Codec(RANKS, public_tokenizers.PATTERN), []
    whole = codec.split
    codec.split = type("Counted", (), {"findall": lambda self, t: seen.append(len(t)) or whole.findall(t)})()
    for n in (50_000, 400_000):
        seen.clear()
        text = "a" * n + " end"
        assert codec.pretokens(text, 1536, 48) == whole.findall(text) and sum(seen) < 6 * n


def test_empty_table(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(rows, RANKS, public_tokenizers.PATTERN).count() == 0


def test_every_character_is_split_as_the_library_does():
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for code in range(0x3000):
        text = f"a{chr(code)}b 1{chr(code)} {chr(code)}{chr(code)}  {chr(code)}x"
        assert np.frombuffer(codec.encode(text), np.int32).tolist() == LIBRARY.encode_ordinary(text), hex(code)


def test_both_merges_agree():
    rnd = random.Random(1)
    for _ in range(300):
        piece = bytes(rnd.randint(97, 105) for _ in range(rnd.randint(2, 150)))
        assert bpe._merge_short(piece, RANKS) == bpe._merge_long(piece, RANKS) == LIBRARY.encode_ordinary(piece.decode())
