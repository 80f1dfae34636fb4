"""Fill-in-the-middle against plain slices of lists of lines."""

import hashlib
import random
import re

import numpy as np
import pytest

from riskloom.llm import infill


def plain(doc_id, text, rate=100):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def odd_texts(rnd, n):
    pieces = ["a", "\n", "é", "\r\n", "日本", "😀", " ", "<", "<P", ">", "word", "\n\n", " ", "S>"]
    return ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 90))) for _ in range(n)]


@pytest.mark.parametrize("block,rate", [(1024, 100), (1, 100), (7, 60), (64, 100)])
def test_rows_of_every_kind(spark, block, rate):
    texts = [*odd_texts(random.Random(4), 150), None, "", "\n", "no end", "has <M> inside\nmore\n", "x" * 5000, "é\n" * 40_000, "same\ntext\n", "same\ntext\n"]
    rows = [*((i, t, "kept") for i, t in enumerate(texts)), (None, "a\nb\nc\n", "kept"), (3, texts[3], "kept")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string")
    found = infill.rearrange(df, rate=rate, block=block)
    got = sorted((tuple(r) for r in found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", infill.restored(found["output"], found["form"])).collect()), key=repr)
    assert got == sorted(((i, *plain(i, t, rate)) for i, t, _ in rows), key=repr)


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, 2, "a\n", 3)], "n int, doc_id long, text string, extra int")
    assert infill.rearrange(df).columns == ["doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert infill.rearrange(df.limit(0)).count() == 0


def test_fenwick_descends_as_running_sums_do():
    rnd = random.Random(8)
    for _ in range(200):
        counts = [rnd.choice([0, 0, 1, 2, 5]) for _ in range(rnd.randint(1, 40))]
        tree, sums = infill.Fenwick(counts), np.cumsum([0, *counts])
        assert [tree.before(i) for i in range(len(counts) + 1)] == sums.tolist()
        for wanted in range(1, int(sums[-1]) + 1):
            block = int(np.searchsorted(sums[1:], wanted))
            assert tree.descend(wanted) == (block, sums[block])
