"""Token counts by a linear longest-match automaton.

The vocabulary is a byte trie. Every node has a failure link: where the walk goes on after the longest pieces at the
front of what it has read are popped, and how many pieces that pops. With the links resolved for every byte, a word is
one step a byte and a sum of popped counts, and no piece is built. Distinct words of a batch go through the automaton
side by side, longest last.

Words are [^\\x20\\x09-\\x0D]+; each starts with the vocabulary's mark for a word start. Every single byte is a piece of
its own where no longer piece fits, so each word has a count.

Defined cases: a null, empty or blank text has no words and 0 tokens; repeated rows are counted each; ties can't arise, since at
one place only one piece is longest; a very long text is counted whole, a run of texts of its own; an empty table gives no rows; other columns are ignored by the query and kept by `count_tokens`, but for n_words and n_tokens, which
are replaced; a vocabulary with an empty piece is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import split_words, steps, word_bytes_key

MARK = "▁"


def read_pieces(path: str) -> list[bytes]:
    """The pieces of a sentencepiece model as bytes; byte pieces as that byte, control pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        elif not (model.is_control(i) or model.is_unknown(i)):
            out.append(piece.encode())
    return out


class LongestMatch:
    """The automaton: for each node and byte, the next node and the pieces popped on the way."""

    def __init__(self, pieces: Iterable[bytes], mark: bytes = MARK.encode()):
        trie: list[dict[int, int]] = [{}]
        depth, ends = [0], [False]

        def add(piece: bytes) -> None:
            at = 0
            for byte in piece:
                if byte not in trie[at]:
                    trie[at][byte] = len(trie)
                    trie.append({})
                    depth.append(depth[at] + 1)
                    ends.append(False)
                at = trie[at][byte]
            ends[at] = True

        for piece in [*(bytes([b]) for b in range(256)), *pieces]:
            if not piece:
                raise ValueError("an empty piece")
            add(piece)
        n = len(trie)
        step = np.zeros((n, 256), np.int32)
        popped = np.zeros((n, 256), np.uint8)
        fail, fail_popped = np.zeros(n, np.int32), np.zeros(n, np.int64)
        step[0, list(trie[0])] = list(trie[0].values())
        level = [(0, b, v) for b, v in trie[0].items()]
        while level:
            later = []
            for parent, byte, v in level:
                if ends[v]:  # all that was read is one piece
                    fail[v], fail_popped[v] = 0, 1
                else:  # pop what the parent's link pops, and go on with this byte from there
                    fail[v] = step[fail[parent], byte]
                    fail_popped[v] = fail_popped[parent] + popped[fail[parent], byte]
                later += [(v, b, w) for b, w in trie[v].items()]
            for _, _, v in level:
                row = popped[fail[v]].astype(np.int64) + fail_popped[v]
                if row.max() > 255:
                    raise ValueError("a piece that pops over 255 pieces")
                step[v], popped[v] = step[fail[v]], row
                if trie[v]:
                    own = list(trie[v])
                    step[v, own], popped[v, own] = list(trie[v].values()), 0
            level = later
        self.step, self.popped = step.ravel(), popped.ravel()
        #: Pieces that are still to pop when a word ends at a node.
        self.end = np.zeros(n, np.int64)
        for v in sorted(range(1, n), key=depth.__getitem__):
            self.end[v] = fail_popped[v] + self.end[fail[v]]
        at = 0
        self.start_popped = 0
        for byte in mark:
            self.start_popped += int(self.popped[at * 256 + byte])
            at = int(self.step[at * 256 + byte])
        self.start = at

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of pieces of each word data[start:end] behind the mark."""
        length = ends - starts
        order = np.argsort(-length, kind="stable")
        starts, length = starts[order], length[order]
        state = np.full(len(starts), self.start, np.int64)
        total = np.full(len(starts), self.start_popped, np.int64)
        going = len(starts)
        for i in range(int(length[0]) if len(length) else 0):
            while going and length[going - 1] <= i:
                going = int(np.searchsorted(-length, -i, "left"))
            key = state[:going] * 256 + data[starts[:going] + i]
            total[:going] += self.popped[key]
            state[:going] = self.step[key]
        total += self.end[state]
        out = np.empty_like(total)
        out[order] = total
        return out


_BUILT: dict[str, LongestMatch] = {}


def count_tokens(docs: DataFrame, pieces: list[bytes]) -> DataFrame:
    """All columns of `docs` (with a column text), and n_words and n_tokens."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pieces)  # a vocabulary file: its size doesn't follow the data
    name = uuid.uuid4().hex
    kept = docs.drop("n_words", "n_tokens")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = LongestMatch(shared.value)
        automaton = _BUILT[name]
        for batch in batches:
            words, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in steps(batch["text"]):
                starts, ends, cut = split_words(data, offsets)
                _, first, inverse = np.unique(word_bytes_key(data, starts, ends), return_index=True, return_inverse=True)
                of_word = automaton.count(data, starts[first], ends[first])[inverse]
                sums = np.concatenate([[0], np.cumsum(of_word)])
                words.append(np.diff(cut))
                tokens.append(sums[cut[1:]] - sums[cut[:-1]])
            arrays = [*batch.columns, pa.array(np.concatenate(words), pa.int64()), pa.array(np.concatenate(tokens), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "n_words", "n_tokens"])

    schema = kept.withColumns({"n_words": F.lit(None).cast("long"), "n_tokens": F.lit(None).cast("long")}).schema
    return kept.mapInArrow(count, schema)
