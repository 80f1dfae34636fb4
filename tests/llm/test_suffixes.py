"""Suffix arrays against sorted suffixes; removal against all windows in a dictionary."""

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import suffixes


def plain(rows, width):
    """doc_id, n_bytes, spans, kept of rows (doc_id, text)."""
    least = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - width + 1):
            if doc is not None:
                least[data[i : i + width]] = min(doc, least.get(data[i : i + width], doc))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - width + 1):
            if doc is not None and least[data[i : i + width]] < doc:
                gone[i : i + width] = [True] * width
        spans, at = [], 0
        for flag, run in itertools.groupby(gone):
            n = len(list(run))
            if flag:
                spans.append((at, at + n))
            at += n
        out.append((doc, len(data), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in df.collect()), key=repr)


def test_suffix_array_sorts_suffixes():
    rnd = random.Random(3)
    for n in [*range(60), 200, 500]:
        for letters in (1, 2, 3, 200):
            s = np.array([rnd.randint(1, letters) for _ in range(n)], np.int64)
            assert suffixes.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist()), s
    s = np.array([1, 2, 3, 5] * 300, np.int64)
    assert suffixes.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def texts_of(rnd, n):
    shared = ["".join(rnd.choice("abé ") for _ in range(rnd.randint(5, 60))) for _ in range(6)]
    def one():
        return "".join(rnd.choice(shared) if rnd.random() < 0.4 else "".join(rnd.choice("abcdé \n日") for _ in range(rnd.randint(0, 25))) for _ in range(rnd.randint(0, 8)))
    return [one() for _ in range(n)]


@pytest.mark.parametrize("width,gram,hot,deal", [(12, 5, 20_000, 8 << 20), (12, 5, 1, 300), (7, 7, 3, 64), (50, 24, 20_000, 500)])
def test_removed_bytes(spark, monkeypatch, width, gram, hot, deal):
    rnd = random.Random(width + hot)
    monkeypatch.setattr(suffixes, "BATCH", deal)
    monkeypatch.setattr(suffixes, "PART_TEXT", 3000)
    texts = texts_of(rnd, 120)
    rows = list(enumerate(texts)) + [(500, texts[3]), (501, texts[3]), (7, texts[9]), (7, texts[9]), (None, texts[3]), (600, None), (601, ""), (602, "x" * 400), (603, "x" * 900), (-5, texts[20])]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(d, t, 1, b"k") for d, t in rows], "doc_id long, text string, n_bytes int, kept binary").repartition(3)
    assert got(suffixes.remove_repeats(df, width, gram, hot)) == plain(rows, width)


def test_very_long_texts_and_empty_table(spark):
    rnd = random.Random(9)
    long = "".join(rnd.choice("abcdefghij klm\n") for _ in range(300_000))
    rows = [(2, long + "tail"), (1, "head" + long[100_000:200_000]), (3, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffixes.remove_repeats(df).collect()}
    assert spans == {1: [], 2: [(100_000, 200_000)], 3: []}
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_suffix_array_of_wanted_places():
    rnd = random.Random(5)
    for n in [*range(40), 200, 500]:
        for letters in (1, 2, 3, 200):
            s = np.array([rnd.randint(1, letters) for _ in range(n)], np.int64)
            for share in (0, 0.3, 1):
                wanted = np.array([rnd.random() < share for _ in range(n)], bool)
                assert suffixes.suffix_array(s, wanted).tolist() == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: s[i:].tolist()), (s, wanted)


def test_runs_hold_each_window_once_with_the_key_of_its_bytes(monkeypatch):
    monkeypatch.setattr(suffixes, "STEP", 100)
    rnd = random.Random(8)
    texts = [t.encode() for t in [*texts_of(rnd, 60), "", "x" * 900, "", *texts_of(rnd, 3), "x" * 12, "y" * 11]]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    ids = pa.array([None if i % 9 == 4 else i for i in range(len(texts))], pa.int64())
    runs = suffixes.Runs(data, offsets, ids, 12, 5, (1 << 40) - 1)
    got, keys = [], {}
    for start, n, row, key in zip(runs.starts.tolist(), runs.windows.tolist(), runs.rows.tolist(), runs.keys.tolist(), strict=True):
        for at in range(start, start + n):
            got.append((row, at - int(offsets[row])))
            assert keys.setdefault(data[at : at + 12].tobytes(), key) == key
    assert runs.windows.max() <= suffixes.RUN
    assert got == [(row, at) for row, text in enumerate(texts) if row % 9 != 4 for at in range(len(text) - 11)]


def test_runs_keep_no_key_for_each_byte():
    """The keys of a batch were held whole, with flags and sums of eight bytes a byte of text beside them."""
    data = np.random.default_rng(2).integers(97, 123, 4 << 20, dtype=np.uint8)
    offsets = np.arange(0, len(data) + 1, 4096)
    suffixes.Runs(data[:4096], offsets[:2], pa.array([0]), 50, 16, (1 << 40) - 1)
    tracemalloc.start()
    suffixes.Runs(data, offsets, pa.array(np.arange(len(offsets) - 1)), 50, 16, (1 << 40) - 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(data), peak / len(data)


def test_spans_end_with_their_documents(spark):
    """Whole documents that go side by side in one batch, and pieces that touch or leave one byte between them."""
    rnd = random.Random(12)
    a, b = ("".join(rnd.choice("abcdefgh") for _ in range(60)) for _ in range(2))
    rows = [(1, a), (2, b), (3, a), (4, b), (5, a + b), (6, a + "-" + b), (7, ""), (8, b + a), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = got(suffixes.remove_repeats(df))
    assert found == plain(rows, suffixes.WIDTH)
    assert [spans for _, _, spans, _ in found] == [[], [], [(0, 60)], [(0, 60)], [(0, 120)], [(0, 60), (61, 121)], [], [(0, 120)], []]
