"""The Jaccard join against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import components, exchange, jaccard

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if x]
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    lists, parent = defaultdict(list), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        common = Counter(j for x in s for j in lists[x])
        for j, o in common.items():
            if 100 * o >= 85 * (len(s) + len(sets[j]) - o):
                parent[find(k)] = find(j)
        for x in s:
            lists[x].append(k)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[find(k)].append(i)
    return sorted((rows[k][0], len(sets[k]), min(groups[find(k)])) for k in range(len(rows)))


def corpus():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        base = [rnd.choice(words) for _ in range(rnd.randint(4, 60))]
        for _ in range(rnd.randint(1, 7)):
            x = list(base)
            for _ in range(rnd.randint(0, 2)):
                at = rnd.randrange(len(x))
                x = [*x[:at], rnd.choice(words), *x[at + 1 :]] if rnd.random() < 0.5 else x[:-1] or x
            texts.append(" ".join(x))
    hub = "the common passage of many words that is repeated in each of the documents here again and again".split()
    texts += [" ".join(hub + [rnd.choice(words) for _ in range(rnd.randint(0, 4))]) for _ in range(60)]
    long = [rnd.choice(words) for _ in range(4000)]
    texts += [" ".join(long), " ".join(long[:3990]), " ".join(long[2000:])]
    return [*enumerate(texts), (9000, None), (9001, ""), (9002, " \n"), (9003, "a b"), (9004, "A  b"), (9005, "a b c"), (3, texts[3])]


@pytest.mark.parametrize("cell,part", [(2048, 1_000_000), (8, 500)])
def test_against_brute_force(spark, monkeypatch, cell, part):
    monkeypatch.setattr(jaccard, "CELL_SETS", cell)
    monkeypatch.setattr(exchange, "PART_POSTINGS", part)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, component_id int").repartition(3)
    assert sorted(map(tuple, jaccard.jaccard_components(df).collect())) == brute(rows)


def test_light_sets_alone(spark):
    base = [f"w{i}" for i in range(14)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1])), (3, " ".join([*base[:-1], "x"])), (4, " ".join(base[2:])), (5, " ".join([*base, "y", "z"])), (6, "other words that nobody else has in the table")]
    assert sorted(map(tuple, jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_empty_table_and_null_id(spark):
    schema = "doc_id long, text string"
    assert jaccard.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "q")], schema)).collect()}
    assert got == {(None, 4), (4, 4), (None, None)}


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_sizes_and_overlaps():
    for m in range(1, 60):
        for n in range(m, 60):
            o = jaccard.overlap_needed(m, n)
            assert 100 * o >= 85 * (m + n - o) and not 100 * (o - 1) >= 85 * (m + n - o + 1)


def test_very_long_texts(spark):
    rnd = random.Random(8)
    long = [f"w{rnd.randrange(5000)}" for _ in range(60_000)]
    near = [w if k % 400 else "other" for k, w in enumerate(long)]
    rows = [(5, " ".join(long)), (3, " ".join(near)), (9, " ".join(long[:30_000])), (7, "w1 w2 w3 w4")]
    got = sorted(tuple(r)[:3] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows) and dict((i, c) for i, _, c in got)[5] == 3


def test_shingles_of_many_texts_hold_little():
    import tracemalloc

    from riskloom.llm import common

    texts = pa.array(["some words of a text " * 100] * 2000)
    common._POWERS.update(up=np.ones(1, np.uint64), down=np.ones(1, np.uint64))
    tracemalloc.start()
    try:
        for _, _, data, offsets in common.steps(texts):
            for _ in jaccard.shingle_sets(data, offsets):
                pass
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()


def test_tasks_of_another_job_let_go_of_what_a_worker_keeps():
    from riskloom.llm import bpe, common

    bpe._CODECS["job"] = object()
    list(common.trimmed(iter, keeps=True)([1]))
    assert "job" in bpe._CODECS
    list(common.trimmed(iter)([1]))
    assert not bpe._CODECS
