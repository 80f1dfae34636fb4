"""Vector searches against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import ann, blocks, mips


def vectors(n=700, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 16))
    rows = centres[rng.integers(0, 12, n)] + 0.4 * rng.standard_normal((n, 16))
    rows[100:160] = rows[100]  # copies
    out = [(int(i), [float(x) for x in r], 1) for i, r in enumerate(rows.astype(np.float32))]
    out += [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [float("inf")] + [1.0] * 15, 1), (9005, [None] + [1.0] * 15, 1), (9006, [], 1), (20, [float(x) for x in rows[20].astype(np.float32)], 1)]
    return out


SCHEMA = "vec_id long, embedding array<float>, score int"


def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v)


def test_inner_products(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST_ROWS", 128)
    rows = vectors()
    got = sorted(tuple(r) for r in mips.top_inner_products(spark.createDataFrame(rows, SCHEMA)).select("query_id", "rank", "vec_id", "score").collect())
    whole = {i: [math.floor(64 * x) for x in v] for i, v, _ in rows if usable(v)}
    want = []
    for q in whole:
        if q % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:20]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(found, 1)]
    assert got == sorted(want)


def brute_products(rows, k=20, every=20):
    best = {}
    for q in rows:
        if q[0] % every == 0:
            mine = {}
            for i, v in rows:
                if i != q[0]:
                    s = sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(q[1], v, strict=True))
                    mine[i] = max(s, mine.get(i, s))
            for i, s in mine.items():
                best[q[0], i] = max(s, best.get((q[0], i), s))
    out = []
    for q in sorted({q for q, _ in best}):
        found = sorted((-s, i) for (a, i), s in best.items() if a == q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return out


def test_inner_products_of_huge_components_and_few_rows(spark):
    rows = [(0, [2e7, -2e7], 1), (20, [2e7, 1e7], 1), (3, [-2e7, 5.0], 1), (4, [1e18, 0.0], 1), (5, [2.0**56, 1.0], 1), (40, [1.0], 1), (60, [1e-3, 3e-3], 1)]
    schema = "vec_id long, embedding array<double>, x int"
    with pytest.raises(Exception, match="vec_id 0 and vec_id 4 is beyond a long"):
        mips.top_inner_products(spark.createDataFrame(rows, schema).filter("vec_id in (0, 3, 4)")).collect()
    rows = [r for r in rows if r[0] not in (4, 5, 40)]
    got = sorted(map(tuple, mips.top_inner_products(spark.createDataFrame(rows, schema)).collect()))
    assert got == brute_products([r[:2] for r in rows])
    few = [(60, [1e-3, -3e-3], 1), (5, [2.0**56, 1.0], 1), (7, [-(2.0**56), 0.5], 1), (80, [0.0, 0.25], 1)]
    got = sorted(map(tuple, mips.top_inner_products(spark.createDataFrame(few, schema)).collect()))
    assert got == brute_products([r[:2] for r in few])


def test_one_cell_with_repeated_ids_copies_and_large_rows():
    rng = np.random.default_rng(8)
    rows = np.round(rng.standard_normal((3000, 12)) * 40)
    rows[200:900] = rows[200]  # copies
    rows[7] *= 2.0**33  # beyond doubles, within a long
    rows[8] *= 2.0**40
    ids = np.arange(3000)
    ids[2500:] = ids[:500]  # several vectors an id
    asked = np.arange(0, 400, 20)
    got = mips.search_cell(asked, rows[asked], ids, rows)
    whole = [[int(x) for x in r] for r in rows]
    found = {}
    for q, i, s in zip(*map(list, got), strict=True):
        found.setdefault(int(q), []).append((int(i), int(s)))
    for q in asked:
        best = {}
        for i, r in zip(ids.tolist(), whole, strict=True):
            if i != q:
                s = sum(a * b for a, b in zip(whole[q], r, strict=True))
                best[i] = max(s, best.get(i, s))
        assert sorted(found[q], key=lambda x: (-x[1], x[0])) == sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20]


def test_nearest_copies_go_to_the_smaller_ids():
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((20_000, 16))
    rows[rng.permutation(20_000)[:8000]] = rows[0]
    ids = rng.permutation(20_000)
    distance = np.sqrt(((rows - rows[0]) ** 2).sum(1))
    own = int(ids[0])
    got = ann.search_cell(np.array([own]), rows[:1], ids, rows)
    want = sorted((d, i) for d, i in zip(distance.tolist(), ids.tolist(), strict=True) if i != own)[:10]
    assert [(d, i) for d, i in zip(got[2].tolist(), got[1].tolist(), strict=True)] == want


def test_nearest_in_one_cell_finds_most(monkeypatch):
    rng = np.random.default_rng(5)
    rows = rng.standard_normal((6000, 24)) + 3 * rng.standard_normal((20, 24))[rng.integers(0, 20, 6000)]
    asked = np.arange(0, 6000, 100)
    got = ann.search_cell(asked, rows[asked], np.arange(6000), rows)
    hits = 0
    for q in asked:
        d = np.sqrt(((rows - rows[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & set(got[1][got[0] == q].tolist()))
    assert hits >= 0.9 * 10 * len(asked)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mips.top_inner_products(empty).count() == 0 and ann.nearest(empty).count() == 0


def test_nearest_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST_ROWS", 128)
    rows = vectors(1500)
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), every=20).collect()
    good = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if usable(v) and any(v)}
    found = {}
    for r in got:
        assert r.score == float(np.sqrt(((good[r.vec_id] - good[r.query_id]) ** 2).sum()))
        found.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    hits = total = 0
    for q in (i for i in good if i % 20 == 0):
        best = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q)[:10]
        mine = sorted(found[q])
        assert [x[0] for x in mine] == list(range(1, 11)) and [x[1:] for x in mine] == sorted(x[1:] for x in mine)
        hits += len({i for _, i in best} & {x[2] for x in mine})
        total += 10
    assert hits >= 0.9 * total


def test_recall_on_the_given_embeddings(spark, data_dir):
    rows = spark.read.parquet(f"{data_dir}/embeddings.parquet")
    pdf = rows.toPandas()
    matrix, ids = np.stack(pdf["embedding"]).astype(float), pdf["vec_id"].to_numpy()
    got = ann.nearest(rows).groupBy("query_id").agg(F.collect_set("vec_id").alias("v")).collect()
    hits = 0
    for r in got:
        d = ((matrix - matrix[ids == r.query_id][0]) ** 2).sum(1)
        d[ids == r.query_id] = np.inf
        hits += len(set(ids[np.argsort(d)[:10]].tolist()) & set(r.v))
    assert hits >= 0.9 * 10 * len(got)


def test_chi_square():
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 1e-3
