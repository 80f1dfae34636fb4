"""Scans over ranges against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import evaluation, scans


@pytest.mark.parametrize("size", [5, 37, 10_000])
def test_values_of_the_row_before(spark, monkeypatch, size):
    monkeypatch.setattr(scans, "RANGE_ROWS", size)
    rnd = random.Random(size)
    rows = [(rnd.choice(["a", "b", None, "c"]) if i % 3 else "hot", i, rnd.choice([None, 1, 2])) for i in range(200)]
    want, last = {}, {}
    for k, i, v in rows:
        want[i] = last.get(k)
        last[k] = v
    shuffled = rnd.sample(rows, len(rows))
    got = scans.lagged(spark.createDataFrame(shuffled, "k string, i int, v int"), ["k"], ["i"], F.col("v"), "before").collect()
    assert {r.i: r.before for r in got} == want and len(got) == 200


def plain_best(steps, margin):
    best, at, misses = float("inf"), None, 0
    for place, loss in steps:
        if misses >= 5:
            break
        if loss is not None and loss < best - margin:
            best, at, misses = loss, place, 0
        else:
            misses += 1
    return at, best, misses < 5


@pytest.mark.parametrize("size", [1, 3, 7, 50, 10_000])
def test_best_steps(spark, monkeypatch, size):
    monkeypatch.setattr(scans, "RANGE_ROWS", size)
    rnd = random.Random(size)
    runs = {r: [(i, None if rnd.random() < 0.05 else round(rnd.uniform(0, 2) + 3 * 0.9**i, 2)) for i in range(rnd.choice([1, 2, 5, 9, 20, 40]))] for r in range(12 if size < 7 else 40)}
    runs[99] = [(i, 50.0 - i) for i in range(60)]
    rows = [(r, i, x) for r, steps in runs.items() for i, x in steps]
    rnd.shuffle(rows)
    got = scans.best_steps(spark.createDataFrame(rows, "r int, i long, x double"), "r", "i", "x", 0.05).collect()
    assert {r.run: (r.best_place, r.best, r.ran_out) for r in got} == {r: plain_best(steps, 0.05) for r, steps in runs.items()}


@pytest.mark.parametrize("ranges", [1, 7, 1000])
def test_thresholds_by_ranges(spark, monkeypatch, ranges):
    monkeypatch.setattr(evaluation, "RANGES", ranges)
    rnd = random.Random(ranges)
    rows = [(round(rnd.uniform(-0.1, 1.1), 2), rnd.random() < 0.4) for _ in range(300)]
    clamped = [(min(1.0, max(0.0, c)), y) for c, y in rows]
    pos, neg = sum(y for _, y in clamped), sum(not y for _, y in clamped)
    options = []
    for t in {0.0, 1.0, *(c for c, _ in clamped)}:
        recall, reject = sum(y and c >= t for c, y in clamped) / pos, sum(not y and c < t for c, y in clamped) / neg
        options.append((min(recall, reject), reject, recall, t))
    got = evaluation.select_threshold(spark.createDataFrame(rows, "cosine double, relevant boolean")).first()
    assert tuple(got) == pytest.approx(max(options))
