"""Ordered scans whose groups may be of any size: ranges of rows in order, with what each range hands on to the next."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.sources.shared import written

#: Rows of a range.
RANGE_ROWS = 250_000
#: Misses after which a run of losses is over.
PATIENCE = 5


def ranged(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """`rows` with _range, the number of the range of the order (by, order) that a row is in. Written once, so that the ranges stay as
    they are. Rows that are equal in all of these are in one range."""
    parts = max(1, math.ceil(rows.count() / RANGE_ROWS))
    return written(rows.repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def lagged(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """`rows` with the value of the row before, within `by` in `order`; null for the first. Windows hold a range's rows of a key at most;
    the last value of each range is carried into the next one that has the key."""
    rows = ranged(rows.withColumn("_value", F.struct(value.alias("v"))), by, order)
    inside = F.lag("_value").over(Window.partitionBy(*by, "_range").orderBy(*order))
    ends = rows.groupBy(*by, "_range").agg(F.max_by("_value", F.struct(*order)).alias("_last"))
    carried = F.lag("_last").over(Window.partitionBy(*by).orderBy("_range"))  # a row a range
    ends = ends.withColumn("_carried", carried).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_range").alias("_at"), "_carried")
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = rows.withColumn("_before", inside).join(ends, same)
    return joined.withColumn(name, F.coalesce("_before", "_carried")["v"]).select(*(c for c in rows.columns if c not in ("_value", "_range")), name)


def _summary(places: list, losses: list, margin: float) -> tuple:
    """What a range of steps does to whatever came before: its first PATIENCE steps, and where each of them would lead if it were
    the best so far (best, place, misses). Only the next PATIENCE steps matter after any step, so this is one pass from the end."""
    n = len(places)
    ends: list[tuple] = [()] * n
    for i in range(n - 1, -1, -1):
        j = next((j for j in range(i + 1, min(n, i + 1 + PATIENCE)) if losses[i] is not None and losses[j] is not None and losses[j] < losses[i] - margin), None)
        ends[i] = ends[j] if j is not None else (losses[i], places[i], min(PATIENCE, n - 1 - i))
    first = min(n, PATIENCE)
    return n, places[:first], losses[:first], [e[0] for e in ends[:first]], [e[1] for e in ends[:first]], [e[2] for e in ends[:first]]


def best_steps(rows: DataFrame, run: str, place: str, loss: str, margin: float) -> DataFrame:
    """(run, best_place, best, ran_out) of every run: the step of the last loss that was below the best before it by the margin;
    after `PATIENCE` steps without one a run is over, and what comes later doesn't count.

    Ranges of steps are folded to summaries of a few numbers, and a run's summaries are put together in order.
    """
    parted = ranged(rows.select(F.col(run).alias("run"), F.col(place).cast("long").alias("place"), F.col(loss).cast("double").alias("loss")), ["run"], ["place", "loss"])
    kind = parted.schema["run"].dataType.simpleString()
    run_type = parted.limit(0).select("run").toArrow().schema.field("run").type
    lists = [("places", pa.list_(pa.int64())), ("losses", pa.list_(pa.float64())), ("bests", pa.list_(pa.float64())), ("best_places", pa.list_(pa.int64())), ("misses", pa.list_(pa.int64()))]

    def fold(steps: pa.Table) -> pa.Table:
        steps = steps.sort_by([("place", "ascending"), ("loss", "ascending")])
        n, *parts = _summary(steps["place"].to_pylist(), steps["loss"].to_pylist(), margin)
        return pa.table([steps["run"].slice(0, 1), steps["_range"].slice(0, 1), pa.array([n], pa.int64()), *(pa.array([p], t) for p, (_, t) in zip(parts, lists, strict=True))], names=["run", "_range", "n", *(name for name, _ in lists)])

    summaries = parted.groupBy("run", "_range").applyInArrow(fold, f"run {kind}, _range int, n long, places array<bigint>, losses array<double>, bests array<double>, best_places array<bigint>, misses array<bigint>")

    def together(found: pa.Table) -> pa.Table:
        best, at, missed = math.inf, None, 0
        for r in found.sort_by("_range").to_pylist():
            if missed >= PATIENCE:
                break
            hit = next((i for i in range(min(r["n"], PATIENCE - missed)) if r["losses"][i] is not None and r["losses"][i] < best - margin), None)
            if hit is None:
                missed = min(PATIENCE, missed + r["n"])
            else:
                best, at, missed = r["bests"][hit], r["best_places"][hit], r["misses"][hit]
        return pa.table([pa.array([found["run"][0].as_py()], run_type), pa.array([at], pa.int64()), pa.array([best], pa.float64()), pa.array([missed < PATIENCE])], names=["run", "best_place", "best", "ran_out"])

    return summaries.groupBy("run").applyInArrow(together, f"run {kind}, best_place long, best double, ran_out boolean")
