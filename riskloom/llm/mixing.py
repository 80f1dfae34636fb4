"""Mixing sources to target weights by hash-threshold histograms.

Each document gets a fixed place (60 bits of a digest of its id and text). The words of each source are summed by bucket of
the place's first 10 bits; the bucket where a source's budget ends is split by the next 10 bits, then by 10 more, and
in the last cell by single places. The threshold found this way is one number a source, and taking documents is a
filter by it: nothing is sorted.

Defined cases: a null or blank text has size 0 and takes part with no words; a null source is a source of its own, the
last one; rows with the same doc_id and text have the same place and are taken or left together, as are ties of a place, while
rows that share a doc_id alone, or have none, are documents of their own; a very long text is one document of its size; an empty table gives no rows;
columns other than doc_id, text and source pass through `apply_mix` untouched, but for those that it adds (size,
source_size, target, copies, taken), which replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import materialise

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BITS, LEVELS, PLACE_BITS = 10, 3, 60
#: Sources up to which their thresholds are broadcast; beyond, they are joined by key with salted rows.
BROADCAST_SOURCES = 100_000
SALTS = 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place_of(doc_id: Column, text: Column) -> Column:
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, PLACE_BITS // 4), 16, 10).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"size": size_of(F.col("text")), "_place": place_of(F.col("doc_id"), F.col("text")), "_key": _key(F.col("source"))})


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row a source: its words, its target, whole copies of all its documents, and the words left to fill.

    Sources fill up in order of most * size / weight; a source stops there if what remains, shared by weight among it
    and the later ones, would give it more.
    """
    one = sizes.groupBy("_key", "source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = one.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int")).cast("long"))
    w = w.withColumn("top", F.col("source_size") * most).withColumn("ratio", F.col("top") / F.col("w"))
    everything, before = Window.partitionBy(), Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = lambda words, weight: (F.col("all_size") - F.coalesce(words, F.lit(0))) / (F.col("all_w") - F.coalesce(weight, F.lit(0)))
    w = w.withColumns({"all_size": F.sum("source_size").over(everything), "all_w": F.sum("w").over(everything), "top_before": F.sum("top").over(before), "w_before": F.sum("w").over(before)})
    w = w.withColumn("full", F.col("ratio") <= level(F.col("top_before"), F.col("w_before")))
    w = w.withColumns({"full_top": F.sum(F.when(F.col("full"), F.col("top"))).over(everything), "full_w": F.sum(F.when(F.col("full"), F.col("w"))).over(everything)})
    target = F.when(F.col("full"), F.col("top").cast("double")).otherwise(F.col("w") * F.expr("try_divide(all_size - coalesce(full_top, 0), all_w - coalesce(full_w, 0))"))
    w = w.select("_key", "source_size", target.alias("target"))
    whole = F.coalesce(F.floor(F.expr("try_divide(target, source_size)")), F.lit(0)).cast("long")
    return w.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))


def _boundary(cells: DataFrame, by: list[str], cell: str, done: str | None) -> DataFrame:
    """The first cell of each source where the sum passes the budget: the sum before it, and the sum with it."""
    order = Window.partitionBy(*by).orderBy(cell)
    with_it = F.sum("words").over(order) + (F.col(done) if done else F.lit(0))
    cells = cells.withColumn("upto", with_it).withColumn("done", F.col("upto") - F.col("words")).filter("upto > rest")
    return cells.groupBy(*by).agg(F.min(F.struct(cell, "done", "upto")).alias("m")).select(*by, f"m.{cell}", "m.done", "m.upto")


def thresholds(sizes: DataFrame, goals: DataFrame, joined) -> DataFrame:
    """One row a source: the place up to which its documents are taken once more than `whole` times (null: none)."""
    cell = lambda level: F.shiftright(F.col("_place"), PLACE_BITS - BITS * level)
    small = sizes.select("_key", "_place", "size")
    found = None
    for level in range(1, LEVELS + 2):
        rows = small
        if found is not None:
            inside = found.select("_key", F.col("cell").alias("_cell"), "done", "rest")
            rows = joined(rows, inside).filter(cell(level - 1) == F.col("_cell"))
        rows = rows.withColumn("cell", cell(level) if level <= LEVELS else F.col("_place"))
        if found is None:
            sums = joined(rows.groupBy("_key", "cell").agg(F.sum("size").alias("words")), goals.select("_key", "rest"))
            ended = _boundary(sums, ["_key", "rest"], "cell", None)
        else:
            sums = rows.groupBy("_key", "rest", "done", "cell").agg(F.sum("size").alias("words")).withColumnRenamed("done", "carried")
            ended = _boundary(sums, ["_key", "rest", "carried"], "cell", "carried").drop("carried")
        found = ended
    nearer = F.col("upto") - F.col("rest") < F.col("rest") - F.col("done")
    return found.select("_key", F.when(nearer, F.col("cell")).otherwise(F.col("cell") - 1).alias("threshold"))


class Mix:
    """The plan of a mix: a small table of sources with their thresholds, and how to apply it."""

    def __init__(self, plan: DataFrame, sources: int, most: int = MOST_COPIES):
        self.plan, self.sources, self.most = plan, sources, most

    def join(self, rows: DataFrame, small: DataFrame) -> DataFrame:
        if self.sources <= BROADCAST_SOURCES:
            return rows.join(F.broadcast(small), "_key")
        salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = rows.withColumn("_salt", F.pmod(F.hash(*rows.columns), F.lit(SALTS)))
        return spread.join(salted, ["_key", "_salt"]).drop("_salt")


def plan_mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> Mix:
    """`sizes`: the columns source, size, _place and _key of `sized`, best written to a table before."""
    goals = materialise(targets(sizes, weights, most).coalesce(1), "mix-targets")
    mix = Mix(goals, goals.count(), most)
    ends = thresholds(sizes, goals, mix.join)
    mix.plan = materialise(goals.join(ends, "_key", "left").select("_key", "source_size", "target", "whole", "threshold"), "mix-plan")
    return mix


def apply_mix(docs: DataFrame, mix: Mix) -> DataFrame:
    """Each document with size, source_size, target, copies (how many times the mix takes it) and taken (words)."""
    rows = docs if "_place" in docs.columns else sized(docs)
    rows = rows.drop("source_size", "target", "whole", "threshold")
    more = (F.col("_place") <= F.coalesce(F.col("threshold"), F.lit(-1))).cast("long")
    rows = mix.join(rows, mix.plan).withColumn("copies", F.least(F.col("whole") + more, F.lit(mix.most).cast("long")))
    return rows.withColumn("taken", F.col("size") * F.col("copies")).drop("_place", "_key", "whole", "threshold")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    sizes = materialise(sized(docs.select("doc_id", "text", "source")).drop("text"), "mix-sizes")
    return apply_mix(sizes, plan_mix(sizes, weights, most)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS place
  FROM documents),
one AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT source, source_size, source_size * 3 AS top,
  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM one),
r AS (SELECT *, top::DOUBLE / w AS ratio, sum(source_size) OVER () AS all_size, sum(w) OVER () AS all_w FROM w),
b AS (SELECT *, coalesce(sum(top) OVER o, 0) AS top_before, coalesce(sum(w) OVER o, 0) AS w_before FROM r
  WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, ratio <= (all_size - top_before)::DOUBLE / (all_w - w_before) AS is_full FROM b),
g AS (SELECT *, coalesce(sum(top) FILTER (is_full) OVER (), 0) AS full_top, coalesce(sum(w) FILTER (is_full) OVER (), 0) AS full_w FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN top::DOUBLE ELSE w * ((all_size - full_top)::DOUBLE / (all_w - full_w)) END AS target FROM g),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
v AS (SELECT *, target - whole * source_size AS rest FROM u),
c AS (SELECT s.doc_id, s.size, s.place, v.source_size, v.target, v.whole, v.rest,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(s.size) OVER (PARTITION BY s.source, s.place) AS here
  FROM s JOIN v ON s.source IS NOT DISTINCT FROM v.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN upto <= rest OR (upto - here <= rest AND upto - rest < rest - (upto - here)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
