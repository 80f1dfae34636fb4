"""Digests of sets of lines that don't depend on their order, by trees of hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.sources.shared import written

#: Distinct lines of one leaf, about, and children of one node.
LEAF, FANOUT = 256, 16
_DEEPEST = 12


def tree(rows: DataFrame, by: list[str], line: Column) -> DataFrame:
    """The keys `by`, n (lines) and digest of each key's lines.

    Lines are hashed and counted. A key with more than `LEAF` distinct ones has as many levels as bring a leaf below that; a leaf is the
    hash of the lines whose hashes begin alike, a node that of its up to 16 children. Shape and digest follow from the lines
    alone, and no node gathers more than a leaf's lines or 16 hashes, whatever a key holds.
    """
    found = written(rows.select(*by, F.sha2(line, 256).alias("s")).groupBy(*by, "s").agg(F.count(F.lit(1)).alias("c")), "lines")
    sizes = found.groupBy(*by).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("lines"))
    depth = reduce(lambda a, b: a + b, [(F.col("lines") > LEAF * FANOUT**j).cast("int") for j in range(_DEEPEST)])
    sizes = sizes.select(*(F.col(c).alias(f"_{c}") for c in by), "n", depth.alias("depth"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    placed = found.join(sizes, same).select(*by, "n", "depth", F.expr("substring(s, 1, depth)").alias("p"), F.concat("s", F.lit(":"), F.col("c").cast("string")).alias("x"))
    together = lambda h: F.sha2(F.array_join(F.array_sort(F.collect_list(h)), ","), 256)
    nodes = placed.groupBy(*by, "n", "depth", "p").agg(together("x").alias("h"))
    deepest = sizes.agg(F.max("depth")).first()[0] or 0
    for level in range(deepest - 1, -1, -1):
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"])
        up = nodes.groupBy(*by, "n", "depth", F.expr(f"substring(p, 1, {level})").alias("q")) if level else nodes.groupBy(*by, "n", "depth", F.lit("").alias("q"))
        nodes = up.agg(F.when(F.col("depth") > level, F.sha2(F.array_join(ordered, ","), 256)).otherwise(F.max("h")).alias("h")).withColumnRenamed("q", "p")
    return nodes.select(*by, "n", F.col("h").alias("digest"))


def tree_sql(source: str, by: str, levels: int = 4) -> str:
    """The same in DuckDB SQL, for keys of up to `LEAF` * 16 ** `levels` distinct lines. `source`: a query of `by` and line."""
    depth = " ".join(f"WHEN n <= {LEAF * FANOUT**j} THEN {j}" for j in range(levels))
    found = f"SELECT *, CASE {depth} ELSE {levels} END AS l FROM (SELECT {by}, s, s || ':' || count(*) AS x, count(*) OVER (PARTITION BY {by}) AS n FROM (SELECT {by}, sha256(line) AS s FROM ({source}) t0) t1 GROUP BY {by}, s) t2"
    nodes = f"SELECT {by}, l, substr(s, 1, l) AS p, sha256(string_agg(x, ',' ORDER BY x)) AS h FROM ({found}) t3 GROUP BY ALL"
    for k in range(levels - 1, -1, -1):
        nodes = f"SELECT {by}, l, q AS p, CASE WHEN l > {k} THEN sha256(string_agg(h, ',' ORDER BY p)) ELSE max(h) END AS h FROM (SELECT *, substr(p, 1, {k}) AS q FROM ({nodes}) n{k}) m{k} GROUP BY {by}, l, q"
    return f"SELECT {by}, h AS digest FROM ({nodes}) t9"
