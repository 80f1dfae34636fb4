"""A stated query set against all rows, in blocks: both sides are dealt to the cells of a grid, so that a task holds
one block of rows and one block of queries, whatever the table's size."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and queries of one cell: the least and the most. Between them, a table is dealt to two cells a core.
LEAST_ROWS, MOST_ROWS, MOST_QUERIES = 4096, 131_072, 16_384


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of one cell, all of one length, as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def grid_search(vectors: DataFrame, is_query: Column, search: Callable, score_type: str) -> DataFrame:
    """Apply search(query ids, query matrix, row ids, row matrix) -> (query_id, vec_id, score) arrays in every cell.

    `vectors`: vec_id and embedding. Vectors of different lengths never meet. Rows that repeat a vec_id with the same
    vector count once.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").dropDuplicates(["vec_id", "embedding"])
    counts = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()  # before repeats go: no shuffle
    cores = v.sparkSession.sparkContext.defaultParallelism
    rows = min(MOST_ROWS, max(LEAST_ROWS, math.ceil(counts["n"] / (2 * cores))))
    n_rows, n_queries = max(1, math.ceil(counts["n"] / rows)), max(1, math.ceil(counts["q"] / MOST_QUERIES))
    dealt = v.withColumns({"dim": F.size("embedding"), "h": F.xxhash64("vec_id", "embedding")})
    own = lambda n: F.pmod(F.col("h"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = dealt.filter(is_query).withColumn("qb", own(n_queries)).withColumn("rb", every(n_rows))
    right = dealt.withColumn("rb", own(n_rows)).withColumn("qb", every(n_queries))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64() if score_type == "long" else pa.float64())])

    def cell(queries: pa.Table, block: pa.Table) -> pa.Table:
        if not len(queries) or not len(block):
            return schema.empty_table()
        found = search(queries["vec_id"].to_numpy(), matrix(queries["embedding"]), block["vec_id"].to_numpy(), matrix(block["embedding"]))
        return pa.table([pa.array(x) for x in found], schema=schema)

    keys = ["dim", "rb", "qb"]
    return left.drop("h").groupBy(*keys).cogroup(right.drop("h").groupBy(*keys)).applyInArrow(cell, f"query_id long, vec_id long, score {score_type}")
