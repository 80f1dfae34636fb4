"""Exact top-k search by inner product over integer vectors.

In each cell of the grid, vectors go by descending length in strips. A query leaves once its length times the strip's
longest can't reach its k-th score. Within a strip, sums over the first SVD-rotated dimensions plus the Cauchy-Schwarz
bound of the rest decide which pairs are worth the exact integer product. Bounds carry a slack in proportion to both
lengths, far above what doubles can err. A pair's product is taken in doubles where the lengths say that every partial
sum is a whole number below 2**52, in 64-bit integers beyond, and in Python's for the few rows with components over 2**60.

Queries go through in blocks and keep k slots each, so that memory follows neither rows nor queries times rows.

Defined cases: vectors null, empty, or holding null or non-finite components take no part (nor do those whose components
times 64 are beyond a double); repeated rows count once; a vec_id with several vectors is found once, with its best score;
ties go to the smaller vec_id; an empty table gives no rows; other columns are ignored. A score beyond a long among a
query's best fails with an error that names the pair.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.blocks import finite, grid_search

SCALE, K, QUERY_EVERY = 64, 20, 20
STRIP, QUERIES = 512, 1024
#: The rotated dimensions that hold this share of the squared lengths are summed before the bound is tested.
ENERGY = 0.6
#: Relative slack of a bound. Doubles err by about 1e-16 a dimension.
SLACK = 1e-9
#: Products of lengths up to which doubles are exact, and components up to which 64-bit integers are used.
EXACT, WIDE = 2.0**52, 2.0**60
_LEAST, _MOST = -(2**63) + 1, 2**63 - 1
_NOBODY = np.iinfo(np.int64).max


def _clamped(x: int) -> int:
    return max(_LEAST, min(_MOST, x))


def products(queries: np.ndarray, rows: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The exact integer products of the pairs in `mask`; those beyond a long are cut to its ends."""
    rough = queries @ rows.T
    q_length, length = np.sqrt((queries**2).sum(1)), np.sqrt((rows**2).sum(1))
    wide = mask & (q_length[:, None] * length[None, :] > EXACT)
    if not wide.any():
        return rough.astype(np.int64)
    out = np.where(wide, 0, rough).astype(np.int64)
    i, j = np.nonzero(wide)
    for a in range(0, len(i), 4096):
        one, two = queries[i[a : a + 4096]].astype(np.int64), rows[j[a : a + 4096]].astype(np.int64)
        out[i[a : a + 4096], j[a : a + 4096]] = (one * two).sum(1)  # modulo 2**64: right if it fits
    for a, b in zip(*np.nonzero(wide & (np.abs(rough) > 2.0**62)), strict=True):
        out[a, b] = _clamped(sum(int(x) * int(y) for x, y in zip(queries[a], rows[b], strict=True)))
    return out


class Best:
    """The k best distinct vec_ids of each of some queries."""

    def __init__(self, n: int, k: int, distinct: bool):
        self.k, self.distinct = k, distinct  # distinct: no vec_id comes twice
        self.scores, self.ids = np.full((n, k), _LEAST, np.int64), np.full((n, k), _NOBODY)

    def kth(self) -> np.ndarray:
        return np.where(self.ids[:, -1] == _NOBODY, -np.inf, self.scores[:, -1].astype(np.float64))

    def add(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> None:
        """Merge the scores of some rows (`ids`) into the queries `who`; a vec_id keeps its best score."""
        s = np.concatenate([self.scores[who], np.where(mask, scores, _LEAST)], 1)
        i = np.concatenate([self.ids[who], np.where(mask, ids[None, :], _NOBODY)], 1)
        if not self.distinct:
            place = np.lexsort((-s, i), axis=1)
            s, i = np.take_along_axis(s, place, 1), np.take_along_axis(i, place, 1)
            again = np.zeros(i.shape, bool)
            again[:, 1:] = i[:, 1:] == i[:, :-1]
            s[again], i[again] = _LEAST, _NOBODY
        place = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[who], self.ids[who] = np.take_along_axis(s, place, 1), np.take_along_axis(i, place, 1)


def search_cell(query_ids, queries, ids, rows, k: int = K):
    """The k best rows of one cell for each query: query ids, row ids, scores."""
    queries, rows = np.floor(queries), np.floor(rows)
    out = [(np.zeros(0, np.int64),) * 3]
    apart, aside = np.abs(rows).max(1) > WIDE, np.abs(queries).max(1) > WIDE  # too long for bounds in doubles
    plain, distinct = ~apart, len(np.unique(ids)) == len(ids)
    for a in range(0, len(queries), QUERIES):
        part = slice(a, a + QUERIES)
        best = Best(len(queries[part]), k, distinct)
        mine = np.flatnonzero(~aside[part])
        if len(mine) and plain.any():
            _pruned(query_ids[part], queries[part], mine, ids[plain], rows[plain], best)
        for who, which in ((np.flatnonzero(aside[part]), np.arange(len(rows))), (mine, np.flatnonzero(apart))):
            for j in which if len(who) else ():
                row = [int(x) for x in rows[j]]
                found = np.array([_clamped(sum(int(x) * y for x, y in zip(q, row, strict=True))) for q in queries[part][who]], np.int64)
                best.add(who, found[:, None], ids[j : j + 1], query_ids[part][who, None] != ids[None, j : j + 1])
        there = best.ids != _NOBODY
        n, m = np.nonzero(there)
        out.append((query_ids[part][n], best.ids[n, m], best.scores[n, m]))
    asked, found, scores = (np.concatenate([x[j] for x in out]) for j in range(3))
    beyond = np.flatnonzero((scores >= _MOST) | (scores <= _LEAST))
    if len(beyond):
        raise OverflowError(f"the product of vec_id {asked[beyond[0]]} and vec_id {found[beyond[0]]} is beyond a long")
    return asked, found, scores


def _pruned(query_ids, queries, active, ids, rows, best: Best) -> None:
    """Rows by descending length in strips, each pair tested by its bound before its product is taken."""
    length = np.sqrt((rows**2).sum(1))
    order = np.argsort(-length, kind="stable")
    rows, ids, length = rows[order], ids[order], length[order]
    scale = max(length[0], 1.0)
    values, axes = np.linalg.eigh((rows / scale).T @ (rows / scale))
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    head = int(np.searchsorted(np.cumsum(values), ENERGY * values.sum())) + 1
    turned, asked = rows @ axes, queries @ axes
    rest, asked_rest = np.sqrt((turned[:, head:] ** 2).sum(1)), np.sqrt((asked[:, head:] ** 2).sum(1))
    asked_length = np.sqrt((queries**2).sum(1))
    turned, asked = turned[:, :head], asked[:, :head]
    for start in range(0, len(rows), STRIP):
        kth = best.kth()
        kth -= SLACK * np.abs(np.where(np.isfinite(kth), kth, 0))
        active = active[asked_length[active] * length[start] * (1 + SLACK) >= kth[active]]
        if not len(active):
            return
        here = slice(start, start + STRIP)
        bound = asked[active] @ turned[here].T + asked_rest[active, None] * rest[None, here] + SLACK * asked_length[active, None] * length[None, here]
        worth = (bound >= kth[active, None]) & (query_ids[active, None] != ids[None, here])
        some = np.flatnonzero(worth.any(1))
        if not len(some):
            continue
        columns = np.flatnonzero(worth[some].any(0))
        mask = worth[np.ix_(some, columns)]
        best.add(active[some], products(queries[active[some]], rows[start + columns], mask), ids[start + columns], mask)


def ranked(found: DataFrame, k: int, best) -> DataFrame:
    """Merge what the cells found: the k best of each query, ties to the smaller vec_id."""
    merged = found.groupBy("query_id", "vec_id").agg(best("score").alias("score"))
    by = F.col("score").desc() if best is F.max else F.col("score").asc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(by, "vec_id"))
    return merged.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_inner_products(vectors: DataFrame, k: int = K, scale: int = SCALE, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query (vec_id divisible by `every`)."""
    scaled = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * scale).alias("embedding"))
    whole = scaled.filter(finite(F.col("embedding")))  # cells take the floor: Spark's gives a long, which large components don't fit
    found = grid_search(whole, F.pmod(F.col("vec_id"), F.lit(every)) == 0, lambda *cell: search_cell(*cell, k=k), "long")
    return ranked(found, k, F.max)


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, max(list_dot_product(a.e, b.e))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 20 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
