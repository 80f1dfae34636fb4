"""Approximate nearest neighbours by stable projections in a kd-tree.

In each cell of the grid, vectors are projected by a few seeded Gaussian (2-stable) directions and the projections are
held in a kd-tree. A query descends the tree best first, by a queue of boxes in order of their projected distance; it
verifies the original vectors in double precision as their projections come up, and stops when a chi-square test says
that nothing farther in projection is likely to be nearer than its k-th neighbour: the squared projected distance over
the squared true distance follows chi-square with as many degrees of freedom as there are directions.

Rows that hold the same vector are one point of the tree, with the smallest of their vec_ids that a query can need.

Defined cases: vectors null, empty, zero, or holding null or non-finite components take no part; repeated rows count
once; a vec_id with several vectors is found once, at its least distance; ties among the verified rows, and among any
number of copies of one vector, go to the smaller vec_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.blocks import finite, grid_search
from riskloom.llm.mips import ranked

K, QUERY_EVERY = 10, 100
DIRECTIONS, LEAF, SURE, SEED = 8, 32, 0.98, 11
#: Binary cuts that make the children of one node, and points verified at a time: the first and the most.
CUTS, FIRST_STEP, MOST_STEP = 3, 64, 4096


def chi_square_quantile(p: float, degrees: int) -> float:
    """For an even number of degrees: the distribution is a finite sum, inverted by bisection."""
    def cdf(x: float) -> float:
        term = total = 1.0
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        low, high = (mid, high) if cdf(mid := (low + high) / 2) < p else (low, mid)
    return high


class ProjectedTree:
    """A kd-tree over projected points. A node's children lie side by side, each with its box; a leaf is a run of points."""

    def __init__(self, rows: np.ndarray):
        self.directions = np.random.default_rng(SEED).standard_normal((rows.shape[1], DIRECTIONS))
        points = rows @ self.directions
        members, runs, children, boxes = [], [(0, 0)], [(0, 0)], [(points.min(0), points.max(0))]
        todo, placed = [(0, np.arange(len(points)))], 0
        while todo:
            node, part = todo.pop()
            kids = self._cut(points, part)
            if len(kids) == 1:
                members.append(part)
                runs[node] = (placed, placed + len(part))
                placed += len(part)
                continue
            children[node] = (len(runs), len(runs) + len(kids))
            for kid in kids:
                todo.append((len(runs), kid))
                runs.append((0, 0))
                children.append((0, 0))
                boxes.append((points[kid].min(0), points[kid].max(0)))
        self.members = np.concatenate(members)
        self.points, self.runs, self.children = points[self.members], runs, children
        self.low, self.high = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])

    @staticmethod
    def _cut(points: np.ndarray, part: np.ndarray) -> list[np.ndarray]:
        """Halves, quarters and so on, each along its widest axis; the part itself if it is a leaf."""
        parts = [part]
        for _ in range(CUTS):
            halves = []
            for p in parts:
                spread = np.ptp(points[p], axis=0)
                axis = int(spread.argmax())
                if len(p) <= LEAF or spread[axis] == 0:
                    halves.append(p)
                    continue
                half = len(p) // 2
                cut = np.argpartition(points[p, axis], half)
                halves += [p[cut[:half]], p[cut[half:]]]
            parts = halves
        return parts


class Copies:
    """The distinct vectors of a cell and, for each, its smallest vec_ids: as many as a query can need."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, most: int):
        rows = rows + 0.0  # one zero
        order = np.argsort(ids, kind="stable")
        place: dict[bytes, int] = {}
        first, held = [], []
        for i in order.tolist():
            at = place.setdefault(rows[i].tobytes(), len(first))
            if at == len(first):
                first.append(i)
                held.append([])
            if len(held[at]) < most and (not held[at] or held[at][-1] != ids[i]):
                held[at].append(int(ids[i]))
        self.rows = rows[first]
        self.counts = np.array([len(x) for x in held], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)[:-1]])
        self.ids = np.array([i for x in held for i in x], np.int64)

    def expand(self, at: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vec_ids of these vectors, and the distance of each."""
        n = self.counts[at]
        first = np.repeat(self.starts[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        return self.ids[first + np.arange(int(n.sum()))], np.repeat(distance, n)


def search_cell(query_ids, queries, ids, rows, k: int = K, sure: float = SURE):
    """The k nearest rows of one cell for each query: query ids, row ids, distances."""
    copies = Copies(ids, rows, k + 1)
    tree = ProjectedTree(copies.rows)
    limit = chi_square_quantile(sure, DIRECTIONS)
    vectors, runs, children = copies.rows[tree.members], tree.runs, tree.children
    out = []
    for query_id, query in zip(query_ids, queries, strict=True):
        at = query @ tree.directions
        best, best_ids = np.zeros(0), np.zeros(0, np.int64)
        stop, step, heap = math.inf, FIRST_STEP, [(0.0, 0)]
        while heap:
            taken, points = [], 0
            while heap and points < step:
                distance, node = heapq.heappop(heap)
                if distance >= stop:
                    heap = []
                    break
                a, z = children[node]
                if a == z:
                    a, z = runs[node]
                    taken.append(np.arange(a, z))
                    points += z - a
                    continue
                gap = np.maximum(np.maximum(tree.low[a:z] - at, at - tree.high[a:z]), 0)
                for kid, d in enumerate((gap * gap).sum(1).tolist(), a):
                    if d < stop:
                        heapq.heappush(heap, (d, kid))
            if not taken:
                break
            places = np.concatenate(taken)
            if stop < math.inf:  # the test has stopped before points that are farther in projection
                places = places[((tree.points[places] - at) ** 2).sum(1) < stop]
            found, distance = copies.expand(tree.members[places], np.sqrt(((vectors[places] - query) ** 2).sum(1)))
            other = found != query_id
            best, best_ids = np.concatenate([best, distance[other]]), np.concatenate([best_ids, found[other]])
            sort = np.lexsort((best_ids, best))
            _, first = np.unique(best_ids[sort], return_index=True)
            sort = sort[np.sort(first)[:k]]
            best, best_ids = best[sort], best_ids[sort]
            stop = limit * best[k - 1] ** 2 if len(best) >= k else math.inf
            step = min(2 * step, MOST_STEP)
        out.append((np.full(len(best), query_id), best_ids, best))
    return tuple(np.concatenate([x[j] for x in out]) for j in range(3))


def nearest(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query (vec_id divisible by `every`), by Euclidean distance."""
    usable = vectors.filter(finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    usable = usable.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    found = grid_search(usable, F.pmod(F.col("vec_id"), F.lit(every)) == 0, lambda *cell: search_cell(*cell, k=k), "double")
    return ranked(found, k, F.min)
