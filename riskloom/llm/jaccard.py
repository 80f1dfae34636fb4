"""N-gram Jaccard join by a size-aware heavy-light method.

A document's set holds the keys of its distinct word shingles (64 bits; 56 are compared across documents). Documents with
equal sets are one class, by a 128-bit fingerprint. Two classes link when their sets' Jaccard similarity is at least a
whole percentage.

* Shingles are ordered by the number of sets that hold them, rarest first; those of one set only can't link. A set that
  has so many of these that none of its prefix is left links with nothing, and is done.
* Light sets, up to a size, enumerate their subsets of the fixed size that a partner of each size must share; whoever
  has the same subset is linked without a comparison.
* Heavy sets are found in the inverted lists of the prefixes. Each list has a head, the member with the fewest shingles of
  its own (of a text and its near copies, the text). First each member is compared with its lists' heads, in shares of a
  bounded number of sets; that links a group of near copies, however large, by one comparison a member and head. What is
  left to compare are the members of lists of one head, and only where they hang together in several components. Such a
  group is dealt to cells of a grid of blocks by size, and in a cell each set scans the inverted lists of its shingles,
  counts overlaps, and leaves out those that it already hangs together with. Cells give a spanning forest, never all pairs.
* The size up to which sets are light is chosen by cost: subsets to enumerate against postings to scan.

Shingles that very many sets hold (found in a sample, only to place them last in the order) aren't shuffled to one
place: any fixed order gives the same links.

Defined cases: a null or blank text has an empty set, 0 shingles and no links; fewer words than a shingle are one
shingle; rows with one doc_id are separate documents if their texts differ; a null doc_id is linked like any other, but
never is a component's id unless no other is there; repeated rows fall in one class; ties have no part in it, since a
component's id is its least; a very long text is one set, whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import materialise, mix64, small_batches, split_words, steps, temporary, trimmed, word_keys
from riskloom.llm.components import components
from riskloom.llm.exchange import exchange, parts_for

WORDS, PERCENT = 4, 85
#: Bytes of a shingle's key that are compared.
KEY_BYTES = 7
#: Documents in the sample that finds very common shingles, and how many of them must hold one.
SAMPLE, COMMON = 4096, 8
#: Equal sets: classes that the dealing step skips copies of. At most this many exist by their least size.
HOT_CLASSES = 100_000
#: Light sets have at most so many shingles whatever the cost says.
MOST_LIGHT = 24
#: Shingles and sets of one block of a group, or of one share of a head's members.
CELL_KEYS, CELL_SETS = 250_000, 256
#: Groups by band of sizes, up to which their numbers of blocks are broadcast; beyond, they are joined by key.
BROADCAST_BANDS = 500_000
_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle keys of each text."""
    starts, ends, cut = split_words(data, offsets)
    w = word_keys(data, starts, ends)
    n = len(w) - words + 1
    whole = np.zeros(0, np.uint64)
    if n > 0:
        whole = w[:n].copy()
        for i in range(1, words):
            whole = whole * _P + w[i : n + i]
        whole = mix64(whole)
    for a, z in itertools.pairwise(cut):
        if z - a >= words:
            keys = np.sort(whole[a : z - words + 1])
            yield keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        elif z > a:
            one = np.uint64(z - a)
            for x in w[a:z]:
                one = np.uint64((int(one) * int(_P) + int(x)) & 0xFFFFFFFFFFFFFFFF)
            yield mix64(np.array([one]))
        else:
            yield w[:0]


def overlap_needed(m: int, n: int, percent: int = PERCENT) -> int:
    """The least common shingles of linked sets of sizes m and n: 100 * o >= percent * (m + n - o)."""
    return -(-percent * (m + n) // (100 + percent))


def least_partner(n: np.ndarray | int, percent: int = PERCENT):
    """The least size that a partner of a set of size n can have."""
    return -(-percent * n // 100)


def _fingerprint(keys: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(keys.tobytes()) if len(keys) else None


def describe(docs: DataFrame, every: int, words: int = WORDS) -> DataFrame:
    """doc_id, n, fp (the set's fingerprint; null if empty), sample (the keys, for about one row in `every`)."""

    @trimmed
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp, sample = [], [], []
            for _, _, data, offsets in steps(batch["text"]):
                for keys in shingle_sets(data, offsets, words):
                    n.append(len(keys))
                    fp.append(_fingerprint(keys))
                    sample.append(keys.tobytes())
            taken = batch["_pick"].to_numpy(zero_copy_only=False)
            sample = [s if t else None for s, t in zip(sample, taken, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sample, pa.binary())], names=["doc_id", "n", "fp", "sample"])

    pick = F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_pick", pick).mapInArrow(sets, "doc_id long, n long, fp binary, sample binary")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """`docs` with each row's fp, as in linked_rows."""
    names = [*docs.columns, "fp"]

    @trimmed
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [_fingerprint(keys) for _, _, data, offsets in steps(batch["text"]) for keys in shingle_sets(data, offsets, words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp, pa.binary())], names=names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField("fp", T.BinaryType())]))


def _exploded(rows: DataFrame, binary: str, keep: list[str]) -> DataFrame:
    """One row for each 64-bit key in a binary column."""

    @trimmed
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [x.as_py() for x in batch[binary]]
            at = np.repeat(np.arange(len(blobs)), [len(x) // 8 for x in blobs])
            keys = np.frombuffer(b"".join(blobs), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(batch[c].take(pa.array(at)) for c in keep)], names=["key", *keep])

    kinds = dict(rows.dtypes)
    return rows.select(binary, *keep).mapInArrow(explode, ", ".join(["key long", *(f"{c} {kinds[c]}" for c in keep)]))


def survivors(docs: DataFrame, base: DataFrame, hot: dict[bytes, int], common: np.ndarray, percent: int, words: int) -> DataFrame:
    """fp, n, keys (shingles that other sets hold too), prefix (the rarest of them, as far as a partner must meet one)."""
    total = base.agg(F.sum("n")).first()[0] or 0
    order = np.argsort(common, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((hot, common[order], order))  # bounded: HOT_CLASSES; sample / COMMON

    def deal(batch: pa.RecordBatch):
        hot, known, rank = shared.value
        ids = batch["doc_id"].to_pylist()
        keys, at, fps, ns, common_at, common_rank = [], [], [], [], [], []
        row, seen = 0, set()
        for _, _, data, offsets in steps(batch["text"]):
            for mine in shingle_sets(data, offsets, words):
                fp = _fingerprint(mine)
                fps.append(fp or bytes(16))
                ns.append(len(mine))
                if fp is not None and fp not in seen and hot.get(fp, ids[row]) == ids[row]:
                    seen.add(fp)  # copies next to it are left out too, whatever their ids
                    if len(known):
                        place = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                        found = known[place] == mine
                        if found.any():
                            common_at.append(np.full(int(found.sum()), row))
                            common_rank.append(rank[place[found]])
                            mine = mine[~found]
                    keys.append(mine)
                    at.append(np.full(len(mine), row, np.uint32))
                else:
                    ns[-1] = 0  # a copy, or an empty set
                row += 1
        cat = lambda x, t: np.concatenate([np.zeros(0, t), *x]).astype(t)
        own = [np.frombuffer(b"".join(fps), np.int64), np.array(ns, np.int64), cat(common_at, np.int64), cat(common_rank, np.int64)]
        sizes = np.array([len(x) for x in own], np.int64)
        return cat(keys, np.uint64), cat(at, np.uint32), None, sizes.tobytes() + b"".join(x.tobytes() for x in own)

    def answer(keys: np.ndarray, _):
        order = np.argsort(keys)
        sorted_keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
        times = np.diff(np.append(first, len(keys)))
        count = np.empty(len(keys), np.int64)
        count[order] = np.repeat(times, times)
        return count >= 2, np.minimum(count, 65535)

    def gather(own: bytes, at: np.ndarray, keys: np.ndarray, count: np.ndarray) -> pa.Table:
        known, rank = shared.value[1:]
        by_rank = known[np.argsort(rank, kind="stable")] if len(known) else known
        sizes = np.frombuffer(own, np.int64, 4)
        fps, ns, common_at, common_rank = np.split(np.frombuffer(own, np.int64, offset=32), np.cumsum(sizes)[:-1])
        at = np.concatenate([at, common_at])
        keys = np.concatenate([keys, by_rank[common_rank]]) if len(common_rank) else keys
        count = np.concatenate([count.astype(np.int64), 65536 + common_rank])
        order = np.lexsort((keys, count, at))
        at, keys = at[order], keys[order]
        cut = np.searchsorted(at, np.arange(len(ns) + 1))
        out = []
        for row in np.flatnonzero(np.diff(cut)):
            n, mine = int(ns[row]), keys[cut[row] : cut[row + 1]]
            left = n - least_partner(n, percent) + 1 - (n - len(mine))
            if left > 0:
                out.append((fps[2 * row : 2 * row + 2].tobytes(), n, np.sort(mine).tobytes(), mine[:left].tobytes()))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.binary(), pa.binary()))], names=["fp", "n", "keys", "prefix"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return exchange(rows, parts_for(total), deal, answer, gather, "fp binary, n long, keys binary, prefix binary", width=KEY_BYTES).dropDuplicates(["fp"])


def light_keys(n: int, keys: np.ndarray, percent: int) -> Iterator[tuple[bytes, int, int]]:
    """(subset key, least size, greatest size) for each subset that a partner of each size must share."""
    for other in range(least_partner(n, percent), 100 * n // percent + 1):
        low, high = min(n, other), max(n, other)
        size = overlap_needed(n, other, percent)
        if size <= min(low, len(keys)):
            for subset in itertools.combinations(keys.tolist(), size):
                yield xxhash.xxh3_128_digest(np.array([*subset, low, high], np.uint64).tobytes()), low, high


def light_cost(n: int, held: int, percent: int) -> int:
    """How many subsets a set of n shingles enumerates, of which `held` are in other sets too."""
    sizes = (overlap_needed(n, m, percent) for m in range(least_partner(n, percent), 100 * n // percent + 1))
    return sum(math.comb(held, s) for s in sizes)


def boundary(sets: DataFrame, lists: DataFrame, percent: int) -> int:
    """The greatest size up to which enumerating subsets costs no more than scanning lists."""
    small = sets.filter(F.col("n") <= MOST_LIGHT)
    enumerated = small.groupBy("n", (F.length("keys") / 8).cast("int").alias("held")).count().collect()  # at most MOST_LIGHT squared
    scanned = {r["n"]: r["c"] for r in lists.filter(F.col("n") <= MOST_LIGHT).groupBy("n").agg(F.sum("long").alias("c")).collect()}
    cost: dict[int, int] = {}
    for r in enumerated:
        cost[r["n"]] = cost.get(r["n"], 0) + r["count"] * light_cost(r["n"], r["held"], percent)
    size = 0
    for n in range(1, MOST_LIGHT + 1):
        if cost.get(n, 0) > scanned.get(n, 0):
            break
        size = n
    return size


def light_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links among light sets: all that share a subset hang on the least one of the lesser size."""

    @trimmed
    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(key, fp.as_py(), n.as_py() == low) for fp, n, keys in zip(batch["fp"], batch["n"], batch["keys"], strict=True) for key, low, _ in light_keys(n.as_py(), np.frombuffer(keys.as_py(), np.uint64), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.bool_()))], names=["key", "fp", "less"])

    rows = sets.select("fp", "n", "keys").mapInArrow(subsets, "key binary, fp binary, less boolean")
    heads = rows.groupBy("key").agg(F.min(F.when(F.col("less"), F.col("fp"))).alias("head"), F.count(F.lit(1)).alias("c")).filter("c > 1 and head is not null")
    return rows.join(heads, "key").filter("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b")).distinct()


def _cut(rows: DataFrame, *keys: str) -> DataFrame:
    """Into how many blocks of bounded size the sets of each key fall."""
    return rows.groupBy(*keys).agg(F.ceil(F.greatest(F.sum("n") / CELL_KEYS, F.count(F.lit(1)) / CELL_SETS)).cast("int").alias("blocks"))


def _held(df: DataFrame) -> DataFrame:
    """Broadcast if it is small; df is written already."""
    return F.broadcast(df) if df.count() <= BROADCAST_BANDS else df


def head_links(sets: DataFrame, lists: DataFrame, light: int, percent: int) -> DataFrame:
    """Links of sets with the heads of their lists. `lists`: key, fp, n, head and head_n."""
    fits = 100 * F.least("n", "head_n") >= percent * F.greatest("n", "head_n")
    pairs = lists.filter((F.col("fp") != F.col("head")) & fits & (F.greatest("n", "head_n") > light)).select("fp", "n", "head", "head_n").distinct()
    pairs = materialise(pairs, "head-pairs")
    shares = _held(materialise(_cut(pairs, "head"), "head-shares"))
    members = pairs.join(shares, "head").withColumn("share", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    members = members.select("fp", "n", "head", "share").join(sets.select("fp", "keys"), "fp")
    heads = shares.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.col("head").alias("fp"), "share")
    heads = heads.join(sets.select("fp", F.col("n").alias("head_n"), F.col("keys").alias("head_keys")), "fp").withColumnRenamed("fp", "head")

    def compare(one: pa.Table, some: pa.Table) -> pa.Table:
        out = []
        if len(one) and len(some):
            head, n = np.frombuffer(one["head_keys"][0].as_py(), np.uint64), one["head_n"][0].as_py()
            sizes = some["n"].to_numpy()
            blobs = [x.as_py() for x in some["keys"]]
            keys = np.frombuffer(b"".join(blobs), np.uint64)
            owner = np.repeat(np.arange(len(blobs)), [len(x) // 8 for x in blobs])
            place = np.minimum(np.searchsorted(head, keys), len(head) - 1)
            common = np.bincount(owner[head[place] == keys], minlength=len(blobs))
            found = np.flatnonzero(100 * common >= percent * (n + sizes - common))
            out = [(some["fp"][int(i)].as_py(), one["head"][0].as_py()) for i in found]
        return pa.table([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], names=["a", "b"])

    keys = ["head", "share"]
    return heads.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(compare, "a binary, b binary")


def scan(ns: np.ndarray, sets: list[np.ndarray], root: np.ndarray, side: np.ndarray, percent: int, light: int) -> list[tuple[int, int]]:
    """Links of one cell, as places, that join its components (`root`): each set scans the inverted lists of its keys."""
    keys = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    root = root.copy()  # every set's component, kept flat
    links = []
    for i in np.argsort(-ns, kind="stable"):
        n = int(ns[i])
        others = (root != root[i]) & (ns <= n) & (ns >= least_partner(n, percent))
        if side[i] >= 0:
            others &= side != side[i]
        if n <= light:
            others &= ns > light
        # partners of the same size are met from both ends; larger ones have met this set already
        if not others.any():
            continue
        low, high = np.searchsorted(keys, sets[i], "left"), np.searchsorted(keys, sets[i], "right")
        met = np.concatenate([owner[a:z] for a, z in zip(low, high, strict=True)])
        common = np.bincount(met, minlength=len(sets))
        for j in np.flatnonzero(others & (100 * common >= percent * (n + ns - common))):
            if root[j] != root[i]:
                links.append((int(i), int(j)))
                root[root == root[j]] = root[i]
    return links


def open_groups(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """head, fp, n, root: the members of each head's lists, where they are in several components."""
    groups = lists.select("head", "fp", "n").distinct()
    placed = groups.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = materialise(placed, "placed")
    kept = placed.groupBy("head").agg(F.min("root").alias("one"), F.max("root").alias("other")).filter("one <> other").select("head")
    return materialise(placed.join(kept, "head"), "open-groups")


def group_links(sets: DataFrame, groups: DataFrame, light: int, percent: int) -> DataFrame:
    """Links with at least one heavy set between components. `groups`: head, fp, n, root."""
    rows = groups.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int"))
    whole = _held(materialise(_cut(rows, "head").withColumnRenamed("blocks", "all_blocks"), "group-blocks"))
    bands = materialise(_cut(rows, "head", "band"), "group-bands")
    small = bands.count() <= BROADCAST_BANDS
    held = lambda df: F.broadcast(df) if small else df
    beside = lambda step, name: bands.select("head", (F.col("band") - step).alias("band"), F.col("blocks").alias(name))
    rows = rows.join(whole, "head").join(held(bands), ["head", "band"])
    for step, name in ((1, "above"), (-1, "below")):
        rows = rows.join(held(beside(step, name)), ["head", "band"], "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    own = "transform(sequence(0, blocks - 1), j -> struct(band as lo, band as hi, least(mine, j) as i, greatest(mine, j) as j, if(mine = j, -1, mine) as side))"
    up = "if(above is null, array(), transform(sequence(0, above - 1), j -> struct(band as lo, band + 1 as hi, mine as i, j as j, -2 as side)))"
    down = "if(below is null, array(), transform(sequence(0, below - 1), i -> struct(band - 1 as lo, band as hi, i as i, mine as j, -3 as side)))"
    one = "array(struct(0 as lo, 0 as hi, 0 as i, 0 as j, -1 as side))"
    cells = rows.withColumn("mine", mine).select("head", "fp", "n", "root", F.explode(F.expr(f"if(all_blocks = 1, {one}, concat({own}, {up}, {down}))")).alias("cell"))
    dealt = cells.select("head", "fp", "n", "root", "cell.*").join(sets.select("fp", "keys"), "fp")

    def find(rows: pa.Table) -> pa.Table:
        side = rows["side"].to_numpy()
        side = np.where(side == -2, 0, np.where(side == -3, 1, side))
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows["keys"]]
        fps, roots = rows["fp"].to_pylist(), {}
        root = np.array([roots.setdefault(r, len(roots)) for r in rows["root"].to_pylist()])
        found = scan(rows["n"].to_numpy(), sets, root, side, percent, light)
        return pa.table([pa.array([fps[x[i]] for x in found], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return dealt.groupBy("head", "lo", "hi", "i", "j").applyInArrow(find, "a binary, b binary")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs` (columns doc_id and text)."""
    return linked_rows(docs, percent, words).select("doc_id", "n_shingles", "component_id")


def linked_rows(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """jaccard_components with fp (the set's fingerprint) and root (one a component, also where components repeat an id);
    both are null if the set is empty."""
    small_batches(docs.sparkSession)
    with temporary(docs.sparkSession) as keep:
        rows = docs.count()
        base = keep(materialise(describe(docs, max(1, rows // SAMPLE), words), "shingles"))
        classes = materialise(base.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")), "classes")
        least = max(4, rows // HOT_CLASSES)
        hot = {r["fp"]: r["rep"] for r in classes.filter((F.col("c") >= least) & F.col("rep").isNotNull()).select("fp", "rep").collect()}  # at most rows / least
        sampled = _exploded(base.filter("sample is not null").dropDuplicates(["fp"]).select("fp", "sample"), "sample", [])
        common = sampled.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= COMMON).collect()  # at most the sample / COMMON
        common = np.array([r["key"] for r in sorted(common, key=lambda r: (r["c"], r["key"]))], np.int64).view(np.uint64)

        sets = materialise(survivors(docs, base, hot, common, percent, words), "sets")
        own = F.col("n") - (F.length("keys") / 8).cast("long")
        posted = _exploded(sets.withColumn("own", own), "prefix", ["fp", "n", "own"])
        heads = posted.groupBy("key").agg(F.min(F.struct("own", "fp", "n")).alias("h"), F.count(F.lit(1)).alias("long"), F.max("n").alias("largest")).filter("long > 1")
        heads = heads.select("key", F.col("h.fp").alias("head"), F.col("h.n").alias("head_n"), "long", "largest")
        lists = materialise(posted.drop("own").join(heads, "key"), "lists")
        light = boundary(sets, lists, percent)
        heavy = lists.filter(F.col("largest") > light)
        near = components(head_links(sets, heavy, light, percent))
        links = near.select(F.col("node").alias("a"), F.col("root").alias("b")).union(group_links(sets, open_groups(heavy, near), light, percent))
        if light:
            links = links.union(light_links(sets.filter(F.col("n") <= light), percent))
        roots = components(links)
        grouped = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        of_root = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
        of_class = keep(materialise(grouped.join(of_root, "root").select("fp", "root", "component_id"), "components"))
    out = base.select("doc_id", "n", "fp").join(of_class, "fp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "fp", "root")


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
k AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS m, b.n AS n, count(*) AS o FROM k a JOIN k b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * o >= 85 * (m + n - o)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(y) FROM reach r WHERE r.x = sets.doc_id), doc_id)) AS component_id FROM sets
"""
