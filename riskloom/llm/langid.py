"""Language identification by rank-order profiles.

Texts are lower-cased; letters (and marks) make words, all else is a gap. N-grams of one to three characters, gaps at
word ends included, are counted by hashed 32-bit keys. A language's profile is the rank order of its most frequent
n-grams over all learning texts; a document is given to the language whose profile is nearest by out-of-place distance:
over the document's own most frequent n-grams, the sum of the rank differences, and the greatest possible one where the
profile lacks an n-gram.

Defined cases: a null text, or one without a letter, is `und` with score 0, as is every text if nothing was learned; a
null lang is not learned from; equal distances go to the language that is first by code point; repeated rows are judged
each; an empty table gives no rows; other columns pass through `identify`, but for lang_pred and score, which are
replaced. Whole texts are counted; a very long one goes through in runs, with the counts of the whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import small_batches, trimmed

PROFILE, FOLDS, HELD_OUT = 400, 4, 2
#: Characters of a very long text that are counted at a time.
RUN = 1_000_000
STEP_CHARS = 1_000_000
#: Parts of a language's n-grams that are ranked apart before the last ranking.
PARTS = 64

_TABLE: list[np.ndarray] = []
#: Counts of n-grams that are held before they are added up.
HELD_KEYS = 1 << 18


def _letters() -> np.ndarray:
    """For each code point: 0 for a gap, 1 for a mark, 2 for a letter."""
    if not _TABLE:
        kinds = {"L": 2, "M": 1}
        _TABLE.append(np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000))
    return _TABLE[0]


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Whether a row is kept from learning: by the crc32 of its doc_id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def _mixed(key: np.ndarray) -> np.ndarray:
    key = key * np.uint64(0x9E3779B97F4A7C15)
    return ((key ^ (key >> np.uint64(29))) >> np.uint64(13)).astype(np.uint32)


def _gram(*codes: int) -> int:
    """The hashed key of one n-gram; 0 stands for a gap."""
    packed = {1: 0, 2: 1 << 63, 3: 3}[len(codes)]
    for i, c in enumerate(reversed(codes)):
        packed += c << 21 * i
    return int(_mixed(np.array([packed & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])


def grams(lowered: list[str], marks: bool = False) -> Iterator[np.ndarray]:
    """For each lower-cased text, the hashed keys of all its n-grams; none if it has no letter (with `marks`: neither
    a letter nor a mark)."""
    kinds = _letters()
    codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    kind = kinds[codes]
    inside = kind > 0
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    kept[0] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    letters = np.concatenate([[0], np.cumsum(inside if marks else kind == 2)])
    c = np.where(inside, codes, 0)[kept].astype(np.uint64)
    two = c[:-1] << np.uint64(21) | c[1:]
    three = c[:-2] << np.uint64(42) | two[1:]
    k1 = _mixed(c)
    k2 = _mixed(two + np.uint64(1 << 63))
    k3 = _mixed(three + np.uint64(3))
    ok1, ok3 = c > 0, c[1:-1] > 0
    first = 1
    for end in ends:
        end = int(end)
        if letters[end] == letters[first]:
            yield np.zeros(0, np.uint32)
        else:
            a, z = int(place[first]), int(place[end])
            z -= int(c[z - 1] == 0)
            yield np.concatenate([k1[a:z][ok1[a:z]], k2[a - 1 : z], k3[a - 1 : z - 1][ok3[a - 1 : z - 1]]])
        first = end + 1


def tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def _long(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The counts of a whole lower-cased text, in runs that end after a gap; a word longer than half a run is cut, and the
    n-grams at the cut are put right."""
    kinds = _letters()
    keys, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    at, letters = 0, 0
    while at < len(text):
        part = text[at : at + RUN]
        codes = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)
        if at + RUN < len(text):
            gaps = np.flatnonzero(kinds[codes[RUN // 2 :]] == 0)
            if len(gaps):
                codes = codes[: RUN // 2 + int(gaps[-1]) + 1]
                part = part[: len(codes)]
            elif kinds[ord(text[at + RUN])]:
                before, last, then = int(codes[-2]), int(codes[-1]), ord(text[at + RUN])
                later = ord(text[at + RUN + 1]) if at + RUN + 1 < len(text) else 0
                later = later if kinds[later] else 0
                for sign, wrong in ((-1, [(last, 0), (before, last, 0), (0, then), (0, then, later)]), (1, [(last, then), (before, last, then), (last, then, later)])):
                    keys.append(np.array([_gram(*g) for g in wrong], np.uint32))
                    counts.append(np.full(len(wrong), sign))
        letters += int((kinds[codes] == 2).sum())
        k, n = tally(next(grams([part], marks=True)))
        keys.append(k)
        counts.append(n)
        at += len(part)
    if not letters:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, inverse, np.concatenate(counts))
    return found[total > 0], total[total > 0]


def counted(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text, its distinct n-grams and their counts."""
    lowered = [t.lower() for t in texts]
    i = 0
    while i < len(lowered):
        if len(lowered[i]) > RUN:
            yield _long(lowered[i])
            i += 1
            continue
        j, size = i, 0
        while j < len(lowered) and size < STEP_CHARS and len(lowered[j]) <= RUN:
            size += len(lowered[j]) + 1
            j += 1
        yield from map(tally, grams(lowered[i:j]))
        i = j


@dataclass
class Profiles:
    """Sorted n-gram keys, and for each the rank in every language's profile."""

    languages: list[str]
    keys: np.ndarray
    ranks: np.ndarray
    size: int

    def judge(self, keys: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        if not len(keys) or not self.languages:
            return "und", 0.0
        if len(keys) > self.size:
            least = np.partition(counts, len(counts) - self.size)[len(counts) - self.size]
            some = counts >= least
            keys, counts = keys[some], counts[some]
        order = np.lexsort((keys, -counts))[: self.size]
        keys = keys[order]
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = np.where((self.keys[place] == keys)[:, None], self.ranks[place], -1)
        gap = np.where(there >= 0, np.abs(there - np.arange(len(keys))[:, None]), self.size)
        distance = gap.sum(0) / (self.size * len(keys))
        best = int(distance.argmin())
        return self.languages[best], float(1 - distance[best])


def learn(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles of every non-null lang of `docs` (columns text and lang), over all their texts."""
    rows = docs.filter("lang is not null and text is not null").select("lang", "text")

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            for lang in sorted(set(langs)):
                texts = batch["text"].filter(pa.array(langs == lang)).to_pylist()
                total_k, total_n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
                held: list[tuple[np.ndarray, np.ndarray]] = []
                many = 0
                for n, pair in enumerate(counted(texts), 1):
                    held.append(pair)
                    many += len(pair[0])
                    if many >= HELD_KEYS or n == len(texts):
                        keys = np.concatenate([total_k, *(p[0] for p in held)])
                        total_k, inverse = np.unique(keys, return_inverse=True)
                        total_n = np.bincount(inverse, np.concatenate([total_n, *(p[1] for p in held)])).astype(np.int64)
                        held, many = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total_k), pa.string()), pa.array(total_k.astype(np.int64)), pa.array(total_n)], names=["lang", "key", "n"])

    counts = rows.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    order = [F.col("n").desc(), F.col("key")]
    near = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang", F.col("key") % PARTS).orderBy(*order))).filter(F.col("r") <= size)
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("r") <= size)
    found = top.select("lang", "key", "r").collect()  # languages x profile size
    languages = sorted({r["lang"] for r in found}, key=lambda x: x.encode())
    keys = np.array(sorted({r["key"] for r in found}), np.uint32)
    ranks = np.full((len(keys), len(languages)), -1, np.int64)
    for r in found:
        ranks[np.searchsorted(keys, np.uint32(r["key"])), languages.index(r["lang"])] = r["r"] - 1
    return Profiles(languages, keys, ranks, size)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """All columns of `docs` (with a column text), and lang_pred and score (0 to 1: one minus the distance)."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # languages x profile size
    kept = docs.drop("lang_pred", "score")
    small_batches(docs.sparkSession)

    @trimmed
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch["text"].fill_null("").to_pylist()
            found = [model.judge(*pair) for pair in counted(texts)]
            columns = [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score"])

    schema = kept.withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double")}).schema
    return kept.mapInArrow(judge, schema)
