"""Toxicity by a small convolutional classifier trained in numpy.

Words (runs of letters, digits and bytes beyond ASCII, lower-cased) are hashed to embeddings: one of the word and one of
its first bytes, added. Filters of width one, two and three slide over a document; the greatest response of each filter
over the whole text goes to a logistic unit. A threshold is then set for each language on the responses of models that
haven't seen the row, where the errors are fewest, and the response is scaled so that the threshold lies at the same
score everywhere. The language is taken from the text, by naive Bayes over the same hashed words.

Training uses every labelled row, each whole. Rows are dealt by a hash to shards of about `SHARD_ROWS` rows or `SHARD_WORDS`
words; in each round every shard goes on from the same weights, and the changes of each row of weights are averaged over the
shards that changed it. Shards, not tasks, decide what is learned: a layout changes scores by rounding only. The shards are
kept on the executors' disks between the rounds. Each model is trained in tasks of its own over the same shards, about as many
in all as there are cores, and each task sends the sum of its changes to one model. Word counts, languages and thresholds cover all labelled rows: thresholds
come from sums over ranges of the sorted responses. Only tables of fixed size, or of one column for each language, come to the
driver. Scores cover every whole text. A bounded sample is learned from only where a caller of `fit` asks for one.

Defined cases: a null, empty or wordless text gets the score of a document without words; a label other than 0 or 1, or
a null one, is not learned from; a doc_id with several labels is learned from with each; rows that repeat doc_id, text and
label are learned from once; without both labels, or with fewer than six labelled texts, the score is 0 everywhere;
repeated rows are scored each, and alike; very long texts are scored whole, one at a time; equal thresholds go to the
higher one; an empty table gives no rows; other columns pass through `score`, but for score and predicted, which are
replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import materialise, mix64, release, small_batches, steps, temporary, trimmed

FOLDS, HELD_OUT, CUT = 3, 1, 0.7
WORD_ROWS, HEAD_ROWS, HEAD_BYTES = 1 << 16, 1 << 14, 4
DIM, WIDTHS, FILTERS = 8, (1, 2, 3), 8
EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 4, 300, 64, 0.02, 3
#: Training documents that must have a word (or its first bytes) for its row to be learned, and the share of words that a
#: step sees of a document.
LEAST_DOCS, KEEP = 3, 0.5
#: Parts of the rows: each part's responses come from a model that was trained on the others, and set the thresholds.
PARTS = 3
STEP_BYTES = 1 << 20
#: A shard without a part has rows enough for LEAST_STEPS steps in EPOCHS epochs, unless its texts are long.
SHARD_ROWS, SHARD_WORDS = LEAST_STEPS * BATCH // EPOCHS * PARTS // (PARTS - 1), 8 << 20
#: Words of a step beyond which it takes no further document; rows of weights, and responses, that are added up at a time.
STEP_WORDS, SLICE_ROWS, RANGE_ROWS = 1 << 20, 8192, 250_000
#: Tasks of a model whose sums are added up in one step; those of more tasks are added up in groups first.
ONE_STEP = 64
#: Labelled ids up to which they are broadcast; beyond, documents and labels are joined by key.
BROADCAST_IDS = 1_000_000

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row of each word's embedding, the row of its first bytes, and each text's first word (texts + 1)."""
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut], last[cut - 1] = inside[cut], inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    places = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int32), places
    low = _LOWER[data]
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    length = ends - starts

    def eight(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Up to eight bytes from `at`, as one integer."""
        raw = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))[at]
        whole = np.ascontiguousarray(raw).view("<u8").ravel()
        keep = np.clip(left, 0, 8).astype(np.uint64) * np.uint64(8)
        mask = np.where(keep >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(keep, np.uint64(63))) - np.uint64(1))
        return whole & mask

    head = eight(starts, length)
    key = head.copy()
    going, step = np.flatnonzero(length > 8), 8
    while len(going):
        key[going] = mix64(key[going]) ^ eight(starts[going] + step, length[going] - step)
        step += 8
        going = going[length[going] > step]
    front = head & np.uint64((1 << 8 * HEAD_BYTES) - 1)
    return (mix64(key) % np.uint64(WORD_ROWS)).astype(np.int32), (mix64(front + np.uint64(1)) % np.uint64(HEAD_ROWS)).astype(np.int32), places


@dataclass
class Model:
    """Embeddings, filters, the logistic unit, and the languages with their thresholds."""

    word: np.ndarray
    head: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    unit: np.ndarray
    offset: float
    languages: np.ndarray
    thresholds: np.ndarray

    def pooled(self, w: np.ndarray, h: np.ndarray, places: np.ndarray, trace: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Each text's greatest response of every filter, and, to trace it back, where its window begins (-1: nowhere)."""
        x = self.word[w] + self.head[h]
        best = np.zeros((len(places) - 1, len(WIDTHS) * FILTERS), np.float32)
        where = np.full(best.shape, -1, np.int64)
        filled = np.flatnonzero(np.diff(places) > 0)
        if not len(filled):
            return best, where
        starts, ends = places[filled], places[filled + 1]
        for f, width in enumerate(WIDTHS):
            columns = slice(f * FILTERS, (f + 1) * FILTERS)
            y = x @ self.filters[f][0]
            for k in range(1, width):
                y[:-k] += x[k:] @ self.filters[f][k]
            late = ends[:, None] - np.arange(1, width)
            y[late[late >= starts[:, None]]] = -np.inf  # a window ends with its text
            best[filled, columns] = np.maximum(np.maximum.reduceat(y, starts, axis=0) + self.bias[columns], 0)
            if trace:
                for t, a, z in zip(filled, starts, ends, strict=True):
                    where[t, columns] = np.where(best[t, columns] > 0, a + y[a:z].argmax(0), -1)
        return best, where

    def response(self, w: np.ndarray, h: np.ndarray, places: np.ndarray) -> np.ndarray:
        return self.pooled(w, h, places)[0] @ self.unit + self.offset

    def language(self, w: np.ndarray, places: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(places), self.languages.shape[1]))
        filled = np.flatnonzero(np.diff(places) > 0)
        if len(filled):
            sums[filled] = np.add.reduceat(self.languages[w], places[filled], axis=0)
        return sums[:-1].argmax(1)

    def score(self, w: np.ndarray, h: np.ndarray, places: np.ndarray) -> np.ndarray:
        """0 to 1; a language's threshold lies at CUT."""
        over = self.response(w, h, places) - self.thresholds[self.language(w, places)]
        return 1 / (1 + np.exp(-np.clip(over, -30, 30) - np.log(CUT / (1 - CUT))))


def _blank(languages: int) -> Model:
    rng = np.random.default_rng(SEED)
    some = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    filters = [some(width, DIM, FILTERS) * 3 for width in WIDTHS]
    n = len(WIDTHS) * FILTERS
    return Model(some(WORD_ROWS, DIM), some(HEAD_ROWS, DIM), filters, np.zeros(n, np.float32), some(n) * 2, 0.0, np.zeros((WORD_ROWS, languages), np.float32), np.zeros(languages))


def _dense(flat: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Filters, bias, unit and offset, as views of one array."""
    sizes = [*(width * DIM * FILTERS for width in WIDTHS), len(WIDTHS) * FILTERS, len(WIDTHS) * FILTERS, 1]
    *filters, bias, unit, offset = np.split(flat.reshape(-1), np.cumsum(sizes)[:-1])
    return [f.reshape(width, DIM, FILTERS) for f, width in zip(filters, WIDTHS, strict=True)], bias, unit, offset


def _tables() -> list[np.ndarray]:
    """The weights before training: words, first bytes, and all others as one column."""
    blank = _blank(1)
    others = [*(f.ravel() for f in blank.filters), blank.bias, blank.unit, np.zeros(1, np.float32)]
    return [blank.word, blank.head, np.concatenate(others)[:, None]]


def _model(tables: list[np.ndarray]) -> Model:
    """A model of views of the tables, as yet without languages and thresholds."""
    filters, bias, unit, offset = _dense(tables[2])
    return Model(tables[0], tables[1], filters, bias, unit, float(offset[0]), np.zeros((WORD_ROWS, 1), np.float32), np.zeros(1))


@dataclass
class State:
    """Where a model in training stands: its tables and Adagrad's sums, the rows that aren't learned, the labels' weights, and
    the epochs of the whole training."""

    tables: list[np.ndarray]
    seen: list[np.ndarray]
    frozen: list[np.ndarray]
    weights: np.ndarray
    epochs: int


def learn(state: State, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, seed: list[int]) -> list[np.ndarray]:
    """Stochastic gradient descent (Adagrad) from `state`, in place; the pool passes a gradient only to the words where it found
    its maximum. Gives the rows of each table that were changed."""
    model, (seen_filters, seen_bias, seen_unit, seen_offset) = _model(state.tables), _dense(state.seen[2])
    offset = _dense(state.tables[2])[3]
    rng = np.random.default_rng(seed)
    touched_rows = [np.zeros(len(t), bool) for t in state.tables]
    touched_rows[2][:] = True

    def step(array: np.ndarray, seen: np.ndarray, grad: np.ndarray, at=slice(None)) -> None:
        seen[at] += grad**2
        array[at] -= RATE * grad / np.sqrt(seen[at])

    labels = np.array([r[2] for r in rows], np.float32)
    weight = state.weights[labels.astype(np.int64)]
    sizes = np.array([len(r[0]) for r in rows])
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        i = 0
        while i < len(rows):
            part = order[i : i + BATCH]
            part = part[: max(1, int(np.searchsorted(np.cumsum(sizes[part]), STEP_WORDS, "right")))]
            i += len(part)
            seen_words = [rng.random(sizes[j]) < KEEP for j in part]
            w, h = (np.concatenate([rows[j][k][m] for j, m in zip(part, seen_words, strict=True)]) for k in (0, 1))
            places = np.concatenate([[0], np.cumsum([int(m.sum()) for m in seen_words])])
            best, where = model.pooled(w, h, places, trace=True)
            p = 1 / (1 + np.exp(-np.clip(best @ model.unit + offset, -30, 30)))
            d = ((p - labels[part]) * weight[part] / len(part)).astype(np.float32)
            back = d[:, None] * model.unit[None, :] * (best > 0)
            step(model.unit, seen_unit, best.T @ d)
            step(offset, seen_offset, np.array([d.sum()], np.float32))
            step(model.bias, seen_bias, back.sum(0))
            touched, grads = [], []
            for f, width in enumerate(WIDTHS):
                columns = slice(f * FILTERS, (f + 1) * FILTERS)
                t, c = np.nonzero(where[:, columns] >= 0)
                at, g = where[:, columns][t, c], back[:, columns][t, c]
                for k in range(width):
                    x = model.word[w[at + k]] + model.head[h[at + k]]
                    grad = np.zeros((FILTERS, DIM), np.float32)
                    np.add.at(grad, c, g[:, None] * x)
                    touched.append(at + k)
                    grads.append(g[:, None] * model.filters[f][k][:, c].T)
                    step(model.filters[f][k], seen_filters[f][k], grad.T)
            at, g = np.concatenate(touched), np.concatenate(grads)
            for t, ids in enumerate((w, h)):
                live = ~state.frozen[t][ids[at]]
                rows_hit, inverse = np.unique(ids[at][live], return_inverse=True)
                summed = np.zeros((len(rows_hit), DIM), np.float32)
                np.add.at(summed, inverse, g[live])
                step(state.tables[t], state.seen[t], summed, rows_hit)
                touched_rows[t][rows_hit] = True
    return [np.flatnonzero(t) for t in touched_rows]


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of `docs`, and toxic, of each pair of a document outside the held-out fold and its label."""
    rest = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT, F.lit(False))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(rest & F.col("toxic").isin(0, 1)).distinct()
    return docs.filter(rest).join(F.broadcast(known) if known.count() <= BROADCAST_IDS else known, "doc_id")


def _hashed(texts: DataFrame, kind: type) -> DataFrame:
    """doc_id, lang, toxic, w and h (rows of embeddings, as integers of a `kind`) and place (a hash) of each row of `texts`."""

    @trimmed
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w_all, h_all = [], []
            for _, _, data, offsets in steps(batch["text"], STEP_BYTES):
                w, h, places = hashed_words(data, offsets)
                w, h = w.astype(kind), h.astype(kind)
                for a, z in zip(places[:-1], places[1:], strict=True):
                    w_all.append(w[a:z].tobytes())
                    h_all.append(h[a:z].tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["lang"], batch["toxic"], pa.array(w_all, pa.binary()), pa.array(h_all, pa.binary())], names=["doc_id", "lang", "toxic", "w", "h"])

    found = texts.select("doc_id", "lang", "toxic", "text").mapInArrow(words, "doc_id long, lang string, toxic int, w binary, h binary")
    return found.withColumn("place", F.xxhash64("doc_id", "lang", "toxic", "w", "h"))


def sample_of(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame | None:
    """For trials: rows as of `_hashed`, about `sample` of each label by a hash of doc_id (and of the text too where doc_ids
    repeat), written once."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    pairs = _labelled(docs.select("doc_id").distinct(), labels)
    counts = {r["toxic"]: r["count"] for r in pairs.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    place = lambda *columns: F.pmod(F.xxhash64(F.lit("sample"), *columns), F.lit(1_000_000)) / 1_000_000
    below = lambda where, n: where < F.when(F.col("toxic") == 1, sample / n.get(1, 1)).otherwise(sample / n.get(0, 1))
    chosen = F.broadcast(pairs.filter(below(place("doc_id"), counts)))  # distinct pairs: about 2 x sample
    found = {r["toxic"]: r["count"] for r in docs.select("doc_id").join(chosen, "doc_id").groupBy("toxic").count().collect()}
    texts = docs.join(chosen, "doc_id")
    if max(found.values(), default=0) > 2 * sample:  # doc_ids repeat
        texts = texts.filter(below(place("doc_id", "text"), found))
    rows = _hashed(texts, np.int32)
    return materialise(rows.groupBy("place").agg(*(F.first(c).alias(c) for c in rows.columns if c != "place")), "toxicity-sample")


def _dealt(rows: DataFrame, kind: type, shards: int, tasks: int) -> DataFrame:
    """shard, part, lang, toxic, w and h (16 bits a word) of each row once, the shards side by side and in an order that no
    partitioning changes."""

    @trimmed
    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, n = None, None, 0
        for batch in batches:
            keep, parts = [], []
            for i, (shard, *row) in enumerate(zip(*(batch[c].to_pylist() for c in ("shard", "doc_id", "toxic", "place")), strict=True)):
                if shard != now:
                    now, last, n = shard, None, 0
                if row != last:
                    keep.append(i)
                    parts.append(n % PARTS)
                    n += 1
                last = row
            mine = batch.take(pa.array(keep, pa.int64()))
            narrow = [pa.array([np.frombuffer(x.as_buffer(), kind).astype(np.uint16).tobytes() for x in mine[c]], pa.binary()) for c in ("w", "h")]
            yield pa.RecordBatch.from_arrays([mine["shard"], pa.array(parts, pa.int32()), mine["lang"], mine["toxic"], *narrow], names=["shard", "part", "lang", "toxic", "w", "h"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id", "w"), F.lit(shards)))
    ordered = dealt.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "doc_id", "toxic", "place")
    return ordered.mapInArrow(once, "shard long, part int, lang string, toxic int, w binary, h binary")


def _pairs(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Words, first bytes and label of each row."""
    words = ([np.frombuffer(x, np.uint16) for x in batch[c].to_pylist()] for c in ("w", "h"))
    return list(zip(*words, batch["toxic"].to_pylist(), strict=True))


def _counted(dealt: DataFrame) -> pa.Table:
    """kind, lang, at and n: of each part the documents that have a word's row or that of its first bytes (`held`) and the rows
    of each label (`label`); of each language the times of every word's row (`lang`)."""
    every = WORD_ROWS + HEAD_ROWS

    def sent(kind: str, lang: str | None, counts: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.string()), pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["kind", "lang", "at", "n"])

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, label = np.zeros(PARTS * every, np.int64), np.zeros(PARTS * 2, np.int64)
        for batch in batches:
            spoken: dict[str, list[np.ndarray]] = {}
            for (w, h, y), part, lang in zip(_pairs(batch), batch["part"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                held[part * every + np.unique(w).astype(np.int64)] += 1
                held[part * every + WORD_ROWS + np.unique(h).astype(np.int64)] += 1
                label[part * 2 + y] += 1
                if lang is not None:
                    spoken.setdefault(lang, []).append(w)
            for lang, words in spoken.items():
                times = np.bincount(np.concatenate(words), minlength=WORD_ROWS)
                yield sent("lang", lang, times, np.union1d(np.flatnonzero(times), [0]))
        for kind, counts in (("held", held), ("label", label)):
            yield sent(kind, None, counts, np.flatnonzero(counts))

    some = dealt.coalesce(dealt.sparkSession.sparkContext.defaultParallelism)  # each task sends counts of the whole tables
    return some.mapInArrow(count, "kind string, lang string, at long, n long").groupBy("kind", "lang", "at").agg(F.sum("n").alias("n")).toArrow()


def _tasks(fold: int, tasks: int, cores: int) -> int:
    """Tasks that train a state, at most: its share of the cores by the rows that it learns from, and no more than `tasks`. The
    one that learns from all may have two, since Spark runs a union of single partitions as one task."""
    share = cores // PARTS if fold == PARTS else cores * (PARTS - 1) // PARTS**2
    return max(2 if fold == PARTS else 1, min(tasks, share))


def _round(dealt: DataFrame, states: list[State], number: int, rounds: int, tasks: int) -> None:
    """Every shard goes on from the states, in each without the rows of its part; the states then take the averaged changes. The
    epochs are spread over the rounds."""
    context = dealt.sparkSession.sparkContext
    shared = [context.broadcast(s) for s in states]  # tables of fixed size
    schema = "fold int, slice int, ids binary, change binary, times binary"
    slices = [(t, a, min(a + SLICE_ROWS, len(x))) for t, x in enumerate(states[0].tables) for a in range(0, len(x), SLICE_ROWS)]
    columns = [2 * x.shape[1] for x in states[0].tables]

    def row(fold: int, i: int, ids: np.ndarray, change: np.ndarray, times: np.ndarray) -> list[pa.Array]:
        return [pa.array([fold], pa.int32()), pa.array([i], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids.astype(np.int32), change.astype(np.float32), times.astype(np.float32)))]

    names = ["fold", "slice", "ids", "change", "times"]

    def trained(fold: int, count: int) -> DataFrame:
        """The changes of a state, added up over the shards of each of `count` tasks."""
        mine = shared[fold]

        @trimmed
        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base = mine.value
            change = [np.zeros((len(x), n), np.float32) for x, n in zip(base.tables, columns, strict=True)]
            times = [np.zeros(len(x), np.float32) for x in base.tables]
            epochs = base.epochs * (number + 1) // rounds - base.epochs * number // rounds

            def settle(shard: int, rows: list[tuple]) -> None:
                own = replace(base, tables=[x.copy() for x in base.tables], seen=[x.copy() for x in base.seen])
                for t, hit in enumerate(learn(own, rows, epochs, [SEED, number, shard])):
                    change[t][hit] += np.hstack([own.tables[t][hit] - base.tables[t][hit], own.seen[t][hit] - base.seen[t][hit]])
                    times[t][hit] += 1

            now, rows = None, []
            for batch in batches:
                for shard, pair in zip(batch["shard"].to_pylist(), _pairs(batch), strict=True):
                    if shard != now and rows:
                        settle(now, rows)
                        rows = []
                    now = shard
                    rows.append(pair)
            if rows:
                settle(now, rows)
            for i, (t, a, z) in enumerate(slices):
                ids = a + np.flatnonzero(times[t][a:z])
                if len(ids):
                    yield pa.RecordBatch.from_arrays(row(fold, i, ids, change[t][ids], times[t][ids]), names=names)

        return dealt.filter(F.col("part") != fold).select("shard", "toxic", "w", "h").coalesce(count).mapInArrow(train, schema)

    def total(rows: pa.Table) -> pa.Table:
        fold, i = rows["fold"][0].as_py(), rows["slice"][0].as_py()
        t, a, z = slices[i]
        change, times = np.zeros((z - a, columns[t])), np.zeros(z - a)
        for r in rows.to_pylist():
            at = np.frombuffer(r["ids"], np.int32) - a
            change[at] += np.frombuffer(r["change"], np.float32).reshape(len(at), -1)
            times[at] += np.frombuffer(r["times"], np.float32)
        at = np.flatnonzero(times)
        return pa.table(row(fold, i, at + a, change[at], times[at]), names=names)

    # the longest first; each task sends its sums of one state's tables
    counts = {fold: _tasks(fold, tasks, context.defaultParallelism) for fold in reversed(range(len(states)))}
    sums = reduce(DataFrame.unionAll, (trained(*x) for x in counts.items()))
    if max(counts.values()) > ONE_STEP:
        some = F.pmod(F.spark_partition_id(), F.lit(math.isqrt(max(counts.values()))))
        sums = sums.withColumn("some", some).groupBy("fold", "slice", "some").applyInArrow(lambda rows: total(rows), schema)
    for r in sums.groupBy("fold", "slice").applyInArrow(total, schema).collect():  # the tables' size
        state, t = states[r["fold"]], slices[r["slice"]][0]
        at = np.frombuffer(r["ids"], np.int32)
        mean = np.frombuffer(r["change"], np.float32).reshape(len(at), -1) / np.frombuffer(r["times"], np.float32)[:, None]
        half = columns[t] // 2
        state.tables[t][at] += mean[:, :half]
        state.seen[t][at] += mean[:, half:]
    for s in shared:
        s.destroy()


def _responses(dealt: DataFrame, models: list[Model]) -> DataFrame:
    """spoken (the number of the text's language), response (by the model that hasn't seen the row) and toxic of each row."""
    shared = dealt.sparkSession.sparkContext.broadcast(models)

    @trimmed
    def respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            pairs, part = _pairs(batch), batch["part"].to_numpy()
            response, spoken = np.zeros(len(pairs)), np.zeros(len(pairs), np.int32)
            step = np.cumsum([len(w) for w, _, _ in pairs]) // STEP_WORDS
            for p in range(PARTS):
                for s in np.unique(step):
                    mine = np.flatnonzero((part == p) & (step == s))
                    if len(mine):
                        w, h = (np.concatenate([pairs[i][k] for i in mine]) for k in (0, 1))
                        places = np.concatenate([[0], np.cumsum([len(pairs[i][0]) for i in mine])])
                        response[mine], spoken[mine] = models[p].response(w, h, places), models[PARTS].language(w, places)
            yield pa.RecordBatch.from_arrays([pa.array(spoken), pa.array(response), batch["toxic"]], names=["spoken", "response", "toxic"])

    return dealt.mapInArrow(respond, "spoken int, response double, toxic int")


def best_thresholds(responses: DataFrame) -> DataFrame:
    """Of each `spoken`, and of all rows (null), toxic (their number) and threshold: the middle of the gap with the fewest errors;
    above everything if marking nothing errs least. Windows hold a range of the sorted responses at most."""
    each = responses.withColumn("spoken", F.explode(F.array(F.lit(None).cast("int"), F.col("spoken"))))
    gains = each.groupBy("spoken", "response").agg(F.sum(2 * F.col("toxic") - 1).alias("gain"), F.sum("toxic").alias("toxic"))
    parts = max(1, math.ceil(gains.count() / RANGE_ROWS))
    down = F.col("response").desc()
    gains = materialise(gains.repartitionByRange(parts, "spoken", down).withColumn("range", F.spark_partition_id()), "toxicity-gains")
    inside = Window.partitionBy("spoken", "range").orderBy(down)
    ranges = gains.groupBy("spoken", "range").agg(F.sum("gain").alias("total"), F.max("response").alias("first"))
    across = Window.partitionBy("spoken").orderBy("range")  # a row a range
    ranges = ranges.select(F.col("spoken").alias("_spoken"), F.col("range").alias("_range"), (F.sum("total").over(across) - F.col("total")).alias("before"), F.lead("first").over(across).alias("then"))
    run = gains.withColumn("run", F.sum("gain").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("response").over(inside))
    run = run.join(ranges, F.col("spoken").eqNullSafe(F.col("_spoken")) & (F.col("range") == F.col("_range")))
    run = run.withColumn("run", F.col("run") + F.col("before")).withColumn("next", F.coalesce("next", "then"))
    middle = F.when(F.col("next").isNull(), F.col("response") - 1).otherwise((F.col("response") + F.col("next")) / 2)
    best = run.groupBy("spoken").agg(F.max("run").alias("most"), F.max_by(middle, F.struct("run", "response")).alias("middle"), F.max("response").alias("top"), F.sum("toxic").alias("toxic"))
    return best.select("spoken", "toxic", F.when(F.col("most") <= 0, F.col("top") + 1).otherwise(F.col("middle")).alias("threshold"))


def fit(docs: DataFrame, labels: DataFrame, sample: int | None = None) -> Model | None:
    """Learn from all labelled rows outside the held-out fold; `docs`: doc_id, text, lang; `labels`: doc_id, toxic. With
    `sample`, for trials, from about so many rows of each label."""
    with temporary(docs.sparkSession):
        return _fit(docs, labels, sample)


def _fit(docs: DataFrame, labels: DataFrame, sample: int | None) -> Model | None:
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    kind = np.uint16 if sample is None else np.int32
    rows = materialise(_hashed(_labelled(docs, labels), kind), "toxicity-rows") if sample is None else sample_of(docs, labels, sample)
    if rows is None:
        return None
    once = rows.select("place", "toxic", F.octet_length("w").alias("size")).distinct()
    n, size, kinds = once.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.count_distinct("toxic")).first()
    if kinds < 2:
        return None
    shards = max(1, n // SHARD_ROWS, math.ceil(size / np.dtype(kind).itemsize / SHARD_WORDS))
    tasks = min(shards, 16 * spark.sparkContext.defaultParallelism)
    dealt = _dealt(rows, kind, shards, tasks).persist(StorageLevel.DISK_ONLY)
    try:
        return _trained(dealt, shards, tasks)
    finally:
        dealt.unpersist(blocking=True)


def _trained(dealt: DataFrame, shards: int, tasks: int) -> Model | None:
    counts, every = _counted(dealt).to_pandas(), WORD_ROWS + HEAD_ROWS
    held, label = np.zeros((PARTS, every), np.int64), np.zeros((PARTS, 2), np.int64)
    for kind, table in (("held", held), ("label", label)):
        mine = counts[counts["kind"] == kind]
        table.reshape(-1)[mine["at"]] = mine["n"]
    if label.sum() < 2 * PARTS:
        return None
    names = sorted(counts["lang"].dropna().unique()) or [""]
    spoken = np.full((WORD_ROWS, len(names)), 0.1)
    mine = counts[counts["kind"] == "lang"]
    spoken[mine["at"], np.searchsorted(names, mine["lang"].tolist()) if len(mine) else []] += mine["n"]

    states = []
    for fold in range(PARTS + 1):  # the last one learns from all
        rest = np.arange(PARTS) != fold
        # rows of words that few documents have stay zero: they can't mark single documents, and unseen words say nothing
        frozen = np.split(held[rest].sum(0) < LEAST_DOCS, [WORD_ROWS])
        tables = _tables()
        for table, rows in zip(tables, frozen, strict=False):
            table[rows] = 0
        share = label[rest].sum(0) / max(1, label[rest].sum())
        epochs = max(EPOCHS, math.ceil(LEAST_STEPS * BATCH / max(1, int(label[rest].sum()))))
        states.append(State(tables, [np.full(x.shape, 1e-4, np.float32) for x in tables], frozen, (0.5 / np.maximum(share, 1e-6)).astype(np.float32), epochs))
    rounds = 1 if shards == 1 and label.sum() < SHARD_ROWS else EPOCHS
    for i in range(rounds):
        release(dealt.sparkSession)  # shuffle files of the texts, and of the round before
        _round(dealt, states, i, rounds, tasks)

    models = [_model(s.tables) for s in states]
    last = models[PARTS]
    last.languages = np.log(spoken / spoken.sum(0)).astype(np.float32)
    best = {r["spoken"]: r for r in best_thresholds(_responses(dealt, models)).collect()}
    overall = best[None]["threshold"]
    last.thresholds = np.full(len(names), overall)
    for i, r in best.items():
        if i is not None and r["toxic"]:  # few toxic rows move a language's threshold little
            last.thresholds[i] = (r["toxic"] * r["threshold"] + 20 * overall) / (r["toxic"] + 20)
    return last


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of `docs` (with a column text), and score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size
    kept = docs.drop("score", "predicted")
    small_batches(docs.sparkSession)

    @trimmed
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0)]
            for first, end, data, offsets in steps(batch["text"], STEP_BYTES):
                found.append(np.zeros(end - first) if shared.value is None else shared.value.score(*hashed_words(data, offsets)))
            s = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    schema = kept.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return kept.mapInArrow(judge, schema)
