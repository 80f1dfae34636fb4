"""Language-model scoring by a hashed maximum-entropy model.

The model factors a token's probability by its class: P(class | history) times P(token | class, history). Both factors are
softmaxes over hashed features of the words before the token: the last one, the one before it (a skip), and the two
together, each hashed to a row of weights; the rows of the second factor are hashed with the class too. The second softmax
has a slot for each of the class's most frequent words and one for the rest, within which a word has its share of counts,
add one, with a place left for unknown tokens. So the model is a distribution over the known tokens and an unknown one in
each class.

A word's class goes by its last two bytes: the most frequent endings have a class each, the others share some by hash.
The end of a text is a token, and a class of its own.

Biases start from the frequencies of classes and slots in all training documents, all other weights from zero. Weights are trained
by distributed gradient updates. Documents are dealt to shards of about `SHARD_BYTES` by a hash, and in
each round every shard runs Adagrad over its share of the round's training documents, in an order that no partitioning
changes, from the same weights; the changes of each row are averaged over the shards that changed it. Shards, not tasks,
decide what is learned: a layout changes scores by rounding only. All training documents are used, each in one round. The
tables of weights grow with the square root of the training bytes.

Counts cover all training tokens: the most frequent words (of all training documents) add up where they are
read; of the others, each run of texts sends one count a word, so that no word is a hot key.

Defined cases: a null or blank text is the end token alone; a null doc_id is learned from; repeated rows are learned
from and scored each; ties in frequency go to the smaller key; a very long text is scored whole; with no training documents
every score is that of the biases alone and every base score 0; an empty table gives no rows; other columns are ignored. Words are
told apart by 64-bit keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import _LOWER, materialise, mix64, release, split_words, steps, trimmed, word_keys
from riskloom.llm.exchange import exchange, parts_for
from riskloom.llm.langid import held_out

FOLDS, HELD_OUT = 7, 2
CLASSES, OWN, SLOTS = 32, 23, 16
END, REST = CLASSES - 1, SLOTS - 1
ROUNDS, MINI, RATE = 2, 8192, 0.15
HEAD = 2048
STEP_BYTES = 1 << 20
#: Words that a task counts before it hands them on, as far as they don't come together.
HELD_WORDS = 1 << 20
SHARD_BYTES, LEAST_BITS = 16 << 20, 14
#: Tokens or rows of weights that a step goes through at a time, so that they stay in the cache.
BLOCK = 1024
#: Rows of weights that are added up at a time.
SLICE_ROWS = 4096
_END_KEY = np.uint64(0x2545F4914F6CDD1D)
_START_KEY = np.uint64(0xD1342543DE82EF95)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.float32(-1e9)
#: Sums of exponentials that keep their precision as 32-bit numbers.
_LEAST, _MOST = 1e-20, 1e30
FEATURES = 3


def train_row(doc_id: Column) -> Column:
    return ~held_out(doc_id, FOLDS, HELD_OUT)


def tokens(data: np.ndarray, offsets: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and classes of all tokens, the end tokens included, and each text's first token (texts + 1)."""
    starts, ends, cut = split_words(data, offsets)
    words = word_keys(data, starts, ends)
    texts = len(cut) - 1
    first = cut + np.arange(texts + 1)
    keys, classes = np.full(len(words) + texts, _END_KEY), np.full(len(words) + texts, END, np.uint8)
    at = np.arange(len(words)) + np.repeat(np.arange(texts), np.diff(cut))
    keys[at] = words
    if len(words):
        classes[at] = endings[word_endings(data, starts, ends)]
    return keys, classes, first


def word_endings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last two bytes of each word, lower-cased, as a number."""
    low = lambda at: _LOWER[data[at]].astype(np.int64)
    return np.where(ends - starts > 1, low(np.maximum(ends - 2, 0)), 0) * 256 + low(ends - 1)


def histories(keys: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The keys of each token's features: the token before, the one before that, and both."""
    place = np.arange(len(keys)) - np.repeat(first[:-1], np.diff(first))

    def back(k: int) -> np.ndarray:
        moved = np.concatenate([np.full(k, _START_KEY), keys])[: len(keys)]
        moved[place < k] = _START_KEY
        return moved

    one, two = back(1), back(2)
    return [one, two + np.uint64(2), one * _PRIME + two]


def rows_of(features: list[np.ndarray], classes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of weights of both factors: tokens x features."""
    of_class = (classes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    place = lambda key: ((mix64(key) >> np.uint64(20)) & np.uint64(rows - 1)).astype(np.int32)
    return np.stack([place(f) for f in features], 1), np.stack([place(f ^ of_class) for f in features], 1)


@dataclass
class Model:
    """Weights of both factors with their biases (a row for all; a row a class), and the words that are known by place."""

    tables: list[np.ndarray]  # class, class bias, slot, slot bias
    endings: np.ndarray  # the class of each ending
    head: np.ndarray  # sorted keys
    head_class: np.ndarray
    head_slot: np.ndarray  # the last one of head_class and of head_slot is the end token's

    @property
    def rows(self) -> int:
        return len(self.tables[0])

    def slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's place among the head words (-1: none) and its slot."""
        place = head_places(keys, self.head)
        return place, np.where(place >= 0, self.head_slot[place], REST)

    def places(self, keys: np.ndarray, classes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """The rows of each table, tokens x features."""
        one, two = rows_of(histories(keys, first), classes, self.rows)
        return [one, np.zeros((len(keys), 1), np.int32), two, classes.astype(np.int32)[:, None]]


def exponentials(tables: list[np.ndarray], at: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all outputs the summed weights and their exponentials (tokens x outputs), and each token's sum of these."""
    z = tables[1].take(at[1][:, 0], axis=0)
    for k in range(at[0].shape[1]):
        z += tables[0].take(at[0][:, k], axis=0)
    ones = np.ones(z.shape[1], z.dtype)
    with np.errstate(over="ignore"):
        e = np.exp(z)
        total = e @ ones
    if len(z) and not (total.min() > _LEAST and total.max() < _MOST):  # the greatest is taken off only where it matters
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        total = e @ ones
    return z, e, total


def log_probability(tables: list[np.ndarray], at: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The natural log probability of output `y` of each token."""
    z, _, total = exponentials(tables, at)
    return z[np.arange(len(y)), y].astype(np.float64) - np.log(total)


def sorted_places(flat: np.ndarray) -> np.ndarray:
    """A stable argsort of row numbers, sixteen bits at a time."""
    order = np.argsort(flat.astype(np.uint16), kind="stable")
    high = (flat >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def segment_sums(rows: np.ndarray, of: np.ndarray, first: np.ndarray, lengths: np.ndarray, many: int = 64) -> np.ndarray:
    """The sums of the rows that runs of `of` name, longest run first: short runs side by side, long ones one by one."""
    out = rows.take(of[first], axis=0)
    long = int(np.searchsorted(-lengths, -many, "left"))
    for i in range(long):
        out[i] = rows.take(of[first[i] : first[i] + lengths[i]], axis=0).sum(0)
    k, more = 1, int(np.searchsorted(-lengths, -1, "left"))
    while more > long:
        out[long:more] += rows.take(of[first[long:more] + k], axis=0)
        k += 1
        more = int(np.searchsorted(-lengths, -k, "left"))
    return out


def put_rows(table: np.ndarray, hit: np.ndarray, rows: np.ndarray) -> None:
    """table[hit] = rows, a row at a time as one item."""
    whole = f"V{table.itemsize * table.shape[1]}"
    table.view(whole).ravel()[hit] = rows.view(whole).ravel()


class Learner:
    """One table in training: Adagrad from given weights, and the sum of the changes of the shards gone through."""

    def __init__(self, weights: np.ndarray):
        self.base, self.weights = weights, weights.copy()
        self.seen, self.touched = np.full(weights.shape, 0.1, np.float32), np.zeros(len(weights), bool)
        self.change, self.times = np.zeros(weights.shape, np.float32), np.zeros(len(weights), np.float32)

    def update(self, at: np.ndarray, d: np.ndarray) -> None:
        """A step against the gradient `d` (tokens x outputs) of the rows `at` (tokens x features)."""
        flat = at.ravel()
        order = sorted_places(flat)
        flat = flat[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        lengths = np.diff(np.append(first, len(flat)))
        longest = np.argsort(-np.minimum(lengths, 1 << 15).astype(np.int16), kind="stable")
        first, lengths, of = first[longest], lengths[longest], order // at.shape[1]
        hit, scale = flat[first], (1 / np.sqrt(lengths)).astype(np.float32)[:, None]
        for i in range(0, len(hit), BLOCK):
            here, part = hit[i : i + BLOCK], slice(i, i + BLOCK)
            g = segment_sums(d, of, first[part], lengths[part])
            g *= scale[part]
            seen = self.seen.take(here, axis=0)
            seen += g * g
            put_rows(self.seen, here, seen)
            np.sqrt(seen, out=seen)
            g *= np.float32(RATE)
            g /= seen
            put_rows(self.weights, here, self.weights.take(here, axis=0) - g)
        self.touched[hit] = True

    def settle(self) -> None:
        """A shard ends: keep its changes, and start again from the given weights."""
        hit = np.flatnonzero(self.touched)
        self.change[hit] += self.weights[hit] - self.base[hit]
        self.times[hit] += 1
        self.weights[hit], self.seen[hit], self.touched[hit] = self.base[hit], 0.1, False


def learn_batch(learners: list[Learner], at: list[np.ndarray], classes: np.ndarray, slots: np.ndarray) -> None:
    weights = [x.weights for x in learners]
    for i in range(0, len(classes), MINI):
        part = slice(i, i + MINI)
        for f, y in ((0, classes[part]), (2, slots[part])):
            here = [a[part] for a in at[f : f + 2]]
            d = np.empty((len(y), weights[f].shape[1]), np.float32)
            for a in range(0, len(y), BLOCK):
                _, e, total = exponentials(weights[f : f + 2], [x[a : a + BLOCK] for x in here])
                np.divide(e, total[:, None], out=d[a : a + BLOCK])
            d[np.arange(len(y)), y] -= 1
            for learner, rows in zip(learners[f : f + 2], here, strict=True):
                learner.update(rows, d)


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, a place at which each stands, and the place of each given key among them."""
    order = np.argsort(keys)
    keys = keys[order]
    begins = np.ones(len(keys), bool)
    begins[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(begins)
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(begins) - 1
    return keys[first], order[first], inverse


def tally(keys: np.ndarray, endings: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words (a key has one ending) and how often each comes; `n`: how often each given one stands for."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    times = np.diff(np.append(first, len(keys))) if n is None else np.add.reduceat(n[order], first)
    return keys[first], endings[order[first]], times


def _tallied(words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    keys, endings, n = words
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(endings), pa.array(n)], names=["key", "ending", "n"])


@trimmed
def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word comes, as far as HELD_WORDS lets a task count before it hands on."""
    found, held = [], 0
    for batch in batches:
        for _, _, data, offsets in steps(batch["text"], STEP_BYTES):
            starts, ends, _ = split_words(data, offsets)
            if len(starts):
                found.append(tally(word_keys(data, starts, ends), word_endings(data, starts, ends)))
                held += len(found[-1][0])
            if held > HELD_WORDS:
                found = [tally(*map(np.concatenate, zip(*found, strict=True)))]
                held = len(found[0][0])
                if held > HELD_WORDS // 2:
                    yield _tallied(found[0])
                    found, held = [], 0
    if found:
        yield _tallied(tally(*map(np.concatenate, zip(*found, strict=True))))


def _start(docs: DataFrame, rows: int) -> Model:
    """A model with biases only. From all documents: the most frequent words, their classes and slots, the class of every
    ending, and how frequent classes and slots are."""
    n_docs = docs.count()

    words = docs.select("text").mapInArrow(count_words, "key long, ending long, n long")
    counts = materialise(words.groupBy("key", "ending").agg(F.sum("n").alias("n")), "words")
    frequent = counts.orderBy(F.col("n").desc(), "key").limit(HEAD).collect()
    endings = counts.groupBy("ending").agg(F.sum("n").alias("n")).collect()  # at most 65,536
    ranked = [r["ending"] for r in sorted(endings, key=lambda r: (-r["n"], r["ending"]))[:OWN]]
    classes = OWN + np.arange(1 << 16) * 2654435761 % (1 << 32) % (END - OWN)
    classes[ranked] = np.arange(len(ranked))
    taken, place = np.zeros(CLASSES, np.int64), {}
    of_class, of_slot = np.ones(CLASSES), np.ones((CLASSES, SLOTS))
    of_class[END] += n_docs
    for r in endings:
        of_class[classes[r["ending"]]] += r["n"]
    for r in frequent:
        c = int(classes[r["ending"]])
        slot = min(int(taken[c]), REST)
        place[r["key"]] = (c, slot)
        taken[c] += 1
        if slot < REST:
            of_slot[c, slot] += r["n"]
    head = np.sort(np.array(list(place), np.int64).view(np.uint64))
    of_head = [*(place[k] for k in head.view(np.int64).tolist()), (END, 0)]
    taken[END] = 1
    of_slot[:, REST] = np.maximum(of_class - of_slot[:, :REST].sum(1), 1)
    slot_bias = np.log(of_slot / of_slot.sum(1, keepdims=True)).astype(np.float32)
    for c in range(CLASSES):
        slot_bias[c, min(int(taken[c]), REST) : REST] = _NEVER  # slots of no word
    slot_bias[END, 0], slot_bias[END, 1:] = 0, _NEVER
    class_bias = np.log(of_class / of_class.sum()).astype(np.float32)[None, :]
    tables = [np.zeros((rows, CLASSES), np.float32), class_bias, np.zeros((rows, SLOTS), np.float32), slot_bias]
    return Model(tables, classes.astype(np.uint8), head, np.array([c for c, _ in of_head], np.int64), np.array([s for _, s in of_head], np.int64))


def _slices(shapes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(table, first row, end row) of what is added up at a time."""
    return [(t, a, min(a + SLICE_ROWS, rows)) for t, (rows, _) in enumerate(shapes) for a in range(0, rows, SLICE_ROWS)]


def _round(docs: DataFrame, model: Model, shards: int) -> tuple[list[np.ndarray], np.ndarray]:
    """One round of updates (`docs`: doc_id and text): the new tables, and the counts of the head words (last: ends)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # grows with the square root of the corpus
    slices = _slices([t.shape for t in model.tables])

    @trimmed
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        learners, counts, now = [Learner(t) for t in model.tables], np.zeros(len(model.head) + 1, np.int64), None
        for batch in batches:
            shard = batch["shard"].to_numpy()
            for cut in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
                if not len(cut):
                    continue
                if now is not None and shard[cut[0]] != now:
                    for x in learners:
                        x.settle()
                now = shard[cut[0]]
                for _, _, data, offsets in steps(batch["text"].slice(int(cut[0]), len(cut)), STEP_BYTES):
                    keys, classes, first = tokens(data, offsets, model.endings)
                    place, slots = model.slots(keys)
                    learn_batch(learners, model.places(keys, classes, first), classes, slots)
                    counts += np.bincount(place[place >= 0], minlength=len(counts))
        if now is not None:
            for x in learners:
                x.settle()
            for i, (t, a, z) in enumerate(slices):
                blobs = [learners[t].change[a:z].tobytes(), learners[t].times[a:z].tobytes(), counts.tobytes() if i == 0 else b""]
                yield pa.RecordBatch.from_arrays([pa.array([i]), *(pa.array([x]) for x in blobs)], names=["slice", "change", "times", "counts"])

    schema = "slice long, change binary, times binary, counts binary"
    kinds = {"change": np.float32, "times": np.float32, "counts": np.int64}

    def total(rows: pa.Table) -> pa.Table:
        blobs = []
        for c, kind in kinds.items():
            sum_ = 0
            for x in rows[c]:
                sum_ = sum_ + np.frombuffer(x.as_py(), kind).astype(np.float64 if kind is np.float32 else kind)
            blobs.append(pa.array([sum_.astype(kind).tobytes()], pa.binary()))
        return pa.table([rows["slice"][:1], *blobs], names=["slice", *kinds])

    tasks = min(shards, 16 * spark.sparkContext.defaultParallelism)
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id", "text"), F.lit(shards)))
    ordered = dealt.repartition(tasks, "shard").sortWithinPartitions("shard", "doc_id", F.xxhash64("text"))
    changes = ordered.select("shard", "text").mapInArrow(learn, schema)
    part = F.pmod(F.spark_partition_id(), F.lit(max(1, math.isqrt(tasks))))  # changes are added up in two steps
    some = changes.withColumn("part", part).groupBy("slice", "part").applyInArrow(lambda rows: total(rows), schema)
    found = sorted(some.groupBy("slice").applyInArrow(total, schema).collect(), key=lambda r: r["slice"])  # the tables' size
    tables, counts = [t.copy() for t in model.tables], np.zeros(len(model.head) + 1, np.int64)
    for r in found:
        t, a, z = slices[r["slice"]]
        times = np.maximum(np.frombuffer(r["times"], np.float32), 1)[:, None]
        tables[t][a:z] += np.frombuffer(r["change"], np.float32).reshape(z - a, -1) / times
        if r["slice"] == 0:
            counts = np.frombuffer(r["counts"], np.int64)
    return tables, counts


def head_places(keys: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Each token's place among the head words, their number for the end token, -1 for others."""
    place = np.full(len(keys), -1, np.int64)
    if len(head):
        at = np.minimum(np.searchsorted(head, keys), len(head) - 1)
        place = np.where(head[at] == keys, at, -1)
    place[keys == _END_KEY] = len(head)
    return place


def train(docs: DataFrame) -> tuple[Model, np.ndarray]:
    """The model of all `docs` (doc_id and text), and the counts of its head words (last: the end token)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_BITS, math.ceil(math.log2(2 * math.sqrt(size) + 1)))
    model = _start(docs, 1 << bits)
    release(docs.sparkSession)  # the words counted
    shards = max(1, math.ceil(size / ROUNDS / SHARD_BYTES))
    counts = np.zeros(len(model.head) + 1, np.int64)
    for i in range(ROUNDS):
        mine = docs.filter(F.pmod(F.xxhash64(F.lit("round"), F.col("doc_id")), F.lit(ROUNDS)) == i)
        model.tables, more = _round(mine, model, shards)
        counts = counts + more
        release(docs.sparkSession)  # the texts dealt to shards
    return model, counts


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs` (doc_id and text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(docs, *train(docs.filter(train_row(F.col("doc_id")))))


def score(docs: DataFrame, model: Model, counts: np.ndarray) -> DataFrame:
    """Score all documents; words that aren't head words are counted on the way, in the training documents."""
    shared = docs.sparkSession.sparkContext.broadcast((model, counts))

    def deal(batch: pa.RecordBatch):
        model, counts = shared.value
        logs = np.log10(counts + 1.0)
        train = batch["train"].to_numpy(zero_copy_only=False)
        rare, rare_row, rare_class = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint8)]
        found = {c: [] for c in ("n", "known", "sum", "rest", "term")}
        hists = [np.zeros(0, np.int32)]
        for row, _, data, offsets in steps(batch["text"], STEP_BYTES):
            keys, classes, first = tokens(data, offsets, model.endings)
            texts = len(first) - 1
            owner = np.repeat(np.arange(texts), np.diff(first))
            place, slots = model.slots(keys)
            at = model.places(keys, classes, first)
            term = np.zeros(len(keys))
            for i in range(0, len(keys), BLOCK):
                part = slice(i, i + BLOCK)
                here = [a[part] for a in at]
                term[part] = log_probability(model.tables[:2], here[:2], classes[part]) + log_probability(model.tables[2:], here[2:], slots[part])
            in_head, rest = place >= 0, slots == REST
            log = np.where(in_head, logs[place], 0.0)
            found["n"].append(np.diff(first))
            found["known"].append(np.bincount(owner[in_head], counts[place[in_head]] > 0, texts))
            found["sum"].append(np.bincount(owner, log, texts))
            found["rest"].append(np.bincount(owner, np.where(rest, log, 0.0), texts))
            found["term"].append(np.bincount(owner, term, texts) / np.log(10))
            hists.append(np.bincount(owner[rest] * CLASSES + classes[rest], minlength=texts * CLASSES).astype(np.int32))
            rare.append(keys[~in_head])
            rare_row.append((owner[~in_head] + row).astype(np.uint32))
            rare_class.append(classes[~in_head])
        rare, rare_row, rare_class = map(np.concatenate, (rare, rare_row, rare_class))
        distinct, one, inverse = distinct_keys(rare)
        times = np.bincount(inverse, train[rare_row], len(distinct)).astype(np.uint64)
        types = {"n": np.int64, "known": np.int64, "sum": float, "rest": float, "term": float}
        columns = [pa.array(np.concatenate([np.zeros(0), *found[c]]).astype(t)) for c, t in types.items()]
        own = pa.table([batch["doc_id"], batch["train"], *columns, pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(hists)), CLASSES)], names=["doc_id", "train", *types, "hist"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema) as writer:
            writer.write_table(own)
        of_row = np.bincount(rare_row, minlength=len(own)).astype(np.uint32)  # tokens stand in the order of their rows
        narrow = len(distinct) <= 1 << 16
        links = np.array([len(rare), narrow, len(own)], np.int64).tobytes() + of_row.tobytes() + inverse.astype(np.uint16 if narrow else np.uint32).tobytes()
        return distinct, np.arange(len(distinct), dtype=np.uint32), times << np.uint64(8) | rare_class[one].astype(np.uint64), links + sink.getvalue().to_pybytes()

    def answer(keys: np.ndarray, extra: np.ndarray):
        order = np.argsort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        times = np.add.reduceat((extra[order] >> np.uint64(8)).astype(np.int64), first)
        count = np.empty(len(keys), np.int64)
        count[order] = np.repeat(times, np.diff(np.append(first, len(keys))))
        kinds = (extra[order][first] & np.uint64(255)).astype(np.int64)
        totals = np.stack([np.bincount(kinds, times, CLASSES), np.bincount(kinds, times > 0, CLASSES)]).astype(np.int64)
        return count > 0, np.minimum(count, 2**32 - 1), totals.tobytes()

    schema = "doc_id long, train boolean, n long, known long, sum double, rest double, term double, hist array<int>, totals binary"
    names = ["doc_id", "train", "n", "known", "sum", "rest", "term", "hist", "totals"]

    def gather(own: bytes, at: np.ndarray, _, values: np.ndarray) -> pa.Table:
        n, narrow, texts = np.frombuffer(own, np.int64, 3).tolist()
        row = np.repeat(np.arange(texts), np.frombuffer(own, np.uint32, texts, 24))
        inverse = np.frombuffer(own, np.uint16 if narrow else np.uint32, n, 24 + 4 * texts)
        rows = pa.ipc.open_stream(own[24 + 4 * texts + (2 if narrow else 4) * n :]).read_all()
        count = np.zeros(int(inverse.max()) + 1 if n else 0)
        count[at] = values
        count = count[inverse]
        log = np.bincount(row, np.log10(count + 1.0), len(rows))
        known = rows["known"].to_numpy() + np.bincount(row, count > 0, len(rows)).astype(np.int64)
        columns = [rows["doc_id"], rows["train"], rows["n"], pa.array(known), pa.array(rows["sum"].to_numpy() + log), pa.array(rows["rest"].to_numpy() + log), rows["term"], rows["hist"].cast(pa.list_(pa.int32())), pa.nulls(len(rows), pa.binary())]
        return pa.table(columns, names=names)

    def add_up(blobs: list[bytes]) -> pa.Table:
        total = np.sum([np.frombuffer(b, np.int64) for b in blobs], axis=0)
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int32()))
        return pa.table([*(pa.nulls(1, t) for t in types), pa.array([total.tobytes()], pa.binary())], names=names)

    dealt = docs.withColumn("train", train_row(F.col("doc_id")))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = exchange(dealt, parts_for(size // 32), deal, answer, gather, schema, np.uint32, add_up, extra_type=np.uint64)
    rows = materialise(rows, "scores")
    all_classes, rest_classes = np.zeros((2, CLASSES), np.int64), np.zeros((2, CLASSES), np.int64)
    for r in rows.filter("totals is not null").select("totals").collect():  # at most 64
        rest_classes += np.frombuffer(r["totals"], np.int64).reshape(2, CLASSES)
    all_classes += rest_classes
    for c, slot, n in zip(model.head_class, model.head_slot, counts, strict=True):
        all_classes[:, c] += (n, int(n > 0))
        if slot == REST:
            rest_classes[:, c] += (n, int(n > 0))
    total, words = int(all_classes[0].sum()), int(all_classes[1].sum())
    below = [float(np.log10(n + v + 1.0)) for n, v in rest_classes.T]
    shares = F.aggregate(F.zip_with("hist", F.array(*map(F.lit, below)), lambda n, b: n * b), F.lit(0.0), lambda x, y: x + y)
    return rows.filter("totals is null").select(
        "doc_id", (~F.col("train")).alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("sum") - F.col("n") * float(np.log10(total + words + 1.0))).alias("base_score"), (F.col("term") + F.col("rest") - shares).alias("score"),
    )
