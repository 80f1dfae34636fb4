"""Removal of long byte strings that an earlier document has too, by suffix arrays.

A byte goes if it lies in a string of `WIDTH` bytes that also starts in a document with a smaller doc_id.

Suffixes are sorted by the difference-cover method: the suffixes at places that aren't multiples of three are named by the
sort of their first three letters; while names repeat, the string of names is sorted the same way; the remaining suffixes are
then sorted by their first letter and the rank of the next, and merged in. All suffixes are named, but only the starts of
windows, and places that their order rests on, are ranked and merged. Neighbours in that order that share their first
`WIDTH` bytes are copies of one string, and the least doc_id of such a group decides for all of it.

The sort is distributed by content. Each window of `WIDTH` bytes has a key, the least hash of the `GRAM`-byte strings in it;
equal windows have equal keys, and neighbouring windows mostly share theirs. A first exchange of keys finds those of one
document only, whose windows can't match and are done. Runs of windows of one key are strings that are dealt to parts by
key; a part sorts all suffixes of its distinct strings and answers each string with one bit a window. Windows of a key that
very many strings hold (`HOT`) are dealt one by one, by a digest of the window, so that no key fills a part. Within a run of
texts (a batch) a string is posted once, with its least doc_id, so that copies, however many, meet as one string a batch.

Defined cases: a null text is an empty one, with nothing to remove; texts shorter than the width stay whole; rows with
one doc_id are documents that remove nothing from each other; a null doc_id neither removes nor is removed; ties can't
arise, and repeated rows fare alike; a very long text is a batch of its own; an empty table gives no rows; columns other than
doc_id and text are ignored. Strings are judged on the input, so that the result doesn't depend on what else is removed.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import _KEYS, _powers, materialise, mix64, small_batches, steps, text_bytes, trim, trimmed
from riskloom.llm.exchange import POSTINGS, ROWS, packed_keys, parts_for, unpacked_keys

WIDTH, GRAM = 50, 16
#: Bytes of text of a batch.
BATCH = 8 << 20
#: Windows of one string at most, and bytes that are hashed at a time.
RUN, STEP = 64, 64 << 10
#: Keys up to which names come from a table of all of them.
TABLE = 1 << 22
#: Strings of one key beyond which its windows are dealt one by one.
HOT = 20_000
#: Bytes of text for which there is a part, in the exchange of strings.
PART_TEXT = 2 << 20
_ROWS_SCHEMA = "part long, batch long, kind int, a binary, b binary, c binary"
_ROWS_ARROW = pa.schema([("part", pa.int64()), ("batch", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _packed(*columns: np.ndarray) -> np.ndarray:
    """One integer for each row, in the order of the rows; none of the columns has negative numbers."""
    key = columns[0].astype(np.int64)
    for column in columns[1:]:
        size = int(column.max(initial=0)) + 1
        if int(key.max(initial=0)) >= (1 << 63) // size - 1:
            key = np.unique(key, return_inverse=True)[1]
        key *= size
        key += column
    return key


def _names(key: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The rank of each key among the distinct ones, from 1; and the order of the keys, if no two are equal."""
    most = int(key.max())
    if most < TABLE:  # few possible keys: count them instead of sorting
        there = np.zeros(most + 1, np.int32)
        there[key] = 1
        return np.cumsum(there, dtype=np.int32)[key], None
    order = np.argsort(key)
    inorder = key[order]
    fresh = np.concatenate([[True], inorder[1:] != inorder[:-1]])
    names = np.empty(len(key), np.int32)
    names[order] = np.cumsum(fresh, dtype=np.int32)
    return names, order if fresh.all() else None


def suffix_array(letters: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """The starts of all suffixes, or of those at `wanted` places (a flag a letter), in their order, by a difference cover of
    period three. Letters are 1 or more."""
    n = len(letters)
    if n < 4:
        return np.array(sorted((i for i in range(n) if wanted is None or wanted[i]), key=lambda i: letters[i:].tolist()), np.int64)
    s = np.zeros(n + 4, np.int32)
    s[:n] = letters
    end = n + (n % 3 == 1)  # the place after the end keeps the last of the first class apart from the second class
    sample = np.concatenate([np.arange(1, end, 3, dtype=np.int32), np.arange(2, end, 3, dtype=np.int32)])
    names, order = _names(_packed(*(np.concatenate([s[1 + i : end + i : 3], s[2 + i : end + i : 3]]) for i in range(3))))
    needed = None
    if wanted is not None:  # the order of a place rests on that of the sample's places among it and the next two
        near = np.zeros(n + 4, bool)
        for ahead in range(3):
            near[ahead : n + ahead] |= wanted
        needed = np.concatenate([near[1:end:3], near[2:end:3]])
    if order is None:
        order = suffix_array(names, needed)
    elif needed is not None:
        order = order[needed[order]]
    sampled = sample[order]
    rank = np.zeros(n + 4, np.int32)
    rank[sampled] = np.arange(1, len(order) + 1, dtype=np.int32)
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3, dtype=np.int32)
    if wanted is not None:
        sampled, rest = sampled[wanted[sampled]], rest[wanted[::3]]
    rest = rest[np.argsort(_packed(s[rest], rank[rest + 1]))]
    # where the rest falls among the first and the second class
    place = np.arange(len(rest))
    for which, ahead in ((1, 1), (2, 2)):
        some = sampled[sampled % 3 == which]
        both = np.concatenate([some, rest])
        key = _packed(*(s[both + i] for i in range(ahead)), rank[both + ahead])
        place += np.searchsorted(key[: len(some)], key[len(some) :])
    out, free = np.empty(len(sampled) + len(rest), np.int64), np.ones(len(sampled) + len(rest), bool)
    out[place], free[place] = rest, False
    out[free] = sampled
    return out


def window_keys(data: np.ndarray, width: int, gram: int, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of `width` bytes have another key than the window before, and these keys: the least hash of the strings
    of `gram` bytes in the window, as far as the mask goes."""
    n = len(data) - width + 1
    places, keys, before = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], None
    for at in range(0, n, STEP):
        part = data[at : at + STEP + width - 1]
        up, down = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_KEYS[part] * up[:-1], out=total[1:])
        grams = len(part) - gram + 1
        least = mix64((total[gram:] - total[:-gram]) * down[:grams])
        span, wanted = 1, width - gram + 1
        while span < wanted:
            step = min(span, wanted - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        least &= np.uint64(mask)
        fresh = np.empty(len(least), bool)
        fresh[0] = before is None or least[0] != before
        np.not_equal(least[1:], least[:-1], out=fresh[1:])
        some = np.flatnonzero(fresh)
        places.append(some + at)
        keys.append(least[some])
        before = least[-1]
    return np.concatenate(places), np.concatenate(keys)


class Runs:
    """Runs of windows of one key in the texts of a batch: starts, numbers of windows, rows and keys."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: pa.Array, width: int, gram: int, mask: int):
        places, keys = window_keys(data, width, gram, mask)
        usable = np.where(np.asarray(ids.is_valid()), np.diff(offsets) - width + 1, 0)
        some = np.flatnonzero(usable > 0)
        edges = np.sort(np.concatenate([places, offsets[some], offsets[some] + usable[some]]), kind="stable")
        edges = edges[np.diff(edges, append=len(data)) > 0]  # each once
        rows = np.searchsorted(offsets, edges, "right") - 1
        inside = edges - offsets[rows] < usable[rows]
        runs = np.diff(edges, append=len(data))[inside]
        edges, rows = edges[inside], rows[inside]
        keys = keys[np.searchsorted(places, edges, "right") - 1]
        pieces = -(-runs // RUN)
        which = np.repeat(np.arange(len(edges)), pieces)
        place = _within(pieces) * RUN
        self.starts = edges[which] + place
        self.windows = np.minimum(RUN, runs[which] - place)
        self.keys, self.rows = keys[which], rows[which]


def _ipc(table: pa.Table, level: int = 3) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _read(raw: bytes) -> pa.Table:
    with pa.ipc.open_stream(raw) as reader:
        return reader.read_all().combine_chunks()


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def least_docs(strings: list[bytes], docs: np.ndarray, width: int) -> np.ndarray:
    """For all windows of distinct strings in turn, the least doc of the strings that hold the window anywhere."""
    flat = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    lengths = np.array([len(x) for x in strings], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    used = np.zeros(256, np.int32)
    used[flat] = 1
    letters = (np.cumsum(used, dtype=np.int32) + 1)[flat]
    letters[ends] = 1
    at = np.full(len(flat), -1, np.int64)
    windows = lengths - width + 1
    firsts = np.repeat(ends - lengths, windows) + _within(windows)
    at[firsts] = np.arange(len(firsts))
    order = suffix_array(letters, at >= 0)
    view = np.lib.stride_tricks.sliding_window_view(flat, width)
    fresh = np.ones(len(order), bool)
    for some in range(0, len(order) - 1, 8_000):
        here = view[order[some : some + 8_001]]
        fresh[some + 1 : some + len(here)] = (here[1:] != here[:-1]).any(axis=1)
    of = np.repeat(docs, windows)[at[order]]
    starts = np.flatnonzero(fresh)
    least = np.minimum.reduceat(of, starts) if len(starts) else of
    out = np.empty(len(firsts), np.int64)
    out[at[order]] = least[np.cumsum(fresh) - 1]
    return out


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROWS_ARROW)], schema=_ROWS_ARROW)


def _slices(inorder: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where each run of equal numbers starts and ends."""
    return itertools.pairwise(np.append(np.flatnonzero(np.diff(inorder, prepend=-1)), len(inorder)).tolist())


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def batches(docs: DataFrame) -> DataFrame:
    """Documents by runs of some megabytes, written once: batch (its number) and own (ids and texts, compressed). `docs`: doc_id, text."""

    def dealt(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 32, 0
        for whole in found:
            for row, end, *_ in steps(whole["text"], BATCH):
                part = whole.slice(row, end - row)
                own = _ipc(pa.table([part["doc_id"], part["text"].cast(pa.large_string())], names=["doc_id", "text"]), 6)
                yield pa.RecordBatch.from_arrays([pa.array([task + number], pa.int64()), pa.array([own], pa.large_binary())], names=["batch", "own"])
                number += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialise(rows.mapInArrow(trimmed(dealt), "batch long, own binary"), "suffix-batches")


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, result: tuple[str, Callable[[bytes], object]] = ("kept binary", bytes)) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of the maximal removed runs of bytes) and what `result` makes of the remaining
    bytes, under its name and type; by default, these bytes."""
    small_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    postings = 2 * total // (width - gram + 2)
    key_parts, parts = parts_for(postings), max(1, -(-total // PART_TEXT))
    key_bytes = min(8, 1 + (max(postings, 1).bit_length() + 7) // 8)
    mask = (1 << 8 * key_bytes) - 1
    name, kind = result[0].split()
    made = pa.string() if kind == "string" else pa.binary()
    held = batches(docs)

    def own_of(raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        table = _read(raw)
        return _one(table["doc_id"]), *text_bytes(table["text"])

    @trimmed
    def post(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each batch's distinct keys by part, with the number of strings and whether several documents have it."""
        for one in found:
            for batch, raw in zip(one["batch"].to_pylist(), one["own"], strict=True):
                ids, data, offsets = own_of(raw.as_py())
                runs = Runs(data, offsets, ids, width, gram, mask)
                order = np.lexsort((runs.rows, runs.keys))
                keys, of = runs.keys[order], runs.rows[order]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
                counts = np.diff(np.append(first, len(keys)))
                several = of[first] != of[first + counts - 1] if len(first) else first > 0
                extra = (np.minimum(counts, 0x7FFF) | np.where(several, 0x8000, 0)).astype(np.uint16)
                part = (keys[first] % np.uint64(key_parts)).astype(np.int64)
                by_part = np.argsort(part, kind="stable")
                out = []
                for a, z in _slices(part[by_part]):
                    some = by_part[a:z]
                    out.append((int(part[some[0]]), batch, POSTINGS, packed_keys(keys[first][some], key_bytes), extra[some].tobytes(), None))
                yield from _rows(out).to_batches()

    def shared(posted: pa.Table) -> pa.Table:
        """The keys of several documents, for each batch that has them: 1, or 2 if very many strings have the key."""
        blobs = [x.as_py() for x in posted["a"]]
        keys, extra = unpacked_keys(b"".join(blobs), key_bytes), np.frombuffer(b"".join(x.as_py() for x in posted["b"]), np.uint16)
        order = np.argsort(keys)
        inorder, counted = keys[order], extra[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], inorder[1:] != inorder[:-1]])[: len(keys)])
        times = np.diff(np.append(first, len(keys)))
        strings, several = np.add.reduceat(counted & 0x7FFF, first), np.maximum.reduceat(counted, first) >= 0x8000
        values = np.empty(len(keys), np.uint8)
        values[order] = np.repeat(np.where((times > 1) | several, np.where(strings > hot, 2, 1), 0), times)
        out, at = [], 0
        for batch, blob in zip(posted["batch"].to_pylist(), blobs, strict=True):
            here = slice(at, at + len(blob) // key_bytes)
            at, some = here.stop, values[here] > 0
            out.append((0, batch, POSTINGS, packed_keys(keys[here][some], key_bytes), values[here][some].tobytes(), None))
        trim()
        return _rows(out)

    def strings_of(own: pa.Table, answers: pa.Table) -> pa.Table:
        """A batch's distinct strings of shared keys by part, each with its least document, and where they stand."""
        batch = own["batch"][0].as_py()
        ids, data, offsets = own_of(own["own"][0].as_py())
        runs = Runs(data, offsets, ids, width, gram, mask)
        keys = unpacked_keys(b"".join(x.as_py() for x in answers["a"]), key_bytes)
        values = np.frombuffer(b"".join(x.as_py() for x in answers["b"]), np.uint8)
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        found = np.minimum(np.searchsorted(keys, runs.keys), max(len(keys) - 1, 0))
        value = np.where(keys[found] == runs.keys, values[found], 0) if len(keys) else np.zeros(len(runs.keys), np.uint8)
        plain, single = value == 1, value == 2  # runs of windows, or the windows of hot keys one by one
        each = runs.windows[single]
        starts = np.concatenate([runs.starts[plain], np.repeat(runs.starts[single], each) + _within(each)])
        windows = np.concatenate([runs.windows[plain], np.ones(int(each.sum()), np.int64)])
        rows = np.concatenate([runs.rows[plain], np.repeat(runs.rows[single], each)])
        part = (runs.keys[plain] % np.uint64(parts)).astype(np.int64).tolist()
        text = data.tobytes()
        spelled = [text[a : a + w + width - 1] for a, w in zip(starts.tolist(), windows.tolist(), strict=True)]
        part += [xxhash.xxh3_64_intdigest(x) % parts for x in spelled[len(part) :]]
        docs_of = np.asarray(ids.fill_null(0))[rows] if len(rows) else np.zeros(0, np.int64)
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(x, len(number)) for x in spelled], np.int64)
        strings = list(number)
        least = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(least, which, docs_of)
        part_of = np.zeros(len(strings), np.int64)
        part_of[which] = part
        key_of = np.zeros(len(strings), np.uint64)
        key_of[which] = np.concatenate([runs.keys[plain], np.repeat(runs.keys[single], each)])
        by_part = np.lexsort((key_of, part_of))  # strings of one key are alike, which makes them small
        turn = np.empty(len(strings), np.int32)
        turn[by_part] = np.arange(len(strings))
        out = []
        for a, z in _slices(part_of[by_part]):
            some = by_part[a:z]
            blob = [strings[i] for i in some.tolist()]
            out.append((int(part_of[some[0]]), batch, POSTINGS, zstandard.compress(b"".join(blob), 3), np.array([len(x) for x in blob], np.uint16).tobytes(), least[some].tobytes()))
        order = np.argsort(starts)
        seen = {"string": turn[which[order]], "step": np.diff(starts[order], prepend=0).astype(np.int32), "windows": windows[order].astype(np.uint8), "later": (docs_of > least[which])[order] if len(which) else np.zeros(0, bool)}
        out.append((parts + xxhash.xxh3_64_intdigest(str(batch)) % parts, batch, ROWS, _ipc(pa.table(seen)), None, None))
        trim()
        return _rows(out)

    def sorted_out(posted: pa.Table) -> pa.Table:
        """For each string one bit a window: whether a document before the string's least one has the window."""
        if posted["kind"][0].as_py() == ROWS:
            return posted.select(_ROWS_ARROW.names)
        number: dict[bytes, int] = {}
        which, docs_of = [], []
        for blob, lengths, docs in zip(posted["a"], posted["b"], posted["c"], strict=True):
            blob, ends = zstandard.decompress(blob.as_py()), np.cumsum(np.frombuffer(lengths.as_py(), np.uint16), dtype=np.int64).tolist()
            which.append([number.setdefault(blob[a:z], len(number)) for a, z in zip([0, *ends[:-1]], ends, strict=True)])
            docs_of.append(np.frombuffer(docs.as_py(), np.int64))
        strings, flat = list(number), np.array([i for w in which for i in w], np.int64)
        least = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(least, flat, np.concatenate(docs_of))
        earliest = least_docs(strings, least, width)
        windows = np.array([len(x) - width + 1 for x in strings], np.int64)
        first = np.cumsum(windows) - windows
        out = []
        for batch, some, docs in zip(posted["batch"].to_pylist(), which, docs_of, strict=True):
            some = np.array(some, np.int64)
            n = windows[some]
            bits = earliest[np.repeat(first[some], n) + _within(n)] < np.repeat(docs, n)
            out.append((posted["part"][0].as_py(), batch, POSTINGS, np.packbits(bits).tobytes(), n.astype(np.uint8).tobytes(), None))
        trim()
        return _rows(out)

    def removed(own: pa.Table, rows: pa.Table) -> pa.Table:
        ids, data, offsets = own_of(own["own"][0].as_py())
        kinds = rows["kind"].to_numpy()
        seen = _read(rows["a"][int(np.flatnonzero(kinds == ROWS)[0])].as_py())
        answers = rows.filter(pa.array(kinds == POSTINGS)).sort_by("part")
        gone = np.zeros(0, np.int64)
        if seen.num_rows:
            string, step, n, later = (np.asarray(_one(seen[c])) for c in ("string", "step", "windows", "later"))
            n = n.astype(np.int64)
            counts = np.concatenate([np.frombuffer(x.as_py(), np.uint8).astype(np.int64) for x in answers["b"]])
            flags = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=int(np.frombuffer(y.as_py(), np.uint8).sum(dtype=np.int64))) for x, y in zip(answers["a"], answers["b"], strict=True)])
            first = np.cumsum(counts) - counts
            within = _within(n)
            gone = np.flatnonzero(flags[np.repeat(first[string], n) + within].astype(bool) | np.repeat(later, n))
            gone = (np.repeat(np.cumsum(step, dtype=np.int64), n) + within)[gone]
        # runs of removed bytes, which end with their row
        row = np.searchsorted(offsets, gone, "right") - 1
        fresh = np.flatnonzero((np.diff(gone, prepend=-1 - width) > width) | (np.diff(row, prepend=-1) > 0))
        edges = np.stack([gone[fresh], gone[np.append(fresh[1:], len(gone))[: len(fresh)] - 1] + width], axis=1)
        spans, made_of, text = [], [], data.tobytes()
        cuts = np.searchsorted(row[fresh], np.arange(len(offsets))).tolist()
        for (a, z), (f, l) in zip(itertools.pairwise(offsets.tolist()), itertools.pairwise(cuts), strict=True):
            here = edges[f:l].tolist()
            spans.append([{"start": x - a, "end": y - a} for x, y in here])
            kept = itertools.pairwise([a, *(e for span in here for e in span), z])
            made_of.append(result[1](b"".join(text[x:y] for x, y in itertools.islice(kept, 0, None, 2))))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        found = pa.table([ids, pa.array(np.diff(offsets), pa.int64()), pa.array(spans, span), pa.array(made_of, made)], names=["doc_id", "n_bytes", "spans", name])
        trim()
        return found

    posted = held.mapInArrow(post, _ROWS_SCHEMA)
    answers = posted.groupBy("part").applyInArrow(shared, _ROWS_SCHEMA)
    strings = held.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(strings_of, _ROWS_SCHEMA)
    bits = strings.groupBy("part").applyInArrow(sorted_out, _ROWS_SCHEMA)
    return held.groupBy("batch").cogroup(bits.groupBy("batch")).applyInArrow(removed, f"doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, {name} {kind}")


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS i, h FROM d),
k AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM w),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS gone FROM k),
g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM f WHERE gone),
r AS (SELECT doc_id, i, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM g),
p AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY ALL),
q AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
o AS (SELECT doc_id, count(*)::BIGINT AS n_spans, sum(z - a)::BIGINT AS n_removed, max(z) AS last, list({'a': a, 'before': before} ORDER BY a) AS pieces FROM q GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN pieces IS NULL THEN h
    ELSE array_to_string(list_transform(pieces, lambda x: substr(h, 2 * x.before + 1, 2 * (x.a - x.before))), '') || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN o ON d.doc_id IS NOT DISTINCT FROM o.doc_id
"""
