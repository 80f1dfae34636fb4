"""Keyed postings shuffled as packed columns.

A batch of rows (a run of texts of some megabytes) deals its postings (a 64-bit key and the row's place in the batch) to parts by key; a part sees every
posting of its keys and answers each batch; a batch gathers the answers of all parts. A shuffled row is one batch's
share of one part, so that a posting costs about ten bytes instead of a row. Parts and batches are bounded by their
number: `parts_for` keeps a part at about a million postings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from riskloom.llm.common import small_batches, steps, trim, trimmed

PART_POSTINGS = 1_000_000
#: Bytes of text whose postings are dealt at a time.
DEAL_BYTES = 8 << 20
POSTINGS, ROWS, TOTALS = 0, 1, 2
_SCHEMA = "part long, batch long, kind int, a binary, b binary, c binary"
_NAMES = ["part", "batch", "kind", "a", "b", "c"]


def parts_for(postings: int) -> int:
    return max(1, -(-int(postings) // PART_POSTINGS))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=_NAMES)


def places(raw: bytes) -> np.ndarray:
    """Row places, packed as 16-bit numbers if all fit (a first byte says so)."""
    return np.frombuffer(raw, np.uint16 if raw[0] == 2 else np.uint32, offset=4).astype(np.int64)


def packed_places(at: np.ndarray) -> bytes:
    small = not len(at) or int(at.max()) < 1 << 16
    return bytes([2 if small else 4, 0, 0, 0]) + at.astype(np.uint16 if small else np.uint32).tobytes()


def packed_keys(keys: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked_keys(raw: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return wide.view("<u8").ravel()


def exchange(rows: DataFrame, parts: int, deal: Callable, answer: Callable, gather: Callable, schema: str, value: type = np.uint16, add_up: Callable | None = None, width: int = 8, extra_type: type = np.uint8) -> DataFrame:
    """deal(batch) -> (keys, places, an extra value of `extra_type` a posting or None, bytes for the batch itself)
    answer(keys, extra) -> (kept, values): which postings to answer, and a value of type `value` for each
    gather(the batch's own bytes, places, keys, values) -> pa.Table of `schema`.

    `width`: the bytes of a key that are told apart. With add_up, answer also returns bytes that describe the part; add_up(a list of these) -> pa.Table of `schema`, and
    gather gets no keys.
    """

    @trimmed
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        slices = (whole.slice(row, end - row) for whole in batches for row, end, *_ in steps(whole["text"], DEAL_BYTES))
        for number, batch in enumerate(slices):
            keys, at, extra, own = deal(batch)
            if width < 8:
                keys = keys & np.uint64((1 << 8 * width) - 1)
            part = (keys % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((keys, part))
            cut = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
            del part
            out = []
            for p in np.flatnonzero(np.diff(cut)):
                some = order[cut[p] : cut[p + 1]]
                out.append((int(p), task + number, POSTINGS, packed_keys(keys[some], width), packed_places(at[some]), None if extra is None else extra[some].tobytes()))
            out.append((parts + (task + number) % parts, task + number, ROWS, own, None, None))
            del keys, at, extra, own, order
            found = _batch(out)
            del out
            yield found
            del found
            trim()

    def answered(rows: pa.Table) -> pa.Table:
        kinds = rows["kind"].to_numpy()
        if kinds[0] == ROWS:
            return rows.select(_NAMES)
        blobs = [x.as_py() for x in rows["a"]]
        keys = unpacked_keys(b"".join(blobs), width)
        extra = np.frombuffer(b"".join(x.as_py() for x in rows["c"]), extra_type) if rows["c"].null_count == 0 else None
        kept, values, *more = answer(keys, extra)
        out, start = [], 0
        if add_up:
            part = rows["part"][0].as_py()
            out.append((0, -1 - part % 64, TOTALS, more[0], None, None))
        for blob, at, batch in zip(blobs, rows["b"], rows["batch"], strict=True):
            here = slice(start, start + len(blob) // width)
            start = here.stop
            some = np.flatnonzero(kept[here])
            if len(some):
                out.append((0, batch.as_py(), POSTINGS, b"" if add_up else packed_keys(keys[here][some], width), packed_places(places(at.as_py())[some]), values[here][some].astype(value).tobytes()))
        found = pa.Table.from_batches([_batch(out)])
        trim()
        return found

    def gathered(rows: pa.Table) -> pa.Table:
        kinds = rows["kind"].to_numpy()
        if kinds[0] == TOTALS:
            return add_up([x.as_py() for x in rows["a"]])
        own = rows["a"][int(np.flatnonzero(kinds == ROWS)[0])].as_py()
        posted = rows.filter(pa.array(kinds == POSTINGS))
        keys = unpacked_keys(b"".join(x.as_py() for x in posted["a"]), width)
        at = np.concatenate([np.zeros(0, np.int64), *(places(x.as_py()) for x in posted["b"])])
        values = np.frombuffer(b"".join(x.as_py() for x in posted["c"]), value)
        found = gather(own, at, keys, values)
        del posted, own, keys, at, values
        trim()
        return found

    small_batches(rows.sparkSession)
    posted = rows.mapInArrow(dealt, _SCHEMA)
    answers = posted.groupBy("part").applyInArrow(answered, _SCHEMA)
    return answers.groupBy("batch").applyInArrow(gathered, schema)
