"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap. Each chunk is split by the pre-token pattern on its own; a chunk that starts
inside a pre-token soon falls into step with the true boundaries. Two neighbours are stitched at the first boundary of
the overlap that both have; the pieces are then encoded by merge ranks and each text's ids are joined in order. Decoding
concatenates the bytes of the ids.

Ordinary documents of more than a chunk are cut, stitched and encoded in the task that reads them. A text beyond `DEAL`
characters is dealt: its larger chunks are split by different tasks, stitched, and the runs between stitches are encoded
by different tasks again.

The pattern must cover every character, and may look past a match by `SURE` characters or through white space only.

Defined cases: a null text is an empty one, with no ids and no bytes; repeated rows are encoded each; neighbours whose
overlap has no common boundary (a run of letters or blanks longer than the overlap) are split on from the last true
boundary until one fits; an empty table gives no rows; other columns are kept by `encode`, but for those that it adds.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import KEPT, materialise, small_batches, trimmed

#: Characters of a chunk, and of its overlap with the next one.
CHUNK, OVERLAP = 1536, 48
#: Characters of a text beyond which it is dealt to tasks, in chunks of as many, and the overlap of these.
DEAL, DEAL_OVERLAP = 65_536, 512
#: A boundary is sure if the match before it ended so far from the end of the chunk (the pattern looks no further), and
#: something other than white space is left after it (of that, the pattern looks through any length).
SURE = 3
#: Distinct pre-tokens whose ids a worker keeps (and as many older ones), and the longest that it keeps.
CACHE, CACHE_LENGTH = 200_000, 40
#: Bytes beyond which a pre-token is merged by a heap.
LONG = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of least rank, leftmost first, until none is in the vocabulary."""
    if (rank := ranks.get(piece)) is not None:
        return [rank]
    return _merge_long(piece, ranks) if len(piece) > LONG else _merge_short(piece, ranks)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    get, none = ranks.get, len(ranks) + (1 << 30)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[x] for x in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with pairs in a heap and linked neighbours: n log n."""
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue  # one of the two has merged meanwhile
        j = after[i]
        alive[j] = False
        end[i], after[i] = end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Codec:
    """Ranks and pattern of a byte-level BPE; the ids of pre-tokens seen before are kept, up to a number."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern, regex.V0)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.decimals = [str(rank) for rank in range(len(self.tokens))]
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _missing(self, piece: str) -> bytes:
        ids = self.older.pop(piece, None)
        if ids is None:
            ids = struct.pack(f"={len(found := merge(piece.encode(), self.ranks))}i", *found)
        if len(piece) <= CACHE_LENGTH:
            self.kept[piece] = ids
        return ids

    def pretokens(self, text: str, chunk: int, overlap: int) -> list[str]:
        """The pre-tokens of a text, by overlapping chunks; the text starts and ends at true boundaries."""
        find, n = self.split.findall, len(text)
        end = chunk + overlap
        if n <= end:
            return find(text)
        out, now, then, ahead = [], find(text[:end]), chunk, chunk
        while end < n:
            later_end = min(n, then + ahead + overlap)
            later = find(text[then:later_end])
            sure = sure_end(text[then:end], then, False)
            own, i, at = {}, len(now), end
            while i and (at >= then or at > sure):
                if at <= sure:
                    own[at] = i
                i -= 1
                at -= len(now[i])
            meet = then
            for j, piece in enumerate(later):
                if meet in own or meet > sure:
                    break
                meet += len(piece)
            if meet in own:
                out += now[: own[meet]]
                now = later[j:]
                next_ahead = chunk
            else:  # split on from the last true boundary, and look twice as far each time, so that the work follows the length
                out += now[:i]
                now = find(text[at:later_end])
                next_ahead = 2 * ahead
            end, then, ahead = later_end, then + ahead, next_ahead
        return out + now

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        """The ids of a text as 32-bit integers; the text starts and ends at true boundaries."""
        if len(self.kept) > CACHE:
            self.kept, self.older = {}, self.kept
        kept, missing = self.kept.get, self._missing
        return b"".join([kept(piece) or missing(piece) for piece in self.pretokens(text, chunk, overlap)])

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def boundaries(self, text: str, start: int = 0) -> list[int]:
        return [m.end() for m in self.split.finditer(text, start)]


def sure_end(text: str, first: int, last: bool) -> int:
    """Up to where the boundaries of a chunk (or of its end: `text`, from place `first`) are sure."""
    return first + (len(text) if last else min(len(text) - SURE, len(text.rstrip()) - 1))


def digests(codec: Codec, encoded: bytes) -> tuple[int, str, str]:
    """The number of ids, the sha256 of their decimal text, and the sha256 of the bytes that they decode to."""
    ids = np.frombuffer(encoded, np.int32).tolist()
    decimals = codec.decimals
    text = ",".join([decimals[i] for i in ids])
    return len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def stitch(codec: Codec, chunks: list[tuple[int, str, np.ndarray]], length: int) -> Iterator[tuple[int, str]]:
    """(place, text) runs between stitches, which start and end at true boundaries.

    `chunks`: in order, each with its first character's place, its text and its own boundaries (places in the text).
    """
    at = 0
    for i, (first, text, bounds) in enumerate(chunks):
        if at >= first + len(text) and i + 1 < len(chunks):
            continue  # a longer run has swallowed this chunk
        if i + 1 == len(chunks):
            if at < length:
                yield at, text[at - first :]
            return
        then, later = chunks[i + 1][0], chunks[i + 1][2]
        common = np.intersect1d(bounds[bounds >= max(at, then)], later, assume_unique=True)
        if len(common):
            yield at, text[at - first : int(common[0]) - first]
            at = int(common[0])
            continue
        # no common boundary: split on from the last true one, over the next chunks, until one of theirs is met
        known = bounds[bounds > at]
        turn = int(known[known <= then][-1]) if (known <= then).any() else at
        joined, end, j, ahead = text[turn - first :], first + len(text), i, 1
        while True:
            for _ in range(min(ahead, len(chunks) - 1 - j)):  # twice as many each time
                j += 1
                joined += chunks[j][1][end - chunks[j][0] :]
                end = chunks[j][0] + len(chunks[j][1])
            ahead *= 2
            sure = sure_end(joined, turn, j + 1 == len(chunks))
            mine = turn + np.array(codec.boundaries(joined), np.int64)
            met = np.intersect1d(mine[(mine > then) & (mine <= sure)], chunks[j][2], assume_unique=True)
            if len(met) or j + 1 == len(chunks):
                break
        stop = int(met[0]) if len(met) else length
        yield at, text[at - first : turn - first] + joined[: stop - turn]
        at = stop


_CODECS: dict[str, Codec] = KEPT


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, deal: int = DEAL, deal_overlap: int = DEAL_OVERLAP) -> DataFrame:
    """All columns of `docs` (with a column text) but text, and n_tokens, ids_sha256, decoded_sha256."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))  # a vocabulary file: its size doesn't follow the data
    name = uuid.uuid4().hex
    kept = docs.drop("n_tokens", "ids_sha256", "decoded_sha256")
    keys = [c for c in kept.columns if c != "text"]
    out = kept.select(*keys, F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema

    def codec() -> Codec:
        if name not in _CODECS:
            _CODECS.clear()
            _CODECS[name] = Codec(*shared.value)
        return _CODECS[name]

    @partial(trimmed, keeps=True)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        for batch in batches:
            found = [digests(c, c.encode(text.as_py() or "", chunk, overlap)) for text in batch["text"]]
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), *columns], names=[*keys, "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    short = F.coalesce(F.length("text"), F.lit(0)) <= deal
    done = kept.filter(short).mapInArrow(whole, out)

    # written once: the rows' numbers must not change between the chunks and the join
    long = kept.filter(~short).withColumn("_row", F.monotonically_increasing_id()).withColumn("_length", F.length("text"))
    long = materialise(long, "long-texts")
    chunks = long.withColumn("_n", F.explode(F.sequence(F.lit(0), F.expr(f"int((_length - 1) div {deal})"))))
    chunks = chunks.withColumn("text", F.expr(f"substring(text, _n * {deal} + 1, {deal + deal_overlap})"))

    @partial(trimmed, keeps=True)
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        for batch in batches:
            bounds = []
            for text, n, length in zip(batch["text"], batch["_n"], batch["_length"], strict=True):
                text, first = text.as_py(), n.as_py() * deal
                found = np.array(c.boundaries(text), np.int64)
                sure = sure_end(text, 0, first + len(text) >= length.as_py())
                bounds.append((found[found <= sure] + first).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bounds, pa.binary())], names=[*batch.schema.names, "_bounds"])

    dealt = chunks.repartition(F.col("_row"), F.col("_n"))
    bounded = dealt.mapInArrow(split, dealt.withColumn("_bounds", F.lit(b"")).schema)
    group = bounded.select("_row", "_n", "_length", "text", "_bounds").groupBy("_row")

    def runs(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_n")
        parts = [(n.as_py() * deal, text.as_py(), np.frombuffer(b.as_py(), np.int64)) for n, text, b in zip(rows["_n"], rows["text"], rows["_bounds"], strict=True)]
        found = list(stitch(codec(), parts, rows["_length"][0].as_py()))
        return pa.table([pa.array([rows["_row"][0].as_py()] * len(found), pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], names=["_row", "_at", "text"])

    stitched = group.applyInArrow(runs, "_row long, _at long, text string").repartition(F.col("_row"), F.col("_at"))

    @partial(trimmed, keeps=True)
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        for batch in batches:
            ids = [c.encode(text.as_py(), chunk, overlap) for text in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["_row"], batch["_at"], pa.array(ids, pa.binary())], names=["_row", "_at", "_ids"])

    encoded = stitched.mapInArrow(pieces, "_row long, _at long, _ids binary")

    def join(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_at")
        c = codec()
        n, ids_sha, bytes_sha = digests(c, b"".join(x.as_py() for x in rows["_ids"]))
        return pa.table([pa.array([rows["_row"][0].as_py()], pa.int64()), pa.array([n], pa.int64()), pa.array([ids_sha]), pa.array([bytes_sha])], names=["_row", "n_tokens", "ids_sha256", "decoded_sha256"])

    joined = encoded.groupBy("_row").applyInArrow(join, "_row long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return done.unionByName(long.drop("text", "_length").join(joined, "_row").drop("_row"))
