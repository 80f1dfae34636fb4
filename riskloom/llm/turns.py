"""Repair of conversations: the cheapest edits that make roles alternate.

A conversation's turns may be empty, repeated, cut off, out of order of roles or missing. Each turn is kept, given another
role or deleted, and turns can be inserted, so that the roles come out as an optional system turn and then pairs of user and
assistant turns; every edit has a price. Of the cheapest repairs the one with the ASCII-least audit (the edits' letters in order)
is taken.

Turns and the four states of that pattern make a graph without cycles. A path's weight is one integer: its high digits are the
cost, and below them each turn has a digit of fixed width at its own place, which holds the audit letters of that turn
(three letters of three bits, ended by zeros: `K` is 300, `IK` is 230 in octal; no turn's letters begin another's, so the order
of the digits is the order of the audits). The least weight, an ordinary minimum of integers, decides cost and audit together.

Conversations of up to `ROWS` turns and `BYTES` of text are each solved where their turns meet, after one shuffle. Longer
ones are range-partitioned by turn and cut into blocks; a block gives the least weights between all states, a scan over these
small tables finds the states between blocks, the blocks are solved side by side, and their texts pass through the digest in
order. Equal turns are counted before they are dealt.

Defined cases: a null conv_id is a conversation of its own; in `damaged` a null in any other column is one space; turns
without a number come first; turns of one number are taken by role and text; repeated rows are duplicates of the first;
a role that starts with none of s, u, a can't be kept; a conversation without turns gives zeros, an empty audit and the
digest of nothing; very long texts pass whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import materialise, small_batches, trimmed

#: Turns and bytes of text up to which a conversation is solved in one piece, and turns and bytes of a block of a longer one.
ROWS, BYTES = 2000, 16 << 20
BLOCK_ROWS, BLOCK_BYTES = 256, 4 << 20
#: Bytes of text of a range of long conversations.
RANGE_BYTES = 32 << 20
#: Long conversations up to which their ids are broadcast; beyond, ids and turns are joined by salted keys.
BROADCAST_LONG, SALTS = 100_000, 64
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"

#: States: nothing yet, after system, after user, after assistant. What each takes next, and where a role leads.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_EXPECTED = ["u", "u", "a", "u"]
_NAMES = {"u": "user", "a": "assistant"}
_LETTERS = "DIKR"
#: Bits of a letter and of a turn's digit.
_LETTER, _DIGIT = 3, 9


def _digit(letters: str) -> int:
    value = 0
    for place in range(_DIGIT // _LETTER):
        value = value << _LETTER | (_LETTERS.index(letters[place]) + 1 if place < len(letters) else 0)
    return value


def _letters(digit: int) -> str:
    places = (digit >> shift & 7 for shift in range(_DIGIT - _LETTER, -1, -_LETTER))
    return "".join(_LETTERS[p - 1] for p in places if p)


def _edges() -> dict[str, list[list[tuple[int, int, int]]]]:
    """For a turn's kind (initial, or o for others; t: cut off; x: must go) and each state: cost, digit, next state."""
    out = {}
    for initial in "suao":
        for fault in ("", "t", "x"):
            table = []
            for state in range(4):
                found = [(DELETE, _digit("D"), state)]
                if fault != "x":
                    for inserts in ("", "I"):
                        here = _NEXT[state, _EXPECTED[state]] if inserts else state
                        price = INSERT * len(inserts) + (CUT_OFF if fault else 0)
                        if (here, initial) in _NEXT:
                            found.append((price + KEEP, _digit(inserts + "K"), _NEXT[here, initial]))
                        found.append((price + REROLE, _digit(inserts + "R"), _NEXT[here, _EXPECTED[here]]))
                table.append(found)
            out[initial + fault] = table
    return out


_EDGES = _edges()
#: What is inserted at the end.
_ENDS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def least_weights(kinds: list[str], start: int) -> dict[int, int]:
    """For each state that the turns can lead to from `start`, the least weight."""
    n = len(kinds)
    top = _DIGIT * (n + 1)
    best = {start: 0}
    for i, kind in enumerate(kinds):
        shift, after = _DIGIT * (n - i), {}
        for state, weight in best.items():
            for cost, digit, to in _EDGES[kind][state]:
                w = weight + (cost << top) + (digit << shift)
                if to not in after or w < after[to]:
                    after[to] = w
        best = after
    return best


def ended(weights: dict[int, int], n: int) -> int:
    """The least weight with what is inserted at the end."""
    top = _DIGIT * (n + 1)
    return min(w + (INSERT * len(_ENDS[s]) << top) + _digit(_ENDS[s]) for s, w in weights.items())


def decoded(weight: int, n: int) -> tuple[int, list[str]]:
    """The cost, and the letters of each turn and of the end."""
    top = _DIGIT * (n + 1)
    mask = (1 << _DIGIT) - 1
    return weight >> top, [_letters(weight >> _DIGIT * (n - i) & mask) for i in range(n + 1)]


@lru_cache(100_000)
def _short(kinds: tuple[str, ...]) -> tuple[int, list[str]]:
    return decoded(ended(least_weights(list(kinds), START), len(kinds)), len(kinds))


def best_edits(kinds: list[str]) -> tuple[int, list[str]]:
    """Cost and letters of the best repair of a whole conversation."""
    if len(kinds) <= 16:
        return _short(tuple(kinds))
    return decoded(ended(least_weights(kinds, START), len(kinds)), len(kinds))


def fault_of(text: str) -> str:
    """x: blank; t: cut off; else nothing."""
    core = text.rstrip(SPACES)
    return "x" if not core else "" if core[-1] in ".!?" else "t"


def kind_of(role: str, fault: str) -> str:
    return (role[0] if role[:1] in ("s", "u", "a") and role else "o") + fault


def written(turns: list[tuple[str, str]], letters: list[str], state: int) -> tuple[list[tuple[str, str]], int]:
    """The repaired turns, from a state on, and the state that they lead to."""
    out = []

    def put(role: str, text: str) -> None:
        nonlocal state
        out.append((role, text))
        state = _NEXT[state, role[0]]

    for (role, text), edit in zip([*turns, ("", "")], letters, strict=True):
        for letter in edit:
            if letter == "I":
                put(_NAMES[_EXPECTED[state]], "")
            elif letter == "R":
                put(_NAMES[_EXPECTED[state]], text)
            elif letter == "K":
                put(role, text)
    return out, state


class Turns:
    """Counts over turns in order; those of consecutive runs of turns can be added up."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn: int | None, role: str, fault: str, copies: int, seen: bool) -> None:
        """A turn that stands `copies` times in a row; `seen`: earlier, too."""
        initial = role[:1]
        if fault == "x":
            self.blank += copies
        else:
            self.duplicate += copies - (not seen)
            self.truncated += fault == "t" and not seen
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.illegal += copies - 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.distinct += 1
            self.low = turn if self.low is None else self.low
            self.high = turn

    def follow(self, later: Turns) -> None:
        if later.last is None:
            return
        for name in ("blank", "duplicate", "truncated", "illegal", "distinct"):
            setattr(self, name, getattr(self, name) + getattr(later, name))
        if self.last is not None:
            self.illegal += self.last + later.first not in ("su", "ua", "au")
        else:
            self.first = later.first
        self.last = later.last
        if later.high is not None:
            self.distinct -= later.low == self.high
            self.low = later.low if self.low is None else self.low
            self.high = later.high

    def gaps(self) -> int:
        return 0 if self.high is None else self.high - self.low + 1 - self.distinct


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0, 1 or 2) of turns that were dropped, emptied, stripped of sentence ends,
    repeated or given to the user, by a checksum of conv_id and turn."""
    text_of = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    role = F.when(case == 4, "user").otherwise(text_of("role"))
    copies = F.when(case == 0, 0).when(case == 3, 2).otherwise(1).cast("long")
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


_RESULT = "_c string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ORDER = ["_known", "turn", "role", "text"]


def _key(conv_id: Column) -> Column:
    return F.concat(F.when(conv_id.isNull(), "n").otherwise("s"), F.coalesce(conv_id.cast("string"), F.lit("")))


def _keyed(rows: DataFrame) -> DataFrame:
    copies = F.coalesce(F.col("copies"), F.lit(1)) if "copies" in rows.columns else F.lit(1)
    words = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = rows.select(_key(F.col("conv_id")).alias("_c"), F.col("turn").cast("long").alias("turn"), *words, copies.cast("long").alias("copies"))
    return rows.withColumn("_known", F.col("turn").isNotNull())


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """Rows of sorted batches, as tuples."""
    for batch in batches:
        yield from zip(*(batch[c].to_pylist() for c in columns), strict=True)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_KINDS |= {"array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _named(found: DataFrame, like: DataFrame) -> DataFrame:
    """conv_id in place of the key made of it."""
    conv_id = F.when(F.col("_c").startswith("s"), F.substring("_c", 2, 1 << 30)).cast(like.schema["conv_id"].dataType)
    return found.select(conv_id.alias("conv_id"), *(c for c in found.columns if c != "_c"))


def _lines(turns: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in turns).encode()


def _whole(rows: list[tuple]) -> tuple[tuple, list[tuple[str, str]]]:
    """The result of one conversation, of (turn, role, text, copies) in order, and its repaired turns."""
    counts, seen, turns, kinds = Turns(), set(), [], []
    for turn, role, text, copies in rows:
        for _ in range(copies):
            fault = fault_of(text)
            again = fault != "x" and (role, text) in seen
            seen.add((role, text))
            counts.add(turn, role, fault, 1, again)
            turns.append((role, text))
            kinds.append(kind_of(role, "x" if again else fault))
    if not turns:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()), []
    cost, letters = best_edits(kinds)
    kept, _ = written(turns, letters, START)
    return (counts.gaps(), counts.blank, counts.duplicate, counts.truncated, counts.illegal, cost, "".join(letters), hashlib.sha256(_lines(kept)).hexdigest()), kept


def _solve_ordinary(rows: DataFrame, schema: str, result_of: Callable) -> DataFrame:
    """result_of(key, rows of the conversation in order) -> rows of `schema`, for conversations that fit in a task."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = _arrow(schema)
        key, held, out = None, [], []
        for c, *row in _groups(batches, ["_c", "turn", "role", "text", "copies"]):
            if c != key:
                if key is not None:
                    out += result_of(key, held)
                key, held = c, []
            held.append(row)
            if len(out) >= 1000:
                yield _table(out, out_schema)
                out = []
        if key is not None:
            out += result_of(key, held)
        if out:
            yield _table(out, out_schema)

    return rows.repartition("_c").sortWithinPartitions("_c", *_ORDER).mapInArrow(run, schema)


def _divided(rows: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """Turns of ordinary conversations, turns of long ones (none: there are none), and the bytes of these."""
    sizes = rows.groupBy("_c").agg(F.sum(F.greatest("copies", F.lit(1))).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b"))
    long = materialise(sizes.filter((F.col("n") > ROWS) | (F.col("b") > BYTES)), "long-conversations")
    count, total = long.agg(F.count(F.lit(1)), F.sum("b")).first()
    if not count:
        return rows, None, 0
    ids = long.select("_c", F.lit(True).alias("_long"))
    if count <= BROADCAST_LONG:
        marked = rows.join(F.broadcast(ids), "_c", "left")
    else:
        salt = F.pmod(F.hash("turn", "text"), F.lit(SALTS))
        marked = rows.withColumn("_salt", salt).join(ids.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_c", "_salt"], "left").drop("_salt")
    return marked.filter("_long is null").drop("_long"), marked.filter("_long").drop("_long"), int(total)


def _blocks(rows: DataFrame, total: int) -> DataFrame:
    """Blocks of consecutive turns of long conversations: (conversation, range, number in the range, turns)."""
    runs = rows.groupBy("_c", *_ORDER).agg(F.sum("copies").alias("copies"))
    runs = materialise(runs.withColumns({"_words": F.md5(F.col("text").cast("binary"))}), "turn-runs")
    first = runs.filter("copies > 0").groupBy("_c", "role", "_words").agg(F.min(F.struct("_known", F.coalesce("turn", F.lit(0)).alias("t"))).alias("first"))
    first = first.select("_c", "role", "_words", F.col("first._known").alias("_known"), F.col("first.t").alias("_turn"), F.lit(True).alias("_first"))
    runs = runs.withColumn("_turn", F.coalesce("turn", F.lit(0))).join(first, ["_c", "role", "_words", "_known", "_turn"], "left")
    parts = max(1, -(-total // RANGE_BYTES))
    dealt = runs.repartitionByRange(parts, "_c", *_ORDER).sortWithinPartitions("_c", *_ORDER)
    schema = "_c string, _range int, _n int, turns binary, weights binary"
    turn_schema = pa.schema([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("seen", pa.bool_())])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema, place = _arrow(schema), TaskContext.get().partitionId()
        key, held, size, number = None, [], 0, 0

        def block() -> pa.RecordBatch:
            return _table([(key, place, number, _packed(_table(held, turn_schema)), _ways(_kinds(held)))], out_schema)

        for c, turn, role, text, copies, is_first in _groups(batches, ["_c", "turn", "role", "text", "copies", "_first"]):
            if key is not None and (c != key or len(held) >= BLOCK_ROWS or size > BLOCK_BYTES):
                yield block()
                number, size, held = number + 1, 0, []
            key = c
            if copies:
                held.append((turn, role, text, copies, not is_first))
                size += len(text)
        if key is not None:
            yield block()

    return materialise(dealt.mapInArrow(run, schema), "turn-blocks")


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> list[tuple]:
    with pa.ipc.open_stream(raw) as reader:
        return [tuple(r.values()) for r in reader.read_all().to_pylist()]


def _kinds(rows: list[tuple]) -> list[str]:
    out = []
    for _, role, text, _, seen in rows:
        fault = fault_of(text)
        out.append(kind_of(role, "x" if seen and fault != "x" else fault))
    return out


def _ways(kinds: list[str]) -> bytes:
    """Between any two states, the least cost and the place of that way's audit among the ways from the same state: 16 pairs of
    32-bit numbers (cost -1: no way). Copies that must go are not in it; they cost the same on each way."""
    top = _DIGIT * (len(kinds) + 1)
    out = []
    for start in range(4):
        weights = least_weights(kinds, start)
        audits = sorted({w & (1 << top) - 1 for w in weights.values()})
        for end in range(4):
            w = weights.get(end)
            out += [-1, 0] if w is None else [w >> top, audits.index(w & (1 << top) - 1)]
    return b"".join(x.to_bytes(4, "little", signed=True) for x in out)


def _between(blocks: list[bytes]) -> list[tuple[int, int]]:
    """The states before and after each block on the best way through all of them. Two ways to different states differ in a
    letter, and no way's audit begins another's, so that the first block that tells them apart decides."""
    ways = [[[(int.from_bytes(b[(s * 4 + e) * 8 :][:4], "little", signed=True), int.from_bytes(b[(s * 4 + e) * 8 + 4 :][:4], "little", signed=True)) for e in range(4)] for s in range(4)] for b in blocks]
    never = 1 << 60
    rest = [INSERT * len(_ENDS[s]) for s in range(4)]
    after = [rest]
    for way in reversed(ways):
        rest = [min((cost + rest[e] for e, (cost, _) in enumerate(way[s]) if cost >= 0), default=never) for s in range(4)]
        after.append(rest)
    after.reverse()
    state, out = START, []
    for way, rest in zip(ways, after[1:], strict=True):
        end = min((cost + rest[e], place, e) for e, (cost, place) in enumerate(way[state]) if cost >= 0)[2]
        out.append((state, end))
        state = end
    return out


def _solve_long(rows: DataFrame, total: int, turns_only: bool = False) -> DataFrame:
    blocks = _blocks(rows, total)
    small = blocks.select("_c", "_range", "_n", "weights")

    def scan(found: pa.Table) -> pa.Table:
        found = found.sort_by([("_range", "ascending"), ("_n", "ascending")])
        states = _between(found["weights"].to_pylist())
        last = [i + 1 == len(states) for i in range(len(states))]
        return found.select(["_c", "_range", "_n"]).append_column("_from", pa.array([s for s, _ in states], pa.int32())).append_column("_to", pa.array([e for _, e in states], pa.int32())).append_column("_last", pa.array(last, pa.bool_()))

    between = small.groupBy("_c").applyInArrow(scan, "_c string, _range int, _n int, _from int, _to int, _last boolean")
    placed = blocks.drop("weights").join(between, ["_c", "_range", "_n"])
    solved_schema = "_c string, _range int, _n int, cost long, audit string, counts array<long>, ends array<string>, turns array<long>, roles array<string>, texts array<string>"

    @trimmed
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = _arrow(solved_schema)
        for c, place, number, packed, start, end, last in _groups(batches, ["_c", "_range", "_n", "turns", "_from", "_to", "_last"]):
            rows = _unpacked(packed)
            kinds, counts = _kinds(rows), Turns()
            for turn, role, text, copies, seen in rows:
                counts.add(turn, role, fault_of(text), copies, seen)
            cost, letters = decoded(least_weights(kinds, start)[end], len(kinds))
            extra = [row[3] - 1 for row in rows]
            audit = "".join(edit + "D" * more for edit, more in zip(letters, [*extra, 0], strict=True))
            cost += DELETE * sum(extra)
            if last:
                letters[-1] = _ENDS[end]
                audit, cost = audit + _ENDS[end], cost + INSERT * len(_ENDS[end])
            kept, _ = written([(role, text) for _, role, text, *_ in rows], letters, start)
            numbers = [counts.blank, counts.duplicate, counts.truncated, counts.illegal, counts.distinct]
            yield _table([(c, place, number, cost, audit, numbers, [counts.first, counts.last], [counts.low, counts.high], [r for r, _ in kept], [t for _, t in kept])], out_schema)

    solved = placed.mapInArrow(solve, solved_schema)
    if turns_only:
        return solved
    solved = solved.repartition("_c").sortWithinPartitions("_c", "_range", "_n")

    @trimmed
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = _arrow(_RESULT)
        key = counts = digest = None
        cost, audits, begun = 0, [], False

        def done() -> pa.RecordBatch:
            return _table([(key, counts.gaps(), counts.blank, counts.duplicate, counts.truncated, counts.illegal, cost, "".join(audits), digest.hexdigest())], out_schema)

        for c, price, audit, numbers, ends, turns, roles, texts in _groups(batches, ["_c", "cost", "audit", "counts", "ends", "turns", "roles", "texts"]):
            if c != key:
                if key is not None:
                    yield done()
                key, counts, digest, cost, audits, begun = c, Turns(), hashlib.sha256(), 0, [], False
            here = Turns()
            here.blank, here.duplicate, here.truncated, here.illegal, here.distinct = numbers
            (here.first, here.last), (here.low, here.high) = ends, turns
            counts.follow(here)
            cost += price
            audits.append(audit)
            if roles:
                digest.update((b"\n" if begun else b"") + _lines(list(zip(roles, texts, strict=True))))
                begun = True
        if key is not None:
            yield done()

    return solved.mapInArrow(finish, _RESULT)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and the digest of the repaired turns of every
    conversation. `rows`: conv_id, turn, role, text and, where there is one, copies (how often a row stands there; 0: not at
    all, but its conversation has a result)."""
    keyed = _keyed(rows)
    small_batches(rows.sparkSession)
    ordinary, long, total = _divided(keyed)
    found = _solve_ordinary(ordinary, _RESULT, lambda key, held: [(key, *_whole(held)[0])])
    return _named(found if long is None else found.unionByName(_solve_long(long, total)), rows)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0 within a block; blocks of a long conversation in the order of `block`), role and text of the
    turns after the repair."""
    keyed = _keyed(rows)
    small_batches(rows.sparkSession)
    ordinary, long, total = _divided(keyed)
    found = _solve_ordinary(ordinary, "_c string, block long, place long, role string, text string", lambda key, held: [(key, 0, i, r, t) for i, (r, t) in enumerate(_whole(held)[1])])
    if long is None:
        return _named(found, rows)
    block = (F.col("_range").cast("long") * F.lit(1 << 32) + F.col("_n")).alias("block")
    kept = F.posexplode(F.arrays_zip(F.col("roles").alias("role"), F.col("texts").alias("text"))).alias("place", "k")
    more = _solve_long(long, total, turns_only=True).select("_c", block, kept)
    return _named(found.unionByName(more.select("_c", "block", F.col("place").cast("long").alias("place"), "k.role", "k.text")), rows)
