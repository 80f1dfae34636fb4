"""Repair of conversations against a search through all edits, and the contract's query against a plain version."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from riskloom.llm import queries, turns
from tests.oracle import connection

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def faults_of(rows):
    out, seen = [], set()
    for role, text in rows:
        core = text.strip(SPACES)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """The least (cost, audit) over all edits by a best-first search over audits, and the turns that it leaves."""
    import heapq

    faults = faults_of(rows)
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, roles, kept = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, list(kept)
        if len(roles) > len(rows) + 3 or not re.match("^s?(ua)*u?$", roles):
            continue
        for name in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, roles + name[0], (*kept, (name, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, kept))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[:1], (*kept, (role, text))))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, roles + name[0], (*kept, (name, text))))
    raise AssertionError


def plain_states(rows):
    """The same by plain dynamic programming over (turn, state) on pairs of cost and audit, from the end: longer conversations."""
    faults = faults_of(rows)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {"": (0, ""), "a": (0, ""), "u": (3, "I"), "s": (6, "II")}
    for (role, _), fault in zip(reversed(rows), reversed(faults), strict=True):
        new = {}
        for q in ("", "s", "u", "a"):
            options = [(4 + best[q][0], "D" + best[q][1])]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if (q, role[:1]) in step:
                    c, a = best[step[q, role[:1]]]
                    options.append((c + more, "K" + a))
                c, a = best["a" if q == "u" else "u"]
                options.append((c + more + 3, "R" + a))
            new[q] = min(options)
        for _ in range(3):
            for q in new:
                c, a = new["a" if q == "u" else "u"]
                new[q] = min(new[q], (c + 3, "I" + a))
        best = new
    return best[""]


def digest(kept):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()


def plain_damage(conv_id, rows):
    out = []
    for turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        case = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        role = "user" if case == 4 else role
        out += [(turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def expected(rows, solve):
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", digest([]))
    pairs = [(r, t) for _, r, t in rows]
    faults, known = faults_of(pairs), [t for t, *_ in rows if t is not None]
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(pairs))
    cost, audit, kept = solve(pairs)
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest(kept))


def states_and_text(pairs):
    cost, audit = plain_states(pairs)
    kept, state, rest = [], "", list(pairs)
    for letter in audit:
        expected_role = "assistant" if state == "u" else "user"
        if letter == "I":
            kept.append((expected_role, ""))
        else:
            role, text = rest.pop(0)
            if letter == "D":
                continue
            kept.append((role if letter == "K" else expected_role, text))
        state = kept[-1][0][0]
    return cost, audit, kept


def random_rows(rnd, n, turns_up_to):
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No!", "cut off", " ", "", None, "Why?\n", "x . "]
    return [(rnd.choice([None, *range(turns_up_to)]), rnd.choice(roles[:3] if rnd.random() < 0.8 else roles), rnd.choice(texts) if rnd.random() < 0.3 else f"word {rnd.randint(0, 99)}.") for _ in range(n)]


def test_the_two_plain_versions_agree():
    rnd = random.Random(2)
    for _ in range(150):
        pairs = [(r or " ", t or " ") for _, r, t in random_rows(rnd, rnd.randint(0, 4), 5)]
        assert states_and_text(pairs) == plain_repair(pairs), pairs


def test_weights_decide_as_the_plain_version():
    rnd = random.Random(5)
    for _ in range(600):
        rows = sorted(((t, r or " ", x or " ") for t, r, x in random_rows(rnd, rnd.randint(1, 25), 9)), key=lambda r: (r[0] is not None, r[0] or 0))
        assert turns._whole([(t, r, x, 1) for t, r, x in rows])[0] == expected(rows, states_and_text), rows


def conversations(spark, rnd):
    convs = {None: random_rows(rnd, 6, 9), 7: [], 8: random_rows(rnd, 300, 40), 9: [(1, "user", "Same.")] * 90 + [(2, "user", "Same.")] * 50 + random_rows(rnd, 40, 8)}
    convs |= {i: random_rows(rnd, rnd.randint(1, 9), 9) for i in range(20, 80)}
    dropped = next(i for i in range(100, 999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    convs[dropped] = [(0, "user", "Gone.")]
    rows = [(c, t, r, x, 5, "clash") for c, found in convs.items() for t, r, x in found]
    rnd.shuffle(rows)
    return convs, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int, _c string")


def got_of(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.parametrize("rows,block", [(2000, 256), (3, 2), (50, 7)])
def test_whole_and_long_conversations(spark, monkeypatch, rows, block):
    monkeypatch.setattr(turns, "ROWS", rows)
    monkeypatch.setattr(turns, "BLOCK_ROWS", block)
    monkeypatch.setattr(turns, "RANGE_BYTES", 300)
    convs, df = conversations(spark, random.Random(11))
    want = {c: expected(plain_damage(c, found), states_and_text) for c, found in convs.items() if found}
    assert got_of(turns.repair(turns.damaged(df))) == want
    kept = turns.repaired_turns(turns.damaged(df)).collect()
    for c, found in convs.items():
        if found:
            mine = sorted((r for r in kept if r.conv_id == c), key=lambda r: (r.block, r.place))
            assert digest([(r.role, r.text) for r in mine]) == want[c][-1]


def test_very_long_texts_and_empty_table(spark):
    text = "word " * 200_000 + "."
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "user", text[:-1])], "conv_id long, turn long, role string, text string")
    want = expected([(0, "user", text), (1, "user", text[:-1])], states_and_text)
    assert got_of(turns.repair(df)) == {1: want}
    assert turns.repair(df.limit(0)).count() == 0


def test_the_query_on_the_given_table(spark, data_dir):
    found = {}
    for c, *row in connection(data_dir).sql("SELECT conv_id, turn, role, text FROM conversations").fetchall():
        found.setdefault(c, []).append(tuple(row))
    want = {c: expected(plain_damage(c, rows), states_and_text) for c, rows in found.items()}
    assert got_of(queries.op11_conversation_repair(spark, data_dir)) == want
