"""Text jobs against small documents whose sections, chunks and pages are known, and against plain versions."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom.operators import text as X

CLAUSES = "1. Scope\n\nThis rule is for all banks.\n\n7. Staging\n\n7.1 First steps\n\nExposures start in stage 1.\n\n7.2 Higher risk\n\nA higher risk asks for stage 2.\nDays past due count.\n\n7.3 Impaired\n\nStage 3 from 90 days on.\n"


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def plain_sections(text):
    """(section_id, path, body), by a stack."""
    out, stack, name, path, body = [], [], "", [], []

    def close():
        if (joined := "\n".join(body).strip()):
            out.append((name, list(path), joined))

    for line in text.splitlines():
        numbered, marked = re.match(r"^\s{0,3}(\d+(?:\.\d+){0,3})\.?\s+(\S.*)$", line), re.match(r"^\s{0,3}(#{1,6})\s+(\S.*)$", line)
        if not numbered and not marked:
            body.append(line)
            continue
        close()
        body = []
        number, title = (numbered[1], numbered[2]) if numbered else ("", marked[2])
        depth = number.count(".") + 1 if numbered else len(marked[1])
        stack = [s for s in stack if s[0] < depth] + [(depth, f"{number} {title.strip()}".strip())]
        path = [label for _, label in stack]
        name = number or " / ".join(path)
    close()
    return out


def plain_parts(paragraphs):
    out, now = [], ""
    for p in paragraphs:
        if len(p) > 4000:
            out += [now] if now else []
            now = piece = ""
            for s in re.split(r"(?<=[.;])\s+", p):
                if piece and len(piece) + len(s) + 1 > 2800:
                    out.append(piece)
                    piece = ""
                piece = f"{piece} {s}".strip()
            out += [piece] if piece else []
        elif now and len(now) + len(p) + 2 > 2800:
            out.append(now)
            now = p
        else:
            now = f"{now}\n\n{p}".strip()
    return out + ([now] if now else [])


def plain_chunks(text):
    out, times = [], {}
    for name, path, body in plain_sections(text):
        times[tuple(path)] = times.get(tuple(path), 0) + 1
        key = hashlib.sha256(json.dumps([path, times[tuple(path)]], ensure_ascii=False).encode()).hexdigest()[:24]
        for i, part in enumerate(plain_parts([p.strip() for p in re.split(r"\n\s*\n", body) if p.strip()])):
            if len(part) < 120 and out and not name:
                out[-1] = (*out[-1][:4], f"{out[-1][4]}\n\n{part}")
            else:
                out.append((name, key, path, i, part))
    return out


def random_text(rnd):
    words = ["alpha", "beta;", "gamma.", "délta", "12.5 per cent", "“quoted”", 'a "b" \\ c', "x\ty"]
    sentence = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    kinds = [
        lambda: f"{rnd.randint(1, 3)}{rnd.choice(['', '.1', '.2.1', '.1.1.1', '.1.1.1.1'])}{rnd.choice(['', '.'])} {sentence(2)}",
        lambda: f"{'#' * rnd.randint(1, 7)} {sentence(2)}  ", lambda: "", lambda: "   ", lambda: sentence(rnd.randint(1, 60)), lambda: sentence(400),
        lambda: f"{' ' * rnd.randint(0, 5)}7.2 {sentence(1)}", lambda: "x" * 4500, lambda: "2024", lambda: " " + sentence(3) + " ",
    ]
    return rnd.choice(["\n", "\r\n", "\r"]).join(rnd.choice(kinds)() for _ in range(rnd.randint(0, 30)))


def test_clauses(spark):
    rows = {r.section_id: r for r in X.sections(docs_of(spark, [CLAUSES])).collect()}
    assert set(rows) == {"1", "7.1", "7.2", "7.3"}
    assert rows["7.2"].path == ["7 Staging", "7.2 Higher risk"]
    assert rows["7.2"].text == "A higher risk asks for stage 2.\nDays past due count."


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(12)
    return [CLAUSES, "", None, "no heading", "# A\n## B\n# C\n### D\ntext\n## E\n", "# A\nfirst\n# A\nsecond\n", *(random_text(rnd) for _ in range(60))]


def test_sections_as_by_a_stack(spark, texts):
    got = sorted((r.doc_id, r.section, r.section_id, r.path, r.text) for r in X.sections(docs_of(spark, texts)).collect())
    want = [(i, *s) for i, t in enumerate(texts) for s in plain_sections(t or "")]
    assert [(g[0], *g[2:]) for g in got] == want


def test_chunks_as_by_a_plain_version(spark, monkeypatch, texts):
    monkeypatch.setattr(X, "RUN", 3)
    rows = X.chunk_corpus(docs_of(spark, texts)).collect()
    got = [(r.doc_id, r.section_id, r.section_key, r.path, r.chunk_index, r.text) for r in sorted(rows, key=lambda r: (r.doc_id, r.chunk))]
    want = [(i, *c) for i, t in enumerate(texts) for c in plain_chunks(t or "")]
    assert got == want
    for r in rows:
        assert "\r\n" in texts[r.doc_id] or texts[r.doc_id][r.offset :].startswith(r.text.split()[0])


def test_a_long_clause_has_chunks_of_its_own(spark):
    text = "5. Long\n\n" + "\n\n".join(f"Paragraph {i} on stages. " * 20 for i in range(8)) + "\n\n" + "A sentence on cover; " * 400
    rows = X.chunk_corpus(docs_of(spark, [text])).collect()
    assert len(rows) > 3 and all(len(r.text) <= X.MAXIMUM for r in rows)
    assert sorted(r.chunk_index for r in rows) == list(range(len(rows)))
    assert all("\n\n" not in r.text for r in rows if "cover" in r.text)


def test_repeated_lines_go(spark):
    pages = [f"Central Bank   Rulebook\nBody of page {i}, own words {'abc' * i}\nPage {i} of 5\n\n  " for i in range(1, 6)]
    pages[1] += "\n" + "9" * 130 + " x"
    pages[2] += "\n" + "9" * 131 + " x"
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(pages, 1)] + [(2, 1, "same\na"), (2, 2, "same\nb")], "doc_id long, page int, text string")
    assert {(r.doc_id, r.key) for r in X.repeated_lines(rows).collect()} == {(1, "Central Bank Rulebook"), (1, "Page # of #")}
    got = {(r.doc_id, r.page): r.text for r in X.without_repeated_lines(rows).collect()}
    assert got[1, 1] == "Body of page 1, own words abc" and got[2, 1] == "same\na"
    assert got[1, 2].endswith("9 x") and len(got) == 7


def test_a_line_is_short_before_its_digits_go(spark):
    line = "Ref " + "1" * 140
    rows = spark.createDataFrame([(1, i, f"{line}\nbody {'x' * i}") for i in range(4)], "doc_id long, page int, text string")
    assert X.repeated_lines(rows).count() == 0


def test_pages_of_chunks(spark):
    pages = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("page"), F.concat(F.lit("page "), F.col("id").cast("string")).alias("text"))
    starts = X.page_starts(pages)
    chunks = starts.filter("page % 1000 = 7").select("doc_id", F.col("page").alias("chunk"), (F.col("offset") + 3).alias("offset"))
    got = {r.chunk: r.page for r in X.pages_of(chunks, starts).collect()}
    assert got == {i: i for i in range(7, 100_000, 1000)}
    few = spark.createDataFrame([(1, 1, "7. A\n\nstarts here and goes"), (1, 2, "on here."), (1, 3, ""), (1, 4, "8. B\n\nlast")], "doc_id long, page int, text string")
    found = X.chunk_corpus(X.joined_pages(few))
    assert {r.chunk: r.page for r in X.pages_of(found, X.page_starts(few)).collect()} == {0: 1, 1: 4}


def test_cells_of_tables(spark):
    row = spark.createDataFrame([(["Stage", "", "Cover"], ["2", "odd", " 3% ", "more"])], "h array<string>, c array<string>")
    assert row.select(X.table_rows(F.col("h"), F.col("c"))).first()[0] == "Stage: 2 | odd | Cover: 3% | more"
