"""Validation ladders, loads, ledger and streams."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from riskloom import registry as R
from riskloom.operators import datasets, digests, evaluation, quality, ranking, retrieval, scorecard, text
from riskloom.sources import loads as L
from riskloom.sources.ledgered import LedgeredSource
from riskloom.streaming import streams

COLUMNS = ["obligor_id", "observation_date", "data_cutoff_date", "portfolio", "jurisdiction", "pit_pd", "days_past_due", "stage"]
GOOD = ("1", "2024-06-30", "2024-07-05", "sme", "SAMA", "0.1", "0", "1")


def broken(**cells):
    return tuple(cells.get(c, v) for c, v in zip(COLUMNS, GOOD, strict=True))


def file_of(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS))


def codes(spark, rows):
    return {(r.code, r.name): r.n for r in L.validate(file_of(spark, rows), R.OBLIGOR, "2025-01-01").collect()}


def test_each_rule(spark):
    rows = [GOOD, broken(obligor_id="2", stage="7"), broken(obligor_id="3", data_cutoff_date="2024-01-01"), broken(obligor_id="4", jurisdiction="FCA"), broken(obligor_id="5", pit_pd="1.5"), broken(obligor_id=None), broken(obligor_id="7", data_cutoff_date="2099-01-01"), GOOD]
    assert codes(spark, rows) == {("not_allowed", "stage"): 1, ("cutoff_before_observation", "data_cutoff_date"): 1, ("not_allowed", "jurisdiction"): 1, ("above_maximum", "pit_pd"): 1, ("missing_required", "obligor_id"): 1, ("future_data_cutoff", "data_cutoff_date"): 1, ("duplicate_grain", ""): 1}


def test_a_bad_type_stops_range_and_date_checks(spark):
    found = codes(spark, [broken(days_past_due="late"), broken(obligor_id="2", days_past_due="-1", data_cutoff_date="2024-01-01"), broken(obligor_id="3", days_past_due="2.5")])
    assert found == {("invalid_type", "days_past_due"): 2}


def test_empty_file(spark):
    assert codes(spark, []) == {("no_rows", ""): 1}


def test_formats(spark, tmp_path):
    df = file_of(spark, [GOOD, broken(obligor_id="2")])
    df.write.option("header", True).csv(str(tmp_path / "a"))
    df.write.json(str(tmp_path / "b"))
    df.write.parquet(str(tmp_path / "c"))
    for name, kind in (("a", "csv"), ("b", "json"), ("c", "parquet")):
        assert sorted(L.read_delivered(spark, str(tmp_path / name), kind, COLUMNS).collect()) == sorted(df.collect())
    with pytest.raises(ValueError):
        L.read_delivered(spark, "x", "xlsx", COLUMNS)


def test_append_replaces_only_its_own_load(spark, tmp_path):
    path = str(tmp_path / "source")
    assert L.append_load(file_of(spark, [GOOD]), R.OBLIGOR, path, 1) == 1
    two = file_of(spark, [broken(obligor_id="2"), broken(obligor_id="3")])
    assert L.append_load(two, R.OBLIGOR, path, 2) == 2 and L.append_load(two, R.OBLIGOR, path, 2) == 2
    assert {r.load_id: r.n_rows for r in L.ledger(spark.read.parquet(path)).collect()} == {1: 1, 2: 2}


def test_seed_refuses_a_missing_column(spark, tmp_path):
    with pytest.raises(ValueError):
        L.seed(file_of(spark, [GOOD]), R.OBLIGOR, str(tmp_path / "seed"))


def test_stream_quarantines_a_broken_batch_and_burns_no_number(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    target = LedgeredSource(spark, R.OBLIGOR, "obligor_monthly", at("source"), at("ledger"))
    run = lambda: streams.append_loads(spark, at("in"), COLUMNS, target, at("away"), at("check"), "2025-01-01").awaitTermination()
    for rows in ([GOOD], [broken(stage="9")], [GOOD], [broken(stage="3", data_cutoff_date="2024-10-01")]):
        file_of(spark, rows).coalesce(1).write.mode("append").json(at("in"))
        run()
    run()
    assert sorted((r.load_id, r.stage) for r in target.rows().collect()) == [(1, 1), (2, 3)]
    assert spark.read.parquet(at("away")).count() == 1
    found = {r.load_id: r for r in target.ledger().collect()}
    assert found[1].prev_hash == L.GENESIS and found[2].prev_hash == found[1].chain_hash and (found[2].restated_rows, found[2].row_count) == (1, 1)
    assert target.broken().count() == 0 and L.chain(target.ledger()).filter(F.col("load_id") == 2).first()["chain_hash"] == found[2].chain_hash


def test_a_crash_between_the_two_writes_leaves_one_ledger_row(spark, tmp_path, monkeypatch):
    at = lambda n: str(tmp_path / n)
    target = LedgeredSource(spark, R.OBLIGOR, "obligor_monthly", at("source"), at("ledger"))
    run = lambda: streams.append_loads(spark, at("in"), COLUMNS, target, at("away"), at("check"), "2025-01-01").awaitTermination()
    commit = LedgeredSource.commit
    file_of(spark, [GOOD, broken(obligor_id="2")]).coalesce(1).write.mode("append").json(at("in"))

    def before(self, entry):
        raise RuntimeError("crash before the commit")

    def after(self, entry):
        commit(self, entry)
        raise RuntimeError("crash after the commit")

    for crash in (before, after):
        monkeypatch.setattr(LedgeredSource, "commit", crash)
        with pytest.raises(StreamingQueryException):
            run()
        assert (target.rows() is None or target.rows().count() == 0) == (crash is before)
    monkeypatch.setattr(LedgeredSource, "commit", commit)
    run()
    assert [(r.load_id, r.row_count) for r in target.ledger().collect()] == [(1, 2)] and target.rows().count() == 2


def test_a_batch_rewrites_only_the_shards_of_its_keys(spark, tmp_path):
    rnd = random.Random(2)
    schema = "interaction_id long, seq long, root_cause string"
    log = [(rnd.randrange(60), i, rnd.choice("abc")) for i in range(200)]
    table = streams.KeyedTable(spark, str(tmp_path / "table"), ["interaction_id"], spark.createDataFrame([], schema).schema, shards=16)
    for version, rows in enumerate((log[:150], log[150:], [(3, 999, "z")])):
        touched = table.merge(streams.latest_feedback(spark.createDataFrame(rows, schema)), version, streams.latest_feedback)
        assert table.merge(spark.createDataFrame(rows, schema), version, streams.latest_feedback) == []  # the same batch again
    assert len(touched) == 1
    want = {}
    for i, seq, cause in [*log, (3, 999, "z")]:
        want[i] = max(want.get(i, (-1, "")), (seq, cause))
    assert {r.interaction_id: (r.seq, r.root_cause) for r in table.read().collect()} == want


def test_digest_trees(spark, monkeypatch):
    monkeypatch.setattr(digests, "LEAF", 3)

    def plain(lines):
        counted = Counter(hashlib.sha256(x.encode()).hexdigest() for x in lines)
        depth = sum(len(counted) > 3 * 16**j for j in range(12))
        sha = lambda xs: hashlib.sha256(",".join(xs).encode()).hexdigest()
        nodes = {}
        for s, c in counted.items():
            nodes.setdefault(s[:depth], []).append(f"{s}:{c}")
        nodes = {p: sha(sorted(xs)) for p, xs in nodes.items()}
        for level in range(depth - 1, -1, -1):
            up = {}
            for p in sorted(nodes):
                up.setdefault(p[:level], []).append(nodes[p])
            nodes = {p: sha(xs) for p, xs in up.items()}
        return nodes[""]

    rnd = random.Random(4)
    sets = {"one": ["x"], "few": ["a", "b", "a"], "hot": ["same"] * 500 + ["other"], None: [f"n{i}" for i in range(40)], "many": [f"line {rnd.randrange(900)}" for _ in range(1500)]}
    rows = [(k, x) for k, lines in sets.items() for x in lines]
    rnd.shuffle(rows)
    got = digests.tree(spark.createDataFrame(rows, "k string, x string").repartition(5), ["k"], F.col("x")).collect()
    assert {r.k: (r.n, r.digest) for r in got} == {k: (len(lines), plain(lines)) for k, lines in sets.items()}


def test_struct_of_a_table():
    s = R.struct_of(R.FACILITY)
    assert s["stage"].dataType.simpleString() == "bigint" and not s["obligor_id"].nullable


def test_budget_skips_and_goes_on(spark):
    rows = [(1, i, s, c, n) for i, (s, c, n) in enumerate([(0.9, 0.9, 7000), (0.8, 0.9, 6000), (0.7, 0.1, 10), (0.6, 0.8, 4000), (0.5, 0.8, 1001), (0.4, 0.8, 1000)])]
    got = retrieval.budgeted(spark.createDataFrame(rows, "question_id int, doc_id long, score double, cosine double, chars long")).orderBy("place").collect()
    assert [r.doc_id for r in got] == [0, 3, 5]


def test_hidden_chunks_change_nothing(spark):
    """Scores come from the visible chunks alone."""
    chunks = [(1, "alpha beta"), (2, "beta gamma"), (3, "alpha alpha secret")]
    ask = spark.createDataFrame([(7, 1, "alpha")], "question_id int, context_id int, text string")
    seen = spark.createDataFrame([(1, 1), (1, 2)], "context_id int, doc_id long")
    score = lambda some: [(r.doc_id, r.score) for r in ranking.bm25(spark.createDataFrame(some, "doc_id long, text string"), ask, seen).collect()]
    assert score(chunks) == score(chunks[:2]) and [d for d, _ in score(chunks)] == [1]


def test_vector_arm_ranks_all_visible_documents(spark, monkeypatch):
    rnd = random.Random(3)
    some = lambda n: " ".join(f"t{rnd.randrange(60)}" for _ in range(n))
    docs, asked = [(i, some(rnd.randint(1, 30))) for i in range(90)] + [(90, "...")], [(i, 1 + i % 2, some(6)) for i in range(12)]
    seen = [(c, i) for c in (1, 2) for i, _ in docs if rnd.random() < 0.7]

    def vector(t):
        v = [0] * 256
        for x in re.findall("[a-z0-9]+", t):
            h = hashlib.sha256(x.encode()).hexdigest()
            v[int(h[:8], 16) % 256] += 1 if int(h[8:10], 16) % 2 == 0 else -1
        size = math.sqrt(sum(x * x for x in v))
        return [x / size for x in v] if size else None

    of = {i: vector(t) for i, t in docs}
    want = set()
    for q, c, t in asked:
        scored = sorted((-math.floor(sum(x * y for x, y in zip(vector(t), of[i], strict=True)) * 1e6 + 0.5) / 1e6, i) for k, i in seen if k == c and of[i])
        want |= {(q, i, n + 1) for n, (_, i) in enumerate(scored[:7])}
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "question_id long, context_id int, text string"), spark.createDataFrame(seen, "context_id int, doc_id long")
    for questions, most in ((512, 4096), (5, 8)):
        monkeypatch.setattr(ranking, "BLOCK_QUESTIONS", questions)
        monkeypatch.setattr(ranking, "BLOCK_ROWS", most)
        assert {(r.question_id, r.doc_id, r["rank"]) for r in retrieval.hashed_nearest(*frames, 7).collect()} == want


def test_hybrid_finds_documents_outside_the_lexical_arm(spark):
    from riskloom.plans import retrieval as plans
    from riskloom.sources.views import Tables

    t = Tables(spark, "/root/testdata/sf0.01")
    lexical = plans._lexical(t).select("question_id", "doc_id")
    assert plans._gated(t).select("question_id", "doc_id").exceptAll(lexical).count() > 0


def test_unknown_role_sees_nothing(spark):
    assert spark.range(1).select(F.size(retrieval.levels_of(F.lit("visitor")))).first()[0] == 0


def test_split_keeps_groups_together(spark, data_dir):
    from riskloom.sources.views import Tables

    rows = datasets.frozen_split(Tables(spark, data_dir).records, "2023-06-01")
    assert datasets.conflicts(rows, "group_id", "split").count() == 0


def test_gate_without_evidence_is_not_passed(spark):
    rows = spark.createDataFrame([(1.0, 0), (1.0, 5), (0.5, 100), (0.96, 40), (1.0, 4000)], "s double, n long")
    got = [r[0] for r in rows.select(evaluation.gate_status(F.col("s"), F.col("n"), F.lit(0.95), F.lit(True))).collect()]
    assert got == ["not_applicable", "insufficient", "failed", "insufficient", "passed"]


def test_median_is_the_upper_middle_one(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (0, 3), (0, 5), (2, None)], "truth_idx int, pred_idx int")
    m = scorecard.pair_metrics(pairs).first()
    assert (m.median_notch_error, m.unparseable, m.mean_notch_error, m.exact_accuracy) == (3, 1, 2.25, 0.2)


def test_small_fragments_join_the_chunk_before(spark):
    rows = spark.createDataFrame([(1, 1, "1", "T", "x" * 200), (1, 2, "", "", "short"), (1, 3, "2", "U", "tiny")], "doc_id long, section int, number string, title string, text string")
    got = [(r.chunk, r.number, len(r.text)) for r in text.chunk_corpus(rows).orderBy("chunk").collect()]
    assert got == [(0, "1", 207), (1, "2", 4)]


def test_parts_of_repeated_lines_keep_their_pages(spark, tmp_path):
    from riskloom.plans.retrieval import page_for_chunk
    from riskloom.sources.views import Tables

    lines = ["licence " + "x" * 1400, "body " + "y" * 1300] * 60 + ["", "", "One sentence.  " * 300 + "End", "licence " + "x" * 1400]
    body = "\n".join(lines)
    spark.createDataFrame([(1, body)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    parts = spark.createDataFrame([(body,)], "t string").select(F.explode(text.packed_at(F.split("t", "\n"))).alias("p")).select("p.*").collect()
    for p in parts:
        head = p.text.split("\n\n")[0]
        assert body[p.at : p.at + len(head)] == head
    assert [p.at for p in parts] == sorted({p.at for p in parts})
    got = [r.page for r in page_for_chunk(Tables(spark, str(tmp_path))).orderBy("chunk").collect()]
    assert got == [body[: p.at].count("\n") // 20 for p in parts] and len(set(got)) == 7


def test_questions_have_one_form(spark):
    asked = ["What is  OBL 7 ?", "what is obl-0007"]
    got = {r[0] for r in spark.createDataFrame([(a,) for a in asked], "t string").select(quality.normal_question(F.col("t"))).collect()}
    assert got == {"what is OBL-0007"}


def test_numbers_in_texts(spark):
    row = spark.sql("select 'over 1,200.50 and 60' as t")
    assert row.select(quality.threshold_cited(F.lit(1200.5), F.col("t"))).first()[0] and not row.select(quality.threshold_cited(F.lit(12.0), F.col("t"))).first()[0]
