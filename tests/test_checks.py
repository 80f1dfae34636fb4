"""Question forms, support, rounding, drafts, windows and access on small rows whose answers are known."""

import datetime
import hashlib
import math
import random

from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.operators import datasets, drafts, evaluation, quality, resampling, retrieval

KEY = {"answer_id": 1, "seq": 0}


def test_each_id_of_a_question_keeps_its_own_number(spark):
    asked = {
        "Is OBL-12345 like obl 7 or fac 9?": "is OBL-12345 like OBL-0007 or FAC-0009", "  What   is the DSCR of obl_0008 ?!. ": "what is the dscr of OBL-0008", "fac0001-02": "FAC-0001-2",
        "obl 000": "OBL-0000", "FAC 12 7 and obl-1": "FAC-0012-7 and OBL-0001", "No entity. ": "no entity", "?What": "?what", "global obl": "global obl",
    }
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select("q", quality.normal_question(F.col("q")).alias("n")).collect()
    assert {r.q: r.n for r in rows} == asked


def test_support_is_a_whole_sentence(spark):
    cases = [("Exposure rose", "Exposure rose. Next one.", True), ("exposure  ROSE.", "First.\nExposure rose", True), ("", "Exposure rose.", False), ("...", "... a", False), ("Exposure", "Exposure rose.", False), ("Next one", "Exposure rose. Next one.", True), ("x", None, False)]
    rows = spark.createDataFrame(cases, "s string, t string, want boolean")
    assert rows.filter(quality.supported(F.col("s"), F.col("t")) != F.col("want")).count() == 0


def test_fixed_keeps_large_values(spark):
    rows = [r.v for r in spark.createDataFrame([(2.5e13,), (1.0000005,), (-1.5,), (1e300,)], "x double").select(C.fixed(F.col("x"), 6).alias("v")).collect()]
    assert rows == [2.5e13, 1.000001, -1.5, 1e300]


def test_resamples_follow_a_poisson_law(spark):
    assert abs(evaluation.POISSON_STEPS[0] - math.exp(-1)) < 1e-15 and abs(evaluation.POISSON_STEPS[-1] - 1) < 1e-9
    rows = spark.createDataFrame([("a", i, float(i % 4 == 0)) for i in range(400)] + [("b", 1, 0.5)], "k string, item long, v double")
    got = {r.k: r for r in evaluation.bootstrap(rows, ["k"], "item", "v").collect()}
    assert got["a"].n == 400 and 0.19 < got["a"].low < 0.225 < 0.275 < got["a"].high < 0.31
    assert (got["b"].low, got["b"].high) == (0.5, 0.5)


SHEETS = [(7, "utilisation_pct", 62.5, "pct", "valid"), (7, "dscr", None, "x", "warning")]
SOURCES = [(1, 0, "E1", "SAMA", "Above 60 per cent is watched. Exposure rose."), (1, 0, "E2", "CBUAE", "The limit stands.")]
D = "struct<metric:string,observed:double,unit:string,operator:string,threshold:double,holds:boolean,evidence_id:string,rule_id:string>"


def derivation(**changes):
    d = {"metric": "utilisation_pct", "observed": 62.5, "unit": "pct", "operator": "gte", "threshold": 60.0, "holds": True, "evidence_id": "E1", "rule_id": None} | changes
    return tuple(d.values())


def checked(spark, d, cites=("E1",)):
    facts = spark.createDataFrame([(1, 0, 0, 7, list(cites), d)], f"answer_id long, seq long, fact_no int, obligor_id long, cites array<string>, d {D}")
    sheets = spark.createDataFrame(SHEETS, "obligor_id long, metric string, value double, metric_unit string, metric_status string")
    sources = spark.createDataFrame(SOURCES, "answer_id long, seq long, evidence_id string, jurisdiction string, text string")
    rules = spark.createDataFrame([(7, "r1", "utilisation_pct", "pct", "gt", "E1", 60.0, True)], "obligor_id long, rule_id string, metric string, unit string, operator string, evidence_id string, threshold double, holds boolean")
    row = drafts.derivation_failures(facts, sheets, sources, rules).first()
    return row.failures, row.contradicts


def test_derivations(spark):
    assert checked(spark, derivation()) == ([], False)
    assert checked(spark, derivation(observed=61.0)) == (["observed_value_mismatch"], False)
    assert checked(spark, derivation(unit="x", holds=False)) == (["comparison_result_mismatch", "unit_mismatch"], False)
    assert checked(spark, derivation(metric="none")) == (["metric_not_found"], False)
    assert checked(spark, derivation(metric="dscr")) == (["metric_not_valid"], False)
    assert checked(spark, derivation(threshold=61.0)) == (["threshold_not_in_evidence"], False)
    assert checked(spark, derivation(evidence_id="E9")) == (["threshold_evidence_not_cited_by_claim", "threshold_evidence_not_found"], False)
    assert checked(spark, derivation(rule_id="r1")) == (["rule_operator_mismatch"], False)
    assert checked(spark, derivation(rule_id="r1", operator="gt", holds=False)) == (["comparison_result_mismatch"], True)
    assert checked(spark, derivation(rule_id="r9")) == (["rule_not_found"], False)
    assert checked(spark, derivation(observed=float("nan")))[0] == ["nonfinite_comparison", "observed_value_mismatch"]


def test_output_failures_and_admission(spark):
    sources = spark.createDataFrame(SOURCES, "answer_id long, seq long, evidence_id string, jurisdiction string, text string")
    facts = spark.createDataFrame([(1, 0, 0, "Exposure rose", ["E1"]), (1, 0, 1, "Not said", ["E1", "E7"]), (1, 0, 2, "Exposure rose", [])], "answer_id long, seq long, fact_no int, statement string, cites array<string>")
    rows = [(1, 0, ["The limit stands", "", "Other words"], ["E9"], "Raise it", False, "h")]
    drafted = spark.createDataFrame(rows, "answer_id long, seq long, narrative array<string>, structured array<string>, recommendation string, human_approval boolean, content_hash string")
    none = spark.createDataFrame([], "answer_id long, seq long, fact_no int, failures array<string>, rule_id string, contradicts boolean")
    found = drafts.output_failures(drafted, facts, sources, none)
    want = ["credit_recommendation_requires_human_approval", "material_fact_without_citation", "unknown_citation:E7", "unknown_citation:E9", "unsupported_claim", "unverified_narrative"]
    assert sorted(r.failure for r in found.collect()) == want
    only_soft = found.filter(F.col("failure").isin(*drafts.SOFT))
    review = lambda h: spark.createDataFrame([(1, 0, "r", "approved", True, True, h)], "answer_id long, seq long, reviewer string, status string, semantic_supported boolean, numerics_verified boolean, content_hash string")
    left = lambda f, h: drafts.admission(drafted, f, facts, sources, none, review(h)).first().failures
    assert left(only_soft, "h") == [] and left(only_soft, "older") == ["semantic_and_numeric_review_required"]
    assert left(found, "h") == [w for w in want if w not in drafts.SOFT]


def test_decision_fields(spark):
    facts = [(1, 0, 0, "It migrated from stage 1 to 3", ["E2"]), (1, 0, 1, "Stage was 2 before", ["E1"]), (1, 0, 2, "The current credit stage for OBL-0003 is 1", ["E1"])]
    rows = spark.createDataFrame(facts, "answer_id long, seq long, fact_no int, statement string, cites array<string>")
    drafted = spark.createDataFrame([(1, 0, True, "ANSWERED", "  Keep\nLimit ", "b  X,a", None), (2, 0, False, "ANSWERED", "", "", None)], "answer_id long, seq long, valid boolean, answer_status string, recommendation string, drivers string, conclusion_stage int")
    got = {r.answer_id: r.fields for r in drafts.decision_fields(drafted, rows).collect()}
    assert tuple(got[1]) == ("ANSWERED", 1, "a,b x", "keep limit", "E1,E2") and got[2] is None


def day(text):
    return datetime.date.fromisoformat(text)


def test_windows_by_versions_declarations_and_replacements(spark):
    rows = [(1, "a", "approved", day("2020-01-01"), None, None), (2, "a", "approved", day("2021-01-01"), day("2021-03-01"), None), (3, "a", "draft", day("2020-06-01"), None, None), (4, "b", "approved", day("2020-09-01"), None, "a"), (5, "a", "approved", day("2021-01-01"), None, None)]
    df = spark.createDataFrame(rows, "doc_id long, document_id string, approval_status string, effective_from date, declared_to date, supersedes_document_id string")
    got = {r.doc_id: (r.effective_to, r.superseded_by) for r in retrieval.supersession(df).collect()}
    assert got == {1: (day("2020-08-31"), 4), 2: (day("2021-03-01"), None), 3: (day("2020-08-31"), 4), 4: (None, None), 5: (None, None)}


def test_access_needs_every_rule(spark):
    base = {"doc_id": 1, "jurisdiction": "SAMA", "approval_status": "approved", "confidentiality_level": "internal", "allowed_roles": "", "portfolios": "", "effective_from": day("2020-01-01"), "effective_to": None}
    changes = [{}, {"jurisdiction": "CBUAE"}, {"approval_status": "draft"}, {"confidentiality_level": "restricted"}, {"allowed_roles": "regulator_liaison"}, {"allowed_roles": "credit_analyst,other"}, {"portfolios": "sme"}, {"portfolios": "retail,sme"}, {"effective_from": day("2023-01-01")}, {"effective_to": day("2021-01-01")}]
    chunks = spark.createDataFrame([tuple((base | c | {"doc_id": i}).values()) for i, c in enumerate(changes)], "doc_id long, jurisdiction string, approval_status string, confidentiality_level string, allowed_roles string, portfolios string, effective_from date, effective_to date")
    contexts = spark.createDataFrame([(1, "credit_analyst", "SAMA", day("2022-01-01"), "retail"), (2, "credit_analyst", "SAMA", day("2022-01-01"), None), (3, "nobody", "SAMA", day("2022-01-01"), None)], "context_id int, role string, jurisdiction string, as_of date, portfolio string")
    got = sorted(map(tuple, retrieval.visible(chunks, contexts).collect()))
    assert got == [(1, 0), (1, 5), (1, 7), (2, 0), (2, 5), (2, 6), (2, 7)]


def test_a_seal_tells_of_every_change(spark):
    rows = spark.createDataFrame([("count", "train", "3"), ("group", "g1", "train")], "kind string, key string, value string")
    sealed = datasets.sealed(rows)
    assert datasets.verify_manifest(sealed, sealed).count() == 0
    other = datasets.sealed(rows.withColumn("value", F.regexp_replace("value", "3", "4")))
    assert {(r.kind, r.status) for r in datasets.verify_manifest(sealed, other).collect()} == {("count", "changed"), ("manifest_hash", "changed")}


def test_the_embedder_signs_its_vectors(spark):
    one, other = retrieval.HashingEmbedder(), retrieval.HashingEmbedder(128)
    assert one.signature != other.signature
    texts = spark.createDataFrame([(1, "Late late filing")], "id long, text string")
    got = {r.bucket: r.weight for r in one.embed(texts, "id").collect()}
    bucket = lambda w: int(hashlib.sha256(w.encode()).hexdigest()[:8], 16) % 256
    assert abs(abs(got[bucket("late")]) - 2 / math.sqrt(5)) < 1e-12 and abs(abs(got[bucket("filing")]) - 1 / math.sqrt(5)) < 1e-12
    assert one.embed_query(texts, "id").count() == len(got)


def test_a_review_is_void_after_any_edit(spark):
    """A change of the draft, a fact, a citation, a derivation, a source or the factsheet."""
    D = drafts
    target = ["summary", "answer_status"]
    rows = {
        "drafts": ([(1, 0, 5, "Paraphrased", "ANSWERED", ["Paraphrased"], [], "", True)], "answer_id long, seq long, obligor_id long, summary string, answer_status string, narrative array<string>, structured array<string>, recommendation string, human_approval boolean"),
        "facts": ([(1, 0, 0, 5, "Exposure rose", ["E1"], None), (1, 0, 1, 5, "Beyond", ["E1"], ("utilisation_pct", 61.0, "pct", "gt", 60.0, True, "E1", None))], "answer_id long, seq long, fact_no int, obligor_id long, statement string, cites array<string>, d struct<metric:string,observed:double,unit:string,operator:string,threshold:double,holds:boolean,evidence_id:string,rule_id:string>"),
        "sources": ([(1, 0, "E1", "SAMA", "Exposure rose. Above 60 per cent.")], "answer_id long, seq long, evidence_id string, jurisdiction string, text string"),
        "sheets": ([(5, "utilisation_pct", 61.0, "pct", "valid")], "obligor_id long, metric string, value double, metric_unit string, metric_status string"),
    }
    rules = spark.createDataFrame([], "obligor_id long, rule_id string, metric string, unit string, operator string, evidence_id string, threshold double, holds boolean")
    frame = lambda name, edit: spark.createDataFrame([edit.get(name, lambda r: r)(r) for r in rows[name][0]], rows[name][1])

    def judged(edit, review):
        f = {n: frame(n, edit) for n in rows}
        known = D.content_hash(f["drafts"], f["facts"], f["sources"], f["sheets"], target)
        found = D.derivation_failures(f["facts"], f["sheets"], f["sources"], rules)
        failures = D.output_failures(known, f["facts"], f["sources"], found)
        reviews = spark.createDataFrame([(1, 0, "r", "approved", True, True, review or "")], "answer_id long, seq long, reviewer string, status string, semantic_supported boolean, numerics_verified boolean, content_hash string")
        return known.first()["content_hash"], D.admission(known, failures, f["facts"], f["sources"], found, reviews).first()["failures"]

    approved, without = judged({}, None)
    assert without == ["semantic_and_numeric_review_required"] and judged({}, approved) == (approved, [])
    edits = [
        {"drafts": lambda r: (*r[:4], "ESCALATE", *r[5:])},
        {"facts": lambda r: (*r[:4], "Exposure  rose.", *r[5:]) if r[2] == 0 else r},
        {"facts": lambda r: (*r[:5], ["E1", "E1"], r[6]) if r[2] == 0 else r},
        {"facts": lambda r: (*r[:6], (*r[6][:1], 61.00000000001, *r[6][2:])) if r[2] == 1 else r},
        {"sources": lambda r: (*r[:4], r[4] + " More.")},
        {"sheets": lambda r: (*r[:2], 61.00000000001, *r[3:])},
    ]
    for edit in edits:
        digest, failures = judged(edit, approved)
        assert digest != approved and failures == ["semantic_and_numeric_review_required"], edit


def test_weights_of_many_digests_at_once():
    rnd = random.Random(2)
    tails = [("|" + "é" * rnd.randint(0, 90) + str(rnd.random())).encode() for _ in range(60)] + [b"|"]
    heads = [str(i).encode() for i in range(1, 1001, 37)]
    got = resampling.weights(heads, tails, evaluation.POISSON_STEPS)
    for i, head in enumerate(heads):
        for j, tail in enumerate(tails):
            u = int(hashlib.md5(head + tail).hexdigest()[:8], 16) / 2**32
            assert got[i, j] == sum(u >= step for step in evaluation.POISSON_STEPS)


def test_a_bootstrap_is_dealt_to_tasks(spark, monkeypatch):
    """However few files the cases lie in, their digests are made by several tasks."""
    monkeypatch.setattr(evaluation, "DRAWS", 100_000)
    rows = spark.createDataFrame([(k, i, float(i % 3 == 0)) for k in "ab" for i in range(300)], "k string, item long, v double").coalesce(1)
    found = evaluation.bootstrap(rows, ["k"], "item", "v")
    assert "RoundRobinPartitioning(6)" in found._jdf.queryExecution().executedPlan().toString()
    assert all(0.2 < r.low < 1 / 3 < r.high < 0.5 for r in found.collect())
