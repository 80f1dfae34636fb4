"""Assessments of answers whose metrics are known."""

from pyspark.sql import functions as F

from riskloom.operators import assessment as A
from riskloom.plans import drafts
from riskloom.sources.views import Tables

CHECK = {"text_expected": None, "value": None, "abs_tolerance": 0.0, "rel_tolerance": 0.0, "unit": None, "currency": None, "as_of_date": None, "outcome": None, "unit_path": None, "currency_path": None, "as_of_date_path": None}
CHECKS = "answer_id long, seq long, kind string, path string, text_expected string, value double, abs_tolerance double, rel_tolerance double, unit string, currency string, as_of_date string, outcome int, unit_path string, currency_path string, as_of_date_path string"
CASES = "answer_id long, seq long, passed boolean, refs array<string>, known array<string>, required_evidence array<string>, risk_drivers array<string>, drivers array<string>, must_abstain boolean, abstains boolean"


def assess(spark, answers, checks, cases):
    rows = spark.createDataFrame(answers, "answer_id long, seq long, task string, doc string").select("answer_id", "seq", "task", F.try_parse_json("doc").alias("document"))
    asked = spark.createDataFrame([(i, 0, kind, path, *(CHECK | more).values()) for i, kind, path, more in checks], CHECKS)
    found = A.assessed(rows, asked, spark.createDataFrame(cases, CASES))
    out = {}
    for r in found.collect():
        assert (r.answer_id, r.metric) not in out
        out[r.answer_id, r.metric] = r.value
    return out, A.checked(rows, asked)[0]


def test_every_metric(spark):
    doc = '{"status": "Answered", "list": ["B b", "a"], "n": {"value": 10.4, "unit": " PCT", "as_of_date": "2024-01-01"}, "when": "2023-12-31", "p": 0.8, "flag": true, "deep": {"unit": "x"}}'
    checks = [
        (1, "field", "status", {"text_expected": " answered "}), (1, "field", "list", {"text_expected": "A,b  B"}), (1, "field", "gone", {"text_expected": None}), (1, "field", "flag", {"text_expected": "no"}),
        (1, "numeric", "n.value", {"value": 10.0, "abs_tolerance": 0.5, "unit": "pct", "as_of_date": "2024-01-01"}), (1, "numeric", "n.value", {"value": 10.0, "rel_tolerance": 0.01}),
        (1, "numeric", "status", {"value": 1.0, "abs_tolerance": 9.0}), (1, "numeric", "n.value", {"value": 10.4, "unit": "x", "unit_path": "deep.unit", "as_of_date": "2023-12-31", "as_of_date_path": "when"}),
        (1, "confidence", "p", {"outcome": 1}), (1, "confidence", "status", {"outcome": 0}), (1, "plan", "status", {"text_expected": "answered"}),
        (2, "field", "status", {"text_expected": "x"}), (2, "numeric", "n", {"value": 1.0}), (2, "confidence", "p", {"outcome": 1}),
        (3, "plan", "portfolio", {"text_expected": "SME"}), (4, "plan", "portfolio", {"text_expected": "SME"}),
    ]
    cases = [
        (1, 0, True, ["E1", "E9", "E1"], ["E1", "E2"], ["E1", "E2"], ["Late  filing", "weak"], ["late filing", "other", "more"], True, False),
        (2, 0, True, ["E1"], ["E1"], ["E1"], [], [], True, True), (3, 0, True, [], [], [], None, [], False, False), (4, 0, True, [], [], [], None, [], False, False),
    ]
    answers = [(1, 0, "credit_analysis", doc), (2, 0, "credit_analysis", "{broken"), (3, 0, "query_plan", '{"portfolio": " sme"}'), (4, 0, "query_plan", None)]
    got, rows = assess(spark, answers, checks, cases)
    assert got == {
        (1, "json_validity"): 1.0, (1, "field:status"): 1.0, (1, "field:list"): 1.0, (1, "field:gone"): 1.0, (1, "field:flag"): 0.0, (1, "numerical_agreement"): 0.5,
        (1, "extractive_support_heuristic"): 1.0, (1, "citation_resolution"): 2 / 3, (1, "citation_recall"): 0.5, (1, "driver_recall"): 0.5, (1, "driver_precision"): 1 / 3,
        (1, "abstention_recall"): 0.0, (1, "confidence_brier_score"): (0.2**2 + 1) / 2,
        (2, "json_validity"): 0.0, (2, "field:status"): 0.0, (2, "numerical_agreement"): 0.0, (2, "extractive_support_heuristic"): 0.0, (2, "citation_recall"): 0.0, (2, "driver_recall"): 0.0, (2, "driver_precision"): 0.0, (2, "abstention_recall"): 0.0,
        (3, "json_validity"): 1.0, (3, "plan_validity"): 1.0, (3, "plan:portfolio"): 1.0,
        (4, "json_validity"): 0.0, (4, "plan_validity"): 0.0, (4, "compilation_success"): 0.0, (4, "plan:portfolio"): 0.0,
    }
    assert [(r.answer_id, r.path, r.confidence, r.outcome) for r in A.calibration(rows).collect()] == [(1, "p", 0.8, 1)]


def test_parts_of_drafts_are_not_broadcast(spark, data_dir):
    """Their files are small, their rows aren't."""
    parts = drafts._Parts.of(Tables(spark, data_dir))
    plan = parts.failures()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
