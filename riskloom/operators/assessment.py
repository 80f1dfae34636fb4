"""Answers as JSON against what their cases expect: every metric of every answer as a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.operators import leaves
from riskloom.sources.shared import written

KEYS = ["answer_id", "seq"]
CREDIT = "credit_analysis"
#: What may be expected beside a number.
BESIDE = ("unit", "currency", "as_of_date")


def normal(text: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def checked(answers: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The checks with passed and confidence, and the answers with valid. `answers`: keys, task, document (a variant; null if the answer
    isn't one of the schema).

    `checks`: keys, kind, path and what is expected: of a field or a plan's key text (for a list of plain values, these joined by
    commas); of a numeric value, abs_tolerance, rel_tolerance and, each if it matters, unit, currency, as_of_date, which stand
    beside it or at unit_path, currency_path, as_of_date_path; of a confidence outcome (0 or 1).
    """
    known = answers.select(*KEYS, "task", F.col("document").isNotNull().alias("valid"), "document")
    valid = known.drop("document")
    expected = lambda c: F.array_join(F.array_sort(F.transform(F.split(c, ","), normal)), ",")
    rows = leaves.fields(checks.join(known, KEYS), "document", "path", "_f")
    listed = F.array_join(F.array_sort(F.transform(leaves.members(F.col("_f.value")), normal)), ",")
    rows = rows.withColumns({"is": F.col("_f.kind"), "text": F.col("_f.text"), "number": F.col("_f.number"), "_listed": F.when(F.col("_f.kind") == "list", listed)}).drop("_f")
    near = F.abs(F.col("number") - F.col("value")) <= F.greatest("abs_tolerance", F.col("rel_tolerance") * F.greatest(F.abs("number"), F.abs("value")))
    right = F.coalesce(C.finite(F.col("number")) & near, F.lit(False))
    for name in BESIDE:
        place = F.coalesce(f"{name}_path", F.concat(F.regexp_replace("path", r"\.?[^.]*$", ""), F.lit(f".{name}")))
        rows = leaves.fields(rows.withColumn("_path", F.when(F.col(name).isNotNull(), place)), "document", "_path", "_f")
        rows = rows.withColumn(f"_{name}", F.col("_f.text")).drop("_f", "_path")
        right = right & (F.col(name).isNull() | normal(F.col(f"_{name}")).eqNullSafe(normal(F.col(name))))
    said = F.when(F.col("is") == "list", F.coalesce("_listed", F.lit("")).eqNullSafe(expected(F.col("text_expected")))).otherwise(normal(F.col("text")).eqNullSafe(normal(F.col("text_expected"))))
    passed = F.when(F.col("kind") == "numeric", right).when(F.col("kind") == "confidence", F.col("number").isNotNull() & F.col("outcome").isin(0, 1)).otherwise(said)
    rows = rows.withColumn("passed", F.col("valid") & F.coalesce(passed, F.lit(False)))
    return rows.select(*KEYS, "task", "valid", "kind", "path", "passed", F.col("number").alias("confidence"), "outcome"), valid


def calibration(rows: DataFrame) -> DataFrame:
    """(keys, path, confidence, outcome) of the confidences that can be compared. `rows`: as the first of `checked`."""
    return rows.filter("kind = 'confidence' and passed").select(*KEYS, "path", "confidence", "outcome")


def assessed(answers: DataFrame, checks: DataFrame, cases: DataFrame) -> DataFrame:
    """(keys, metric, value) of every metric that an answer's case asks for. An answer that isn't valid has 0 in each of them.

    `cases`: keys, passed (whether the output checks found nothing), refs (cited ids), known (ids that may be cited),
    required_evidence, risk_drivers (null: not asked for), drivers, must_abstain, abstains.
    """
    rows, valid = checked(answers, checks)
    rows = written(rows, "checked")
    flag = F.col("passed").cast("double")
    own = rows.filter("kind = 'field' or (kind = 'plan' and task <> 'credit_analysis')").select(*KEYS, F.concat_ws(":", "kind", "path").alias("metric"), flag.alias("value"))
    numbers = rows.filter("kind = 'numeric'").groupBy(*KEYS).agg(F.avg(flag).alias("value")).select(*KEYS, F.lit("numerical_agreement").alias("metric"), "value")
    error = F.when(F.col("passed"), F.pow(F.col("confidence") - F.col("outcome"), 2.0)).otherwise(1.0)
    brier = rows.filter("kind = 'confidence' and valid and task = 'credit_analysis'").groupBy(*KEYS).agg(F.avg(error).alias("value")).select(*KEYS, F.lit("confidence_brier_score").alias("metric"), "value")

    c = cases.join(valid, KEYS)
    ok, size = F.col("valid"), F.size
    distinct = lambda n: F.array_distinct(F.transform(n, normal))
    share = lambda some, whole, empty: F.when(size(whole) > 0, size(F.array_intersect(some, whole)) / size(whole)).otherwise(empty)
    wanted, have, required = distinct("risk_drivers"), distinct("drivers"), F.array_distinct("required_evidence")
    none = lambda n: (size(n) == 0).cast("double")
    of_credit = [
        ("extractive_support_heuristic", F.lit(True), F.col("passed").cast("double"), True),
        ("citation_resolution", size("refs") > 0, size(F.filter("refs", lambda x: F.array_contains("known", x))) / size("refs"), False),
        ("citation_recall", size("required_evidence") > 0, share(F.array_distinct("refs"), required, F.lit(0.0)), True),
        ("driver_recall", F.col("risk_drivers").isNotNull(), share(have, wanted, none(have)), True),
        ("driver_precision", F.col("risk_drivers").isNotNull(), share(wanted, have, none(wanted)), True),
        ("abstention_recall", F.col("must_abstain"), F.col("abstains").cast("double"), True),
        ("abstention_precision", F.col("abstains"), F.col("must_abstain").cast("double"), False),
    ]
    credit = F.col("task") == CREDIT
    entry = lambda name, value: F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
    found = [F.when(F.coalesce(credit & asked & (ok | F.lit(when_invalid)), F.lit(False)), entry(name, F.when(ok, value).otherwise(0.0))) for name, asked, value, when_invalid in of_credit]
    found += [entry("json_validity", ok), F.when(~credit, entry("plan_validity", ok)), F.when(~credit & ~ok, entry("compilation_success", F.lit(0.0)))]
    others = c.select(*KEYS, F.explode(F.array_compact(F.array(*found))).alias("m")).select(*KEYS, "m.metric", "m.value")
    return reduce(DataFrame.union, [own, numbers, brier, others])
