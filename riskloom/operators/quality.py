"""Guardrails, policy rules, tiers, citations and answer memory, for all answers in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import registry as R
from riskloom.functions import columns as C

# Patterns of prompt injection, on lower-cased text.
INJECTION = (r"ignore (all|any|the) previous instructions", r"reveal (the )?(system|developer) prompt", r"bypass (the )?(guardrails|policy|controls)", r"execute unrestricted sql")
# Phrases that decide an action's tier.
PROHIBITED = ("approve the facility", "decline the application", "approved the loan", "we hereby approve", "final credit decision", "override the model", "waive the covenant", "amend the policy")
HIGH_TIER = ("rating recommendation", "recommend downgrade", "recommend upgrade", "sicr", "stage migration", "reclassify to stage", "limit increase", "covenant breach", "write-off")
#: Which status of an answer goes before another.
PRECEDENCE = {"verified": 0, "system": 1, "model": 2, "invalid": 3}


def injected(text: Column) -> Column:
    return F.lower(text).rlike("|".join(INJECTION))


def _found(body: Column, phrases: tuple[str, ...]) -> Column:
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(body, p))


def tier(body: Column, analysis: Column, recommendation: Column, status: Column) -> Column:
    """The release tier of an answer, with its reasons sorted."""
    base = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in R.ANALYSIS_TIERS.items() for x in kv)), analysis), F.lit("medium"))
    bad, high = _found(body, PROHIBITED), _found(body, HIGH_TIER)
    recommends, escalates = F.coalesce(recommendation != "", F.lit(False)), status == "ESCALATE"
    lifted = recommends & (base == "low") & (F.size(high) == 0)
    level = F.when(F.size(bad) > 0, "prohibited").when((F.size(high) > 0) | escalates, "high").when(lifted, "medium").otherwise(base)
    label = lambda name, a: F.transform(a, lambda p: F.concat(F.lit(f"{name}:"), F.replace(p, F.lit(" "), F.lit("_"))))
    soft = F.array_compact(F.array(F.when(lifted, "carries_a_recommendation"), F.when(escalates, "model_requested_escalation")))
    reasons = F.when(F.size(bad) > 0, label("prohibited_action", bad)).otherwise(F.concat(label("material_conclusion", high), soft))
    return F.struct(level.alias("tier"), F.array_sort(F.array_distinct(reasons)).alias("reasons"))


#: Rules up to which a registry is broadcast.
MOST_RULES = 100_000


def applicable(rows: DataFrame, rules: DataFrame, day: Column) -> DataFrame:
    """Rows with each rule that applies to them by jurisdiction, portfolio and date."""
    named = rules.withColumnRenamed("jurisdiction", "for_jurisdiction")
    named = F.broadcast(named) if rules.count() <= MOST_RULES else named
    fits = (F.col("jurisdiction") == F.col("for_jurisdiction")) & F.array_contains("portfolios", F.col("portfolio"))
    return rows.join(named, fits & (F.col("effective_from") <= day) & (F.col("effective_to").isNull() | (F.col("effective_to") >= day)))


def evaluate_rules(factsheets: DataFrame, rules: DataFrame, evidence: DataFrame, as_of: str) -> DataFrame:
    """(obligor_id, rule_id, outcome, reason): fired, not_fired or unevaluable.

    Rules are a registry of a few rows, so they are broadcast; a rule applies by jurisdiction, portfolio and date.
    """
    joined = applicable(factsheets, rules, F.lit(as_of).cast("date"))
    joined = joined.join(F.broadcast(evidence.select("evidence_id", F.col("text").alias("evidence_text"))), "evidence_id", "left")
    value, threshold = F.col("value"), F.col("threshold")
    fires = reduce(lambda acc, kv: acc.when(F.col("operator") == kv[0], kv[1](value, threshold)), C.COMPARISONS.items(), F.when(F.lit(False), F.lit(False)))
    reason = (
        F.when(F.col("metric_status").isNull(), "metric_absent").when(F.col("metric_status") == "warning", "metric_missing").when(F.col("metric_status") == "invalid", "metric_invalid")
        .when(F.col("metric_unit") != F.col("unit"), "unit_mismatch").when(F.col("evidence_text").isNull(), "evidence_absent").when(~threshold_cited(threshold, F.col("evidence_text")), "threshold_not_cited")
    )
    outcome = F.when(reason.isNotNull(), "unevaluable").when(fires, "fired").otherwise("not_fired")
    return joined.select("obligor_id", "rule_id", outcome.alias("outcome"), reason.alias("reason"))


def numbers(text: Column) -> Column:
    """Numbers in a text, thousands separators removed."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))


def threshold_cited(threshold: Column, text: Column) -> Column:
    return F.exists(numbers(text), lambda x: F.abs(x - threshold) <= F.greatest(F.abs(x), F.abs(threshold)) * 1e-9)


def plain(text: Column) -> Column:
    """Space collapsed, closing full stops off, lower-cased."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"\.+$", ""))


def supported(statement: Column, source: Column) -> Column:
    """Whether a statement is one sentence of its source; an empty one isn't."""
    sentences = F.split(source, r"(?<=[.!?])\s+|\n+")
    return F.coalesce((plain(statement) != "") & F.array_contains(F.transform(sentences, plain), plain(statement)), F.lit(False))


def normal_question(text: Column) -> Column:
    """Space collapsed, closing marks stripped, lower-cased; each entity id in one form: kind, four digits at least, suffix."""
    x = F.lower(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"[?.! ]+$", ""))
    x = F.regexp_replace(x, r"\b(obl|fac)[-_ ]?0*(\d+)(?:[-_ ]0*(\d+))?\b", "\u0001$1\u0002000$2\u0003$3\u0004")
    for kind in ("obl", "fac"):
        x = F.replace(x, F.lit(f"\u0001{kind}"), F.lit(kind.upper()))
    x = F.regexp_replace(x, "\u00020{0,3}(\\d{4,})", "-$1")
    return F.regexp_replace(F.replace(x, F.lit("\u0003\u0004"), F.lit("")), "\u0003(\\d+)\u0004", "-$1")


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("seq").desc()))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def lookup(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key the answer of the best status, the newest within it."""
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in PRECEDENCE.items() for x in kv)), F.col("status"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(rank, F.col("seq").desc(), F.col("answer_id").desc()))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def previous(rows: DataFrame) -> DataFrame:
    """For each answer, the newest reusable one to the same question in another context."""
    other = rows.filter("status in ('verified', 'system')").select("question_id", F.col("context_id").alias("c"), F.struct("seq", "answer_id").alias("o"))
    best = other.groupBy("question_id", "c").agg(F.max("o").alias("o"))
    joined = rows.select("answer_id", "seq", "question_id", "context_id").join(best, "question_id").filter("context_id <> c")
    return joined.groupBy("answer_id", "seq").agg(F.max("o").alias("o")).select("answer_id", "seq", F.col("o.answer_id").alias("previous_id"))


def changed(*names: str) -> Column:
    """The names whose values differ between structs a and b; nulls are equal."""
    return F.array_compact(F.array(*(F.when(~F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")), F.lit(n)) for n in names)))
