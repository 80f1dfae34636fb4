"""Training datasets from reviewed records: admission, splits without leaks, de-duplication, caps, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import registry as R
from riskloom.functions import columns as C
from riskloom.operators.digests import tree

LEAST_QUALITY = 4
TASKS = ("factsheet", "credit_deterioration", "ews_analysis", "email_draft", "policy_qa")


def admission_reasons() -> Column:
    """Why a reviewed record isn't admitted; empty if it is."""
    return C.named(
        ("not_approved", F.col("review_status") != "approved"),
        ("no_reviewer", F.col("reviewer").isNull()),
        ("low_quality", F.col("quality_score") < LEAST_QUALITY),
        ("not_releasable", ~F.col("classification").isin("synthetic", "masked")),
        ("no_group", F.col("group_id").isNull()),
        ("no_family", F.col("template_family").isNull()),
        ("no_situation", F.col("situation").isNull()),
    )


def admitted(records: DataFrame) -> DataFrame:
    return records.filter(F.size(admission_reasons()) == 0)


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order (dropDuplicates states none)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def frozen_split(rows: DataFrame, cutoff: str) -> DataFrame:
    """Split by group; a group with a record on or after the cutoff, or that falls to test, is test with all its records."""
    late = rows.filter(F.col("observed") >= F.lit(cutoff).cast("date")).select("group_id").distinct().withColumn("_late", F.lit(True))
    plain = C.stable_split(F.col("group_id"))
    joined = rows.join(late, "group_id", "left")  # a window would hold all of a large group in one task
    return joined.withColumn("split", F.when(F.col("_late") | (plain == "test"), "test").otherwise(plain)).drop("_late")


def without(rows: DataFrame, groups: DataFrame, hashes: DataFrame) -> DataFrame:
    """Records outside the excluded groups and contents."""
    return rows.join(groups.select("group_id").distinct(), "group_id", "left_anti").join(hashes.select("content_hash").distinct(), "content_hash", "left_anti")


def capped(rows: DataFrame, family: str, order: list[str], most: int = R.FAMILY_CAP) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(family).orderBy(*order))
    return rows.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")


def skeleton(*texts: Column) -> Column:
    """A text with its numbers taken out, lower-cased, space collapsed, hashed: clones have the same one."""
    plain = F.regexp_replace(F.concat_ws("\n", *texts), r"\d+(?:[.,]\d+)*", "<n>")
    return F.sha2(F.trim(F.regexp_replace(F.lower(plain), r"\s+", " ")), 256)


def conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that map to more than one value."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n")).filter("n > 1")


def contract(cases: DataFrame, cutoff: str) -> DataFrame:
    """(code, n): leaks and defects of a dataset with a part that lies out of time (`oot`).

    `cases`: record_id, group_id, template_family, split, observed, question, context, classification, source_hash, target,
    expected, equivalence_id, distinct_from (a list of record ids).
    """
    late, oot = F.col("observed") >= F.lit(cutoff).cast("date"), F.col("split") == "oot"
    one = lambda code, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(code).alias("code"), "n")
    controls = cases.select("record_id", F.explode("distinct_from").alias("control"))
    known = cases.select(F.col("record_id").alias("control")).distinct()
    signature = F.struct("context", "split", "expected")
    parts = [
        one("group_leakage", conflicts(cases, "group_id", "split")),
        one("family_leakage", conflicts(cases, "template_family", "split")),
        one("oot_before_cutoff", cases.filter(oot & ~late)),
        one("late_outside_oot", cases.filter(late & ~oot)),
        one("duplicate_case_id", cases.groupBy("record_id").count().filter("count > 1")),
        one("duplicate_question", cases.groupBy(F.lower(F.trim("question")).alias("q"), "context").count().filter("count > 1")),
        one("equivalence_differs", cases.filter("equivalence_id is not null").groupBy("equivalence_id").agg(F.count_distinct(F.to_json(signature)).alias("k")).filter("k > 1")),
        one("self_control", controls.filter("record_id = control")),
        one("unknown_control", controls.join(known, "control", "left_anti")),
        one("missing_target", cases.filter(F.col("split").isin("train", "valid") & F.col("target").isNull())),
        one("missing_expected", cases.filter(~F.col("split").isin("train") & F.col("expected").isNull())),
        one("not_releasable", cases.filter(~F.coalesce(F.col("classification").isin("synthetic", "masked"), F.lit(False)))),
        one("bad_source_hash", cases.filter(~F.coalesce(F.col("source_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("n > 0")


def manifest(rows: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(kind, key, value): counts, the split of each group, a hash of each split's content, exclusions, family, skeleton,
    situation and coverage counts, and a hash of all of it, by trees of hashes.

    `rows`: record_id, group_id, template_family, skeleton, situation, portfolio, content_hash, split; `exclusions`: kind, key.
    """
    text = lambda c: F.col(c).cast("string")
    per = lambda kind, *keys: rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(kind).alias("kind"), F.concat_ws("/", *keys).alias("key"), "value")
    parts = [per("count", "split"), per("family", "template_family"), per("skeleton", "skeleton"), per("situation", "situation"), per("coverage", "portfolio", "situation")]
    parts.append(rows.groupBy("group_id").agg(F.min("split").alias("value")).select(F.lit("group").alias("kind"), F.col("group_id").alias("key"), "value"))
    parts.append(tree(rows, ["split"], F.concat_ws(":", text("record_id"), "content_hash")).select(F.lit("file").alias("kind"), F.col("split").alias("key"), F.col("digest").alias("value")))
    parts.append(exclusions.select("kind", "key", F.lit("excluded").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sealed(rows: DataFrame) -> DataFrame:
    """A manifest with the hash of itself."""
    whole = tree(rows.withColumn("_all", F.lit("manifest")), ["_all"], F.concat_ws("|", "kind", "key", "value"))
    return rows.unionByName(whole.select(F.lit("manifest_hash").alias("kind"), F.lit("").alias("key"), F.col("digest").alias("value")))


def verify_manifest(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """(kind, key, status) of what a stored manifest says otherwise than the data: changed, missing or unexpected."""
    a, b = stored.select("kind", "key", F.col("value").alias("a")), recomputed.select("kind", "key", F.col("value").alias("b"))
    joined = a.join(b, ["kind", "key"], "full_outer")
    status = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "unexpected").when(F.col("a") != F.col("b"), "changed")
    return joined.select("kind", "key", status.alias("status")).filter("status is not null")


def diversity(rows: DataFrame, most: int = R.FAMILY_CAP) -> DataFrame:
    """Families and skeletons with too many records, families in more than one split, and families that need a near miss and
    have none."""
    over = lambda kind, key: rows.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(F.lit(kind).alias("kind"), "key", "n")
    leaks = conflicts(rows, "template_family", "split").select(F.lit("family_in_splits"), F.col("template_family"), "n")
    near = rows.groupBy("template_family").agg(F.bool_or("requires_near_miss").alias("due"), F.count_if(F.col("situation") == "near_miss").alias("n")).filter("due and n = 0")
    return over("family_over_cap", "template_family").union(over("skeleton_over_cap", "skeleton")).union(leaks).union(near.select(F.lit("missing_near_miss"), "template_family", "n"))


def task_type(name: Column) -> Column:
    """The task's name in the taxonomy; null if it is unknown."""
    plain = F.lower(F.trim(name))
    plain = F.when(plain == "ews", "ews_analysis").otherwise(plain)
    return F.when(plain.isin(*TASKS), plain)


def coverage(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Required cells with what is there, and whether it is enough."""
    dims = ["task", "portfolio", "jurisdiction", "situation"]
    actual = rows.groupBy(*dims).agg(F.count(F.lit(1)).alias("actual"))
    joined = targets.join(actual, dims, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return joined.withColumn("passed", F.col("actual") >= F.col("minimum"))


def feedback_status() -> Column:
    """How far a correction has come: the first thing that it still lacks."""
    return (
        F.when(F.col("correction").isNull(), "submitted").when(~F.col("correction_valid"), "invalid_correction").when(F.col("protected"), "protected_split_or_group")
        .when(F.col("expected_checks") == "", "needs_expected_results").when(F.col("root_cause") == "unknown", "untriaged").when(F.col("root_cause") != "model_behaviour", "component_feedback").otherwise("eligible_for_batch")
    )


def feedback_outcome() -> Column:
    """What becomes of a feedback record when a training batch is built."""
    eligible = F.col("eligible") & (F.col("root_cause") == "model_behaviour") & (F.coalesce("correction", F.lit("")) != "") & F.col("reviewer").isNotNull() & (F.col("review_status") == "approved") & (F.col("quality_score") >= LEAST_QUALITY)
    return (
        F.when(~F.coalesce(eligible, F.lit(False)), "not_eligible").when(~F.col("captured"), "skipped_no_captured_input").when(F.col("group_id").isNull(), "rejected_missing_group_id")
        .when(~F.col("correction_valid"), "not_admissible").otherwise("training_example")
    )


#: Where a root cause is mended.
ROUTES = {"data": "source", "schema": "registry", "query": "query_guard", "calculation": "formulas", "retrieval": "retrieval", "guardrail": "guardrails", "model_behaviour": "training"}


def increment(base: DataFrame, feedback: DataFrame, fraction: float = R.FEEDBACK_FRACTION) -> DataFrame:
    """Feedback that may join the training part of a base dataset, each with its outcome.

    At most fraction / (1 - fraction) of the base's training records join, family by family in order: a family that
    doesn't fit is skipped whole and the next one tried. The fold runs over families, not records.
    """
    known = base.select("content_hash").distinct().withColumn("in_base", F.lit(True))
    held = base.filter("split <> 'train'").select("group_id").distinct().withColumn("held", F.lit(True))
    rows = feedback.join(known, "content_hash", "left").join(held, "group_id", "left")
    rows = rows.withColumn("outcome", F.when(F.col("held"), "protected_group").when(F.col("in_base"), "duplicate_base")).drop("in_base", "held")
    open_ = rows.filter("outcome is null")
    limit = base.filter("split = 'train'").agg(F.floor(F.count(F.lit(1)) * (fraction / (1 - fraction)) + 1e-9).cast("long").alias("limit"))
    families = open_.groupBy("template_family").agg(F.min("record_id").alias("first"), F.count(F.lit(1)).alias("n"))
    ordered = families.agg(F.array_sort(F.collect_list(F.struct("first", "template_family", "n"))).alias("f")).join(F.broadcast(limit))  # one row each
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("taken"))

    def take(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["n"] <= F.col("limit")
        return F.when(fits, F.struct((acc["used"] + x["n"]).alias("used"), F.concat(acc["taken"], F.array(x["template_family"])).alias("taken"))).otherwise(acc)

    taken = ordered.select(F.explode(F.aggregate("f", start, take)["taken"]).alias("template_family")).withColumn("fits", F.lit(True))
    done = open_.join(taken, "template_family", "left").withColumn("outcome", F.when(F.col("fits"), "taken").otherwise("over_fraction")).drop("fits")
    return rows.filter("outcome is not null").unionByName(done)
