"""Queries of dataset building and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.catalog import query
from riskloom.functions import columns as C
from riskloom.operators import datasets as D
from riskloom.operators import digests
from riskloom.operators.digests import tree_sql
from riskloom.plans.sources import _scratch
from riskloom.sources.views import Tables

CUTOFF = "2023-06-01"


@query("""
SELECT record_id, array_to_string(list_filter([CASE WHEN review_status <> 'approved' THEN 'not_approved' END, CASE WHEN reviewer IS NULL THEN 'no_reviewer' END, CASE WHEN quality_score < 4 THEN 'low_quality' END,
  CASE WHEN classification NOT IN ('synthetic', 'masked') THEN 'not_releasable' END], lambda x: x IS NOT NULL), ',') AS reasons FROM records
""")
def review_admission(t: Tables) -> DataFrame:
    return t.records.select("record_id", F.concat_ws(",", D.admission_reasons()).alias("reasons"))


_ADMITTED = "SELECT *, sha256(text) AS content_hash FROM records WHERE review_status = 'approved' AND reviewer IS NOT NULL AND quality_score >= 4 AND classification IN ('synthetic', 'masked')"
_BUCKET = "CAST(concat('0x', substr(sha256({0}), 1, 8)) AS BIGINT) % 100"
_PLAIN = f"CASE WHEN {_BUCKET.format('group_id')} < 70 THEN 'train' WHEN {_BUCKET.format('group_id')} < 85 THEN 'valid' ELSE 'test' END"
_DEDUPED = f"SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY record_id) AS k FROM ({_ADMITTED}) a) WHERE k = 1"
_FROZEN = f"SELECT *, CASE WHEN bool_or(observed >= DATE '{CUTOFF}') OVER (PARTITION BY group_id) OR {_PLAIN} = 'test' THEN 'test' ELSE {_PLAIN} END AS split FROM ({_DEDUPED}) d"


def _admitted(t: Tables) -> DataFrame:
    return D.admitted(t.records).withColumn("content_hash", D.content_hash(F.col("text")))


def _built(t: Tables) -> DataFrame:
    return D.frozen_split(D.first_by(_admitted(t), ["content_hash"], ["record_id"]), CUTOFF)


@query(f"SELECT record_id, content_hash FROM ({_DEDUPED}) d")
def dedupe_content(t: Tables) -> DataFrame:
    return D.first_by(_admitted(t), ["content_hash"], ["record_id"]).select("record_id", "content_hash")


@query(f"SELECT record_id, group_id, {_PLAIN} AS split FROM records")
def stable_split(t: Tables) -> DataFrame:
    return t.records.select("record_id", "group_id", C.stable_split(F.col("group_id")).alias("split"))


@query(f"SELECT record_id, group_id, split FROM ({_FROZEN}) f")
def freeze_future_groups(t: Tables) -> DataFrame:
    return _built(t).select("record_id", "group_id", "split")


@query(f"""
SELECT record_id FROM ({_DEDUPED}) d WHERE group_id NOT IN (SELECT DISTINCT group_id FROM records WHERE record_id % 53 = 0) AND content_hash NOT IN (SELECT sha256(text) FROM records WHERE record_id % 31 = 0)
""")
def anti_excluded(t: Tables) -> DataFrame:
    rows = D.first_by(_admitted(t), ["content_hash"], ["record_id"])
    hashes = t.records.filter("record_id % 31 = 0").select(D.content_hash(F.col("text")).alias("content_hash"))
    return D.without(rows, t.records.filter("record_id % 53 = 0"), hashes).select("record_id")


@query(f"SELECT record_id FROM ({_ADMITTED}) a WHERE group_id NOT IN (SELECT group_id FROM ({_FROZEN}) f WHERE split <> 'train')")
def anti_protected_groups(t: Tables) -> DataFrame:
    protected = _built(t).filter("split <> 'train'").select("group_id").distinct()
    return _admitted(t).join(protected, "group_id", "left_anti").select("record_id")


@query("SELECT obligor, count(DISTINCT group_id) AS n FROM records GROUP BY obligor HAVING count(DISTINCT group_id) > 1")
def group_lineage_conflict(t: Tables) -> DataFrame:
    return D.conflicts(t.records, "obligor", "group_id")


#: The built dataset as cases with targets, checks and controls; some of them are defective.
_CASE_COLUMNS = """
SELECT record_id, group_id, template_family, observed, text AS question, jurisdiction AS context, CASE WHEN record_id % 59 = 0 THEN 'restricted' ELSE classification END AS classification,
  CASE WHEN record_id % 97 = 0 OR (split = 'test' AND observed >= DATE '2023-06-01' AND record_id % 5 > 0) THEN 'oot' ELSE split END AS split, CASE WHEN record_id % 61 = 0 THEN 'zz' ELSE content_hash END AS source_hash,
  CASE WHEN record_id % 71 <> 0 THEN 'target' END AS target, CASE WHEN record_id % 67 <> 0 THEN situation END AS expected, CASE WHEN record_id % 3 = 0 THEN 'e' || CAST(record_id % 150 AS VARCHAR(8)) END AS equivalence_id,
  CASE WHEN record_id % 83 = 0 THEN record_id WHEN record_id % 89 = 0 THEN -1 WHEN record_id % 7 = 0 THEN record_id + 7 END AS control FROM built
"""
_CASE_SQL = _CASE_COLUMNS.replace("FROM built", f"FROM ({_FROZEN}) built")
_CONTRACT = f"""
WITH c AS ({_CASE_SQL}), p AS (
  SELECT 'group_leakage' AS code, count(*) AS n FROM (SELECT group_id FROM c GROUP BY 1 HAVING count(DISTINCT split) > 1) UNION ALL
  SELECT 'family_leakage', count(*) FROM (SELECT template_family FROM c GROUP BY 1 HAVING count(DISTINCT split) > 1) UNION ALL
  SELECT 'oot_before_cutoff', count(*) FROM c WHERE observed < DATE '{CUTOFF}' AND split = 'oot' UNION ALL SELECT 'late_outside_oot', count(*) FROM c WHERE observed >= DATE '{CUTOFF}' AND split <> 'oot' UNION ALL
  SELECT 'duplicate_case_id', count(*) FROM (SELECT record_id FROM c GROUP BY 1 HAVING count(*) > 1) UNION ALL
  SELECT 'duplicate_question', count(*) FROM (SELECT lower(trim(question)), context FROM c GROUP BY ALL HAVING count(*) > 1) UNION ALL
  SELECT 'equivalence_differs', count(*) FROM (SELECT equivalence_id FROM c WHERE equivalence_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT (context, split, coalesce(expected, '?'))) > 1) UNION ALL
  SELECT 'self_control', count(*) FROM c WHERE control = record_id UNION ALL SELECT 'unknown_control', count(*) FROM c WHERE control IS NOT NULL AND control NOT IN (SELECT record_id FROM c) UNION ALL
  SELECT 'missing_target', count(*) FROM c WHERE split IN ('train', 'valid') AND target IS NULL UNION ALL SELECT 'missing_expected', count(*) FROM c WHERE split <> 'train' AND expected IS NULL UNION ALL
  SELECT 'not_releasable', count(*) FROM c WHERE classification NOT IN ('synthetic', 'masked') UNION ALL SELECT 'bad_source_hash', count(*) FROM c WHERE NOT regexp_matches(source_hash, '^[0-9a-f]{{64}}$'))
SELECT * FROM p WHERE n > 0
"""


@query(_CONTRACT)
def dataset_contract(t: Tables) -> DataFrame:
    cases = t.spark.sql(_CASE_COLUMNS.replace("FROM built", "FROM {built}"), built=_built(t))
    return D.contract(cases.withColumn("distinct_from", F.array_compact(F.array("control"))), CUTOFF)


@query("SELECT sha256(lower(text)) AS h, jurisdiction, count(*) AS n FROM records GROUP BY ALL HAVING count(*) > 1")
def question_context_duplicates(t: Tables) -> DataFrame:
    return t.records.groupBy(F.sha2(F.lower("text"), 256).alias("h"), "jurisdiction").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


_SKELETON = r"sha256(trim(regexp_replace(lower(regexp_replace(text, '\d+(?:[.,]\d+)*', '<n>', 'g')), '[ \t\n\x0B\f\r]+', ' ', 'g')))"


@query(f"SELECT record_id, {_SKELETON} AS skeleton FROM records")
def clone_skeleton(t: Tables) -> DataFrame:
    return t.records.select("record_id", D.skeleton(F.col("text")).alias("skeleton"))


@query(f"""
WITH c AS (SELECT *, {_SKELETON} AS skeleton, CASE WHEN situation = 's3' AND template_family <> 'src1' THEN 'near_miss' ELSE situation END AS sit, record_id % 10 = 1 AS due FROM ({_FROZEN}) f)
SELECT 'family_over_cap' AS kind, template_family AS key, count(*) AS n FROM c GROUP BY 2 HAVING count(*) > 20 UNION ALL SELECT 'skeleton_over_cap', skeleton, count(*) FROM c GROUP BY 2 HAVING count(*) > 20
UNION ALL SELECT 'family_in_splits', template_family, count(DISTINCT split) FROM c GROUP BY 2 HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'missing_near_miss', template_family, 0 FROM c GROUP BY 2 HAVING bool_or(due) AND count(*) FILTER (sit = 'near_miss') = 0
""")
def diversity_report(t: Tables) -> DataFrame:
    situation = F.when((F.col("situation") == "s3") & (F.col("template_family") != "src1"), "near_miss").otherwise(F.col("situation"))
    return D.diversity(_built(t).withColumns({"skeleton": D.skeleton(F.col("text")), "situation": situation, "requires_near_miss": F.col("record_id") % 10 == 1}), 20)


@query("SELECT record_id FROM (SELECT *, row_number() OVER (PARTITION BY template_family ORDER BY record_id) AS k FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY record_id) AS d FROM records) WHERE d = 1)) WHERE k <= 50")
def family_cap(t: Tables) -> DataFrame:
    rows = t.records.withColumn("content_hash", D.content_hash(F.col("text")))
    return D.capped(D.first_by(rows, ["content_hash"], ["record_id"]), "template_family", ["record_id"]).select("record_id")


_TASK = "CASE WHEN lower(trim(task_type)) = 'ews' THEN 'ews_analysis' WHEN lower(trim(task_type)) IN ('factsheet', 'credit_deterioration', 'ews_analysis', 'email_draft', 'policy_qa') THEN lower(trim(task_type)) END"


@query(f"SELECT record_id, {_TASK} AS task FROM records")
def normalise_task_type(t: Tables) -> DataFrame:
    return t.records.select("record_id", D.task_type(F.col("task_type")).alias("task"))


@query(f"SELECT {_TASK} AS task, portfolio, jurisdiction, situation, count(*) AS n FROM records GROUP BY ALL")
def coverage_cells(t: Tables) -> DataFrame:
    return t.records.groupBy(D.task_type(F.col("task_type")).alias("task"), "portfolio", "jurisdiction", "situation").agg(F.count(F.lit(1)).alias("n"))


_TARGETS = "SELECT task, portfolio, jurisdiction, situation, 12 AS minimum FROM (VALUES ('factsheet'), ('policy_qa'), ('ews_analysis')) a(task), (VALUES ('retail'), ('sme'), ('corporate')) b(portfolio), (VALUES ('SAMA'), ('CBUAE')) c(jurisdiction), (VALUES ('s0'), ('s1'), ('s9')) d(situation)"


@query(f"""
WITH a AS (SELECT {_TASK} AS task, portfolio, jurisdiction, situation, count(*) AS actual FROM records GROUP BY ALL)
SELECT g.*, coalesce(a.actual, 0) AS actual, coalesce(a.actual, 0) >= g.minimum AS passed FROM ({_TARGETS}) g LEFT JOIN a USING (task, portfolio, jurisdiction, situation)
""")
def coverage_targets_join(t: Tables) -> DataFrame:
    rows = t.records.withColumn("task", D.task_type(F.col("task_type")))
    return D.coverage(rows, t.spark.sql(_TARGETS))


@query("""
SELECT portfolio, task_type, count(*) AS n, count(*) FILTER (quality_score = 0) AS abstentions, count(*) FILTER (review_status = 'rejected') AS rejected FROM records GROUP BY GROUPING SETS ((portfolio), (task_type), ())
""")
def gold_coverage(t: Tables) -> DataFrame:
    return t.sql("SELECT portfolio, task_type, count(*) AS n, count_if(quality_score = 0) AS abstentions, count_if(review_status = 'rejected') AS rejected FROM records GROUP BY GROUPING SETS ((portfolio), (task_type), ())", "records")


@query("SELECT group_id, array_to_string(list_sort(list_distinct(list(part))), ',') AS parts FROM (SELECT group_id, CASE record_id % 3 WHEN 0 THEN 'release' WHEN 1 THEN 'training' ELSE 'calibration' END AS part FROM records) GROUP BY 1 HAVING count(DISTINCT part) > 1")
def intersect_partition_overlap(t: Tables) -> DataFrame:
    part = F.element_at(F.array(F.lit("release"), F.lit("training"), F.lit("calibration")), (F.col("record_id") % 3 + 1).cast("int"))
    found = t.records.groupBy("group_id").agg(F.array_sort(F.collect_set(part)).alias("p"))
    return found.filter(F.size("p") > 1).select("group_id", F.concat_ws(",", "p").alias("parts"))


@query("SELECT DISTINCT record_id FROM records WHERE quality_score >= 3 EXCEPT SELECT record_id FROM records WHERE record_id % 4 <> 0")
def except_newly_failing(t: Tables) -> DataFrame:
    return t.records.filter("quality_score >= 3").select("record_id").subtract(t.records.filter("record_id % 4 <> 0").select("record_id"))


@query("SELECT record_id, sha256('{\"group\":\"' || group_id || '\",\"id\":' || record_id || ',\"lang\":\"' || lang || '\"}') AS digest FROM records")
def canonical_digest(t: Tables) -> DataFrame:
    """sha256 of compact JSON with sorted keys."""
    fields = {"group": "group_id", "id": "record_id", "lang": "lang"}
    return t.records.select("record_id", F.sha2(F.to_json(F.struct(*(F.col(c).alias(k) for k, c in sorted(fields.items())))), 256).alias("digest"))


@query("SELECT record_id, CAST(CAST(concat('0x', substr(sha256(CAST(record_id AS VARCHAR)), 1, 16)) AS UBIGINT) % 9223372036854775808 AS BIGINT) AS point_id FROM records")
def stable_point_id(t: Tables) -> DataFrame:
    """The first eight bytes of the sha256, modulo 2^63."""
    head = F.conv(F.substring(F.sha2(F.col("record_id").cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return t.records.select("record_id", F.pmod(head, F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long").alias("point_id"))


@query(tree_sql("SELECT group_id, record_id || ':' || sha256(text) AS line FROM records", "group_id").replace("h AS digest", "h AS content"))
def gold_content_hash(t: Tables) -> DataFrame:
    """One hash over a set's cases, a set per group."""
    line = F.concat(F.col("record_id").cast("string"), F.lit(":"), F.sha2("text", 256))
    return digests.tree(t.records, ["group_id"], line).select("group_id", F.col("digest").alias("content"))


@query("""
SELECT case_id, role, (conv_id * 10 + turn) % 7 = 2 AS refused FROM (SELECT *, conv_id * 100 + turn AS case_id FROM conversations) WHERE (conv_id * 10 + turn) % 11 NOT IN (3, 5)
""")
def read_jsonl_records(t: Tables) -> DataFrame:
    """JSON lines read as text: blank lines, comments and the manifest line aren't cases; a case id that comes twice is refused."""
    key = F.col("conv_id") * 10 + F.col("turn")
    line = F.to_json(F.struct(F.lit("case").alias("kind"), (F.col("conv_id") * 100 + F.col("turn")).alias("case_id"), "role"))
    lines = F.when(key % 11 == 3, F.array(F.lit(""))).when(key % 11 == 5, F.array(F.lit("# a comment"), F.lit('{"kind": "manifest", "version": 1}'))).when(key % 7 == 2, F.array(line, line)).otherwise(F.array(line))
    path = _scratch(t, "jsonl")
    t.conversations.select(F.explode(lines).alias("value")).write.text(path)
    rows = t.spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    cases = rows.select(F.from_json("value", "kind string, case_id long, role string").alias("j")).select("j.*").filter("kind = 'case'")
    return cases.groupBy("case_id").agg(F.min("role").alias("role"), (F.count(F.lit(1)) > 1).alias("refused"))


def _write_split(t: Tables) -> str:
    path = _scratch(t, "dataset")
    rows = _built(t).select("record_id", "group_id", "template_family", "content_hash", "split", F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))).alias("messages"))
    rows.select("messages", "split").write.partitionBy("split").json(f"{path}/chat")
    rows.drop("messages").write.partitionBy("split").json(f"{path}/provenance")
    return path


@query(f"SELECT part, split, count(*) AS n FROM ({_FROZEN}) f, (VALUES ('chat'), ('provenance')) p(part) GROUP BY part, split")
def write_split_dataset(t: Tables) -> DataFrame:
    """Chat lines and provenance lines by split; how many lines each part has."""
    path = _write_split(t)
    both = [t.spark.read.schema("split string").json(f"{path}/{part}").select(F.lit(part).alias("part"), "split") for part in ("chat", "provenance")]
    return both[0].union(both[1]).groupBy("part", "split").agg(F.count(F.lit(1)).alias("n"))


_MANIFEST = f"""
SELECT 'count' AS kind, split AS key, count(*)::VARCHAR AS value FROM m GROUP BY 2 UNION ALL SELECT 'family', template_family, count(*)::VARCHAR FROM m GROUP BY 2 UNION ALL SELECT 'skeleton', skeleton, count(*)::VARCHAR FROM m GROUP BY 2
UNION ALL SELECT 'situation', situation, count(*)::VARCHAR FROM m GROUP BY 2 UNION ALL SELECT 'coverage', portfolio || '/' || situation, count(*)::VARCHAR FROM m GROUP BY 2 UNION ALL SELECT 'group', group_id, min(split) FROM m GROUP BY 2
UNION ALL SELECT 'file', split, digest FROM ({tree_sql("SELECT split, record_id || ':' || content_hash AS line FROM m", "split")}) fd UNION ALL SELECT 'excluded_group', group_id, 'excluded' FROM (SELECT DISTINCT group_id FROM records WHERE record_id % 53 = 0)
"""
_SEAL = tree_sql("SELECT 1 AS everything, kind || '|' || key || '|' || value AS line FROM mf", "everything")
_MANIFEST_CTE = f"m AS (SELECT *, {_SKELETON} AS skeleton FROM ({_FROZEN}) f), mf AS ({_MANIFEST}), sealed AS (SELECT * FROM mf UNION ALL SELECT 'manifest_hash', '', digest FROM ({_SEAL}) sd)"


def _manifest(t: Tables) -> DataFrame:
    excluded = t.records.filter("record_id % 53 = 0").select(F.lit("excluded_group").alias("kind"), F.col("group_id").alias("key")).distinct()
    return D.manifest(_built(t).withColumn("skeleton", D.skeleton(F.col("text"))), excluded)


@query(f"WITH {_MANIFEST_CTE} SELECT * FROM sealed")
def dataset_manifest(t: Tables) -> DataFrame:
    """What a dataset is made of, sealed by a hash of all of it."""
    return D.sealed(_manifest(t))


@query(f"""
WITH {_MANIFEST_CTE} SELECT kind, key, CASE WHEN kind = 'situation' THEN 'missing' WHEN kind = 'family' THEN 'unexpected' ELSE 'changed' END AS status FROM (
  SELECT kind, key FROM sealed WHERE kind = 'group' AND value = 'train' AND key IN ('g1', 'g2', 'g3') UNION ALL SELECT kind, key FROM sealed WHERE kind = 'file' AND key = 'test' UNION ALL SELECT 'situation', 's1' WHERE EXISTS (SELECT 1 FROM sealed WHERE kind = 'situation' AND key = 's1') UNION ALL SELECT 'family', 'no such family')
""")
def verify_manifest(t: Tables) -> DataFrame:
    """A stored manifest with some entries changed, one lost and one made up, against the data."""
    true = D.sealed(_manifest(t))
    moved = (F.col("kind") == "group") & (F.col("value") == "train") & F.col("key").isin("g1", "g2", "g3")
    value = F.when(moved, "test").when((F.col("kind") == "file") & (F.col("key") == "test"), "0" * 64).otherwise(F.col("value"))
    stored = true.withColumn("value", value).filter("not (kind = 'situation' and key = 's1')")
    extra = t.spark.createDataFrame([("family", "no such family", "1")], "kind string, key string, value string")
    return D.verify_manifest(stored.unionByName(extra), true)


@query(f"""
WITH RECURSIVE b AS ({_FROZEN}), fb AS (SELECT record_id, group_id, template_family, sha256(text) AS content_hash FROM records WHERE record_id % 5 = 0),
j AS (SELECT fb.*, CASE WHEN group_id IN (SELECT group_id FROM b WHERE split <> 'train') THEN 'protected_group' WHEN content_hash IN (SELECT content_hash FROM b) THEN 'duplicate_base' END AS outcome FROM fb),
fam AS (SELECT *, row_number() OVER (ORDER BY first, template_family) AS k FROM (SELECT template_family, min(record_id) AS first, count(*) AS n FROM j WHERE outcome IS NULL GROUP BY 1)),
lim AS (SELECT floor(count(*) * 0.25e0 + 1e-9)::BIGINT AS m FROM b WHERE split = 'train'),
w AS (SELECT 0::BIGINT AS k, 0::BIGINT AS used, NULL::VARCHAR AS taken UNION ALL
  SELECT fam.k, CASE WHEN w.used + fam.n <= m THEN w.used + fam.n ELSE w.used END, CASE WHEN w.used + fam.n <= m THEN fam.template_family END FROM w JOIN fam ON fam.k = w.k + 1, lim)
SELECT record_id, coalesce(outcome, CASE WHEN template_family IN (SELECT taken FROM w WHERE taken IS NOT NULL) THEN 'taken' ELSE 'over_fraction' END) AS outcome FROM j
""")
def dataset_build_increment(t: Tables) -> DataFrame:
    feedback = t.records.filter("record_id % 5 = 0").select("record_id", "group_id", "template_family", D.content_hash(F.col("text")).alias("content_hash"))
    return D.increment(_built(t), feedback).select("record_id", "outcome")


_FB = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY interaction_id ORDER BY seq DESC) AS k FROM feedback_log) WHERE k = 1"
_PROTECTED = f"group_id IN (SELECT group_id FROM ({_FROZEN}) pf WHERE split <> 'train')"
_FB_STATUS = f"CASE WHEN correction IS NULL THEN 'submitted' WHEN NOT correction_valid THEN 'invalid_correction' WHEN {_PROTECTED} THEN 'protected_split_or_group' WHEN expected_checks = '' THEN 'needs_expected_results' WHEN root_cause = 'unknown' THEN 'untriaged' WHEN root_cause <> 'model_behaviour' THEN 'component_feedback' ELSE 'eligible_for_batch' END"
_FB_OUTCOME = "CASE WHEN NOT (eligible AND root_cause = 'model_behaviour' AND coalesce(correction, '') <> '' AND reviewer IS NOT NULL AND review_status = 'approved' AND quality_score >= 4) THEN 'not_eligible' WHEN NOT captured THEN 'skipped_no_captured_input' WHEN group_id IS NULL THEN 'rejected_missing_group_id' WHEN NOT correction_valid THEN 'not_admissible' ELSE 'training_example' END"


def _latest(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("interaction_id").orderBy(F.col("seq").desc()))
    return t.feedback_log.withColumn("k", n).filter("k = 1").drop("k")


@query(f"SELECT interaction_id, seq, root_cause, review_status FROM ({_FB}) f")
def latest_feedback(t: Tables) -> DataFrame:
    return _latest(t).select("interaction_id", "seq", "root_cause", "review_status")


@query(f"SELECT interaction_id, seq, {_FB_STATUS} AS status FROM feedback_log")
def feedback_eligibility_status(t: Tables) -> DataFrame:
    """The ladder that a correction climbs; groups of held-out cases are protected."""
    held = _built(t).filter("split <> 'train'").select("group_id").distinct().withColumn("held", F.lit(True))
    rows = t.feedback_log.join(held, "group_id", "left").withColumn("protected", F.coalesce("held", F.lit(False)))
    return rows.select("interaction_id", "seq", D.feedback_status().alias("status"))


@query(f"SELECT interaction_id, seq, {_FB_OUTCOME} AS outcome FROM ({_FB}) f")
def feedback_admission(t: Tables) -> DataFrame:
    """What becomes of each interaction's last correction when a batch is built."""
    return _latest(t).select("interaction_id", "seq", D.feedback_outcome().alias("outcome"))


@query(f"""
WITH l AS (SELECT *, {_FB_OUTCOME} AS outcome, CASE root_cause WHEN 'data' THEN 'source' WHEN 'schema' THEN 'registry' WHEN 'query' THEN 'query_guard' WHEN 'calculation' THEN 'formulas' WHEN 'retrieval' THEN 'retrieval' WHEN 'guardrail' THEN 'guardrails' ELSE 'training' END AS route FROM ({_FB}) f)
SELECT 'total' AS kind, 'input_records' AS key, count(*) AS n FROM feedback_log UNION ALL SELECT 'total', 'superseded_by_later_correction', count(*) - count(DISTINCT interaction_id) FROM feedback_log
UNION ALL SELECT 'total', 'corrections_awaiting_schema_fix', count(*) FILTER (corrected_plan) FROM feedback_log UNION ALL SELECT 'outcome', outcome, count(*) FROM l GROUP BY 2 UNION ALL SELECT 'root_cause', root_cause, count(*) FROM l GROUP BY 2
UNION ALL SELECT 'route', route, count(*) FROM l GROUP BY 2 UNION ALL SELECT 'sql_review', sql_review, count(*) FROM l WHERE sql_review <> 'not_reviewed' GROUP BY 2
UNION ALL SELECT 'error_label', label, count(*) FROM (SELECT unnest(string_split(error_labels, ',')) AS label FROM l WHERE error_labels <> '') GROUP BY 2
""")
def feedback_report(t: Tables) -> DataFrame:
    """Totals, outcomes, root causes, routes, reviews of SQL and error labels; each interaction's last record counts."""
    route = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in D.ROUTES.items() for x in kv)), F.col("root_cause")), F.lit("unrouted"))
    every = lambda name, c: F.struct(F.lit("total").alias("kind"), F.lit(name).alias("key"), c.alias("n"))
    n = F.count(F.lit(1))
    totals = t.feedback_log.agg(F.explode(F.array(every("input_records", n), every("superseded_by_later_correction", n - F.count_distinct("interaction_id")), every("corrections_awaiting_schema_fix", F.count_if("corrected_plan")))).alias("x")).select("x.*")
    pair = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
    one = F.array(pair("outcome", D.feedback_outcome()), pair("root_cause", F.col("root_cause")), pair("route", route), pair("sql_review", F.nullif("sql_review", F.lit("not_reviewed"))))
    labels = F.transform(F.filter(F.split("error_labels", ","), lambda x: x != ""), lambda x: pair("error_label", x))
    counted = _latest(t).select(F.explode(F.concat(one, labels)).alias("x")).select("x.*").filter("key is not null").groupBy("kind", "key").agg(n.alias("n"))
    return totals.union(counted)


@query("""
WITH f AS (SELECT interaction_id, min(root_cause) AS cause, list_sort(list_distinct(list(review_status))) AS d, list_sort(list_distinct(flatten(list(list_filter(string_split(expected_checks, ','), lambda x: x <> ''))))) AS e FROM feedback_log GROUP BY interaction_id)
SELECT sha256('{"cause":"' || cause || '","diagnostics":["' || array_to_string(d, '","') || '"],"expected_checks":' || CASE WHEN len(e) = 0 THEN '[]' ELSE '["' || array_to_string(e, '","') || '"]' END || '}') AS cluster, count(*) AS n FROM f GROUP BY 1
""")
def failure_clusters(t: Tables) -> DataFrame:
    """Failures with one cause, one set of diagnostics and one set of expected checks have one digest."""
    checks = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.split("expected_checks", ","), lambda x: x != "")))))
    each = t.feedback_log.groupBy("interaction_id").agg(F.min("root_cause").alias("cause"), F.array_sort(F.collect_set("review_status")).alias("diagnostics"), checks.alias("expected_checks"))
    return each.groupBy(F.sha2(F.to_json(F.struct("cause", "diagnostics", "expected_checks")), 256).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT f.interaction_id, f.seq, f.root_cause, a.status, a.question_id FROM feedback_log f JOIN answers a ON a.answer_id = f.interaction_id AND a.seq = f.seq WHERE a.role = 'assistant'")
def interaction_feedback_join(t: Tables) -> DataFrame:
    captured = t.answers.filter("role = 'assistant'").select(F.col("answer_id").alias("interaction_id"), "seq", "status", "question_id")
    return t.feedback_log.join(captured, ["interaction_id", "seq"]).select("interaction_id", "seq", "root_cause", "status", "question_id")


@query("SELECT template_family AS chunk_id, count(DISTINCT sha256(text)) AS n FROM records GROUP BY 1 HAVING count(DISTINCT sha256(text)) > 1")
def chunk_identity_conflict(t: Tables) -> DataFrame:
    rows = t.records.select(F.col("template_family").alias("chunk_id"), F.sha2("text", 256).alias("payload"))
    return D.conflicts(rows, "chunk_id", "payload")


#: Chunks and those of a second ingestion, whose roles and portfolios stand in another order.
_INGESTED = """
SELECT doc_id AS chunk_id, jurisdiction, document_id, document_version, CAST(doc_id % 9 AS VARCHAR(4)) AS section_id, text, approval_status, effective_from, declared_to, confidentiality_level, allowed_roles, portfolios FROM policy_docs
UNION ALL SELECT doc_id + 1000000, jurisdiction, document_id, document_version, CAST(doc_id % 9 AS VARCHAR(4)), text, approval_status, effective_from, declared_to, CASE WHEN doc_id % 6 = 3 THEN 'secret' ELSE confidentiality_level END,
  CASE WHEN allowed_roles = 'credit_analyst,senior_credit_officer' THEN 'senior_credit_officer,credit_analyst' ELSE allowed_roles END, CASE WHEN portfolios = 'sme,corporate' THEN 'corporate,sme' ELSE portfolios END FROM policy_docs WHERE doc_id % 3 = 0
"""


@query(f"""
SELECT chunk_id FROM (SELECT chunk_id, row_number() OVER (PARTITION BY jurisdiction, document_id, document_version, section_id, sha256(text), approval_status, effective_from, declared_to, confidentiality_level,
  list_sort(string_split(allowed_roles, ',')), list_sort(string_split(portfolios, ',')) ORDER BY chunk_id) AS n FROM ({_INGESTED}) i) WHERE n = 1
""")
def dedupe_chunks(t: Tables) -> DataFrame:
    """The first chunk of each key: place, content, status, window, level, roles and portfolios in any order."""
    names = lambda c: F.concat_ws(",", F.array_sort(F.split(c, ",")))
    rows = t.sql(_INGESTED, "policy_docs").withColumns({"content_hash": D.content_hash(F.col("text")), "roles": names("allowed_roles"), "places": names("portfolios")})
    key = ["jurisdiction", "document_id", "document_version", "section_id", "content_hash", "approval_status", "effective_from", "declared_to", "confidentiality_level", "roles", "places"]
    return D.first_by(rows, key, ["chunk_id"]).select("chunk_id")
