"""Queries of evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import registry as R
from riskloom.catalog import query
from riskloom.functions import columns as C
from riskloom.operators import evaluation as E
from riskloom.sources.views import Tables

_R6 = "floor({0} * 1e6 + 0.5e0) / 1e6"
_METRICS = ["schema_validity", "prompt_injection_block_rate"]
_OBS = """
SELECT case_id, group_id, portfolio, task_type, 'schema_validity' AS metric, schema_valid::DOUBLE AS value FROM eval_obs
UNION ALL SELECT case_id, group_id, portfolio, task_type, 'prompt_injection_block_rate', CASE WHEN is_injection_attempt = 0 OR case_id % 3 > 0 THEN injection_blocked::DOUBLE END FROM eval_obs
"""


def _observed(t: Tables) -> DataFrame:
    blocked = F.when((F.col("is_injection_attempt") == 0) | (F.col("case_id") % 3 > 0), F.col("injection_blocked"))
    rows = t.eval_obs.withColumns({"schema_validity": F.col("schema_valid"), "prompt_injection_block_rate": blocked})
    return E.unpivot(rows, ["case_id", "group_id", "portfolio", "task_type"], _METRICS)


_SCORES = f"""
SELECT scope, slice, metric, avg(value) AS score, sum(cases)::BIGINT AS n FROM (
  SELECT scope, slice, metric, group_id, min(value) AS value, count(*) AS cases FROM (
    SELECT 'overall' AS scope, 'all' AS slice, metric, group_id, value FROM ({_OBS}) o UNION ALL SELECT 'portfolio', portfolio, metric, group_id, value FROM ({_OBS}) o UNION ALL SELECT 'task_type', task_type, metric, group_id, value FROM ({_OBS}) o)
  WHERE value IS NOT NULL GROUP BY ALL) GROUP BY scope, slice, metric
"""


def _scores(t: Tables) -> DataFrame:
    return E.score_cases(_observed(t), ["portfolio", "task_type"])


@query(f"SELECT scope, slice, metric, {_R6.format('score')} AS score, n FROM ({_SCORES}) s")
def score_cases(t: Tables) -> DataFrame:
    return _scores(t).withColumn("score", C.fixed(F.col("score"), 6))


_Z = "1.959963984540054e0"
_WILSON = f"CASE WHEN n > 0 THEN (p + {_Z} * {_Z} / (2e0 * n) - {_Z} * sqrt(p * (1e0 - p) / n + {_Z} * {_Z} / (4e0 * n * n))) / (1e0 + {_Z} * {_Z} / n) ELSE 0e0 END"
_THRESHOLD = "CASE metric " + " ".join(f"WHEN '{m}' THEN {R.THRESHOLDS[m]!r}::DOUBLE" for m in _METRICS) + " END"


@query(f"""
WITH s AS (SELECT *, score AS p, {_THRESHOLD} AS threshold FROM ({_SCORES}) x), l AS (SELECT *, {_WILSON} AS low FROM s)
SELECT scope, slice, metric, n, threshold, CASE WHEN n = 0 THEN 'not_applicable' WHEN n < 30 THEN 'insufficient' WHEN score < threshold THEN 'failed' WHEN low < threshold THEN 'insufficient' ELSE 'passed' END AS status FROM l
""")
def release_gates(t: Tables) -> DataFrame:
    limits = F.element_at(F.create_map(*(F.lit(x) for kv in R.THRESHOLDS.items() for x in kv)), F.col("metric"))
    rows = _scores(t).withColumn("threshold", limits)
    return rows.withColumn("status", E.gate_status(F.col("score"), F.col("n"), F.col("threshold"), F.lit(True))).drop("score")


@query(f"""
WITH g AS (SELECT group_id, count(*) AS n, sum(schema_valid)::DOUBLE / count(*) AS p FROM eval_obs GROUP BY group_id) SELECT group_id, n, {_R6.format('(' + _WILSON + ')')} AS low FROM g
""")
def wilson_lower(t: Tables) -> DataFrame:
    rows = t.eval_obs.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.sum("schema_valid").alias("hits"))
    return rows.select("group_id", "n", C.fixed(C.wilson_lower(F.col("hits"), F.col("n")), 6).alias("low"))


_SPLIT_OBS = f"SELECT *, CASE case_id % 4 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' WHEN 2 THEN 'oot' ELSE 'train' END AS split FROM ({_OBS}) zz"


@query(f"""
SELECT kind, slice, metric, {_R6.format('avg(value)')} AS mean, count(value) AS n, count(value) >= 10 AS sufficient FROM (SELECT 'portfolio' AS kind, portfolio AS slice, metric, value FROM ({_SPLIT_OBS}) o UNION ALL SELECT 'split', split, metric, value FROM ({_SPLIT_OBS}) o) GROUP BY kind, slice, metric
""")
def metric_means(t: Tables) -> DataFrame:
    """Means by portfolio and by split, with the number of cases and whether it is enough to report."""
    split = F.element_at(F.array(*map(F.lit, ("validation", "test", "oot", "train"))), (F.col("case_id") % 4 + 1).cast("int"))
    rows = _observed(t).withColumn("split", split).select("metric", "value", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("slice")) for k in ("portfolio", "split")))).alias("s"))
    found = rows.groupBy("s.kind", "s.slice", "metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    return found.select("kind", "slice", "metric", C.fixed(F.col("mean"), 6).alias("mean"), "n", (F.col("n") >= R.REPORTABLE_SLICE).alias("sufficient"))


_STEPS = " + ".join(f"CASE WHEN u >= {x!r} THEN 1 ELSE 0 END" for x in E.POISSON_STEPS)


@query(f"""
WITH d AS (SELECT portfolio, metric, value, sample, CAST(concat('0x', substr(md5(sample || '|' || portfolio || '|' || metric || '|' || case_id), 1, 8)) AS BIGINT) / 4294967296e0 AS u FROM ({_OBS}) o, range(1, 1001) r(sample) WHERE value IS NOT NULL),
m AS (SELECT portfolio, metric, sample, sum(w * value) / sum(w) AS m FROM (SELECT *, {_STEPS} AS w FROM d) WHERE w > 0 GROUP BY ALL),
k AS (SELECT portfolio, metric, list_sort(list(m)) AS m FROM m GROUP BY ALL), c AS (SELECT portfolio, metric, count(value) AS n FROM ({_OBS}) o GROUP BY ALL)
SELECT portfolio, metric, n, {_R6.format('m[greatest(1, len(m) * 25 // 1000)]')} AS low, {_R6.format('m[greatest(1, len(m) * 975 // 1000)]')} AS high FROM k JOIN c USING (portfolio, metric)
""")
def bootstrap_ci(t: Tables) -> DataFrame:
    found = E.bootstrap(_observed(t).filter("value is not null"), ["portfolio", "metric"], "case_id", "value")
    return found.withColumns({c: C.fixed(F.col(c), 6) for c in ("low", "high")})


@query(f"SELECT portfolio, {_R6.format('(sum((1 + case_id % 5) * schema_valid)::DOUBLE / sum(1 + case_id % 5))')} AS pass_rate FROM eval_obs GROUP BY portfolio")
def business_weighted_pass_rate(t: Tables) -> DataFrame:
    w = F.col("case_id") % 5 + 1
    return t.eval_obs.groupBy("portfolio").agg(C.fixed(F.sum(w * F.col("schema_valid")).cast("double") / F.sum(w), 6).alias("pass_rate"))


_CONF = "SELECT case_id, (case_id % 101) / 100e0 AS confidence, schema_valid AS correct FROM eval_obs"


@query(f"""
WITH b AS (SELECT least(floor(confidence * 5e0), 4)::INTEGER AS bin, count(*) AS n, avg(confidence) AS c, avg(correct) AS a, sum((confidence - correct) ** 2) AS q FROM ({_CONF}) x GROUP BY 1),
s AS (SELECT sum(n) AS all_n, sum(q) / sum(n) AS brier, sum(n * abs(c - a)) / sum(n) AS ece FROM b)
SELECT bin, n, {_R6.format('c')} AS mean_confidence, {_R6.format('a')} AS accuracy, all_n::BIGINT AS denominator, {_R6.format('brier')} AS brier_score, {_R6.format('ece')} AS calibration_error, CASE WHEN all_n >= 10 THEN 'reportable' ELSE 'small_sample' END AS status FROM b, s
""")
def calibration_bins(t: Tables) -> DataFrame:
    """Bins with the summary of all of them."""
    rows = t.eval_obs.select((F.col("case_id") % 101 / 100.0).alias("confidence"), F.col("schema_valid").alias("correct"))
    bins = E.calibration(rows)
    joined = bins.drop("squares").join(F.broadcast(E.calibration_summary(bins)))  # a row
    return joined.withColumns({c: C.fixed(F.col(c), 6) for c in ("mean_confidence", "accuracy", "brier_score", "calibration_error")})


_LEFT = "SELECT doc_id AS case_id, CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split, 'quality' AS metric, quality::DOUBLE AS value FROM labels"
_RIGHT = "SELECT doc_id AS case_id, CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split, 'quality' AS metric, (1 - toxic)::DOUBLE AS value FROM labels WHERE doc_id % 10 <> 3"


def _runs(t: Tables) -> tuple[DataFrame, DataFrame]:
    split = F.when(F.col("doc_id") % 2 == 0, "dev").otherwise("test")
    rows = lambda value: t.labels.select(F.col("doc_id").alias("case_id"), split.alias("split"), F.lit("quality").alias("metric"), value.cast("double").alias("value"))
    return rows(F.col("quality")), rows(1 - F.col("toxic")).filter("case_id % 10 <> 3")


@query(f"SELECT case_id, split, metric, b.value - a.value AS delta FROM ({_LEFT}) a JOIN ({_RIGHT}) b USING (case_id, split, metric)")
def paired_case_inner(t: Tables) -> DataFrame:
    a, b = _runs(t)
    joined = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), ["case_id", "split", "metric"])
    return joined.select("case_id", "split", "metric", (F.col("b") - F.col("a")).alias("delta"))


@query(f"SELECT split, metric, count(*) AS n, {_R6.format('avg(b.value - a.value)')} AS mean_delta, count(*) FILTER (b.value > a.value) AS wins, count(*) FILTER (b.value < a.value) AS losses, count(*) FILTER (b.value = a.value) AS ties FROM ({_LEFT}) a JOIN ({_RIGHT}) b USING (case_id, split, metric) GROUP BY split, metric")
def paired_deltas(t: Tables) -> DataFrame:
    a, b = _runs(t)
    return E.paired_deltas(a, b, ["case_id", "split", "metric"], ["split", "metric"]).withColumn("mean_delta", C.fixed(F.col("mean_delta"), 6))


_A = "SELECT portfolio AS metric, avg(schema_valid) AS base, count(*) AS base_n FROM eval_obs WHERE portfolio <> 'sme' GROUP BY 1"
_B = "SELECT portfolio AS metric, avg(injection_blocked) AS candidate, count(*) AS candidate_n FROM eval_obs WHERE portfolio <> 'retail' GROUP BY 1"


def _sides(t: Tables) -> DataFrame:
    one = lambda other, value: t.eval_obs.filter(F.col("portfolio") != other).groupBy(F.col("portfolio").alias("metric")).agg(F.avg(value), F.count(F.lit(1)))
    return E.both_sides(one("sme", "schema_valid"), one("retail", "injection_blocked"), ["metric"])


@query(f"SELECT coalesce(a.metric, b.metric) AS metric, {_R6.format('base')} AS base, base_n, {_R6.format('candidate')} AS candidate, candidate_n, least(base_n, candidate_n) AS denominator FROM ({_A}) a FULL JOIN ({_B}) b ON a.metric = b.metric")
def scorecard_full_outer(t: Tables) -> DataFrame:
    return _sides(t).withColumns({c: C.fixed(F.col(c), 6) for c in ("base", "candidate")})


@query(f"SELECT a.metric, base IS NOT NULL AND (candidate IS NULL OR base - candidate > 0.02e0) AS regressed FROM ({_A}) a LEFT JOIN ({_B}) b ON a.metric = b.metric")
def champion_slices(t: Tables) -> DataFrame:
    rows = _sides(t).filter("base is not null")
    return rows.select("metric", F.coalesce(F.col("base") - F.col("candidate") > R.REGRESSION_TOLERANCE, F.lit(True)).alias("regressed"))


@query(f"""
WITH j AS (SELECT a.metric, base, candidate FROM ({_A}) a LEFT JOIN ({_B}) b ON a.metric = b.metric), x AS (
  SELECT count(*) FILTER (candidate IS NULL OR base - candidate > 0.02e0) AS regressions, coalesce(bool_or(metric = 'corporate' AND candidate > base), false) AS improved FROM j)
SELECT *, regressions = 0 AND improved AS promote FROM x
""")
def champion_decision(t: Tables) -> DataFrame:
    return E.champion(_sides(t), "corporate")


_CASES = "SELECT doc_id AS case_id FROM labels"
_PRED = "SELECT doc_id AS case_id, quality AS answer FROM labels WHERE doc_id % 9 <> 4 UNION ALL SELECT -doc_id - 1, 0 FROM labels WHERE doc_id % 50 = 0"


@query(f"SELECT c.case_id, CASE WHEN p.case_id IS NULL THEN 'provider_failed' ELSE 'answered' END AS status FROM ({_CASES}) c LEFT JOIN ({_PRED}) p USING (case_id) UNION ALL SELECT case_id, 'unknown_case' FROM ({_PRED}) p WHERE case_id NOT IN ({_CASES})")
def predictions_left_join(t: Tables) -> DataFrame:
    cases = t.labels.select(F.col("doc_id").alias("case_id"))
    made = t.labels.filter("doc_id % 9 <> 4").select(F.col("doc_id").alias("case_id"))
    strange = t.labels.filter("doc_id % 50 = 0").select((-F.col("doc_id") - 1).alias("case_id"))
    predictions = made.union(strange).withColumn("made", F.lit(True))
    joined = cases.join(predictions, "case_id", "left").select("case_id", F.when(F.col("made"), "answered").otherwise("provider_failed").alias("status"))
    return joined.union(predictions.join(cases, "case_id", "left_anti").select("case_id", F.lit("unknown_case")))


_RATED = "SELECT round(((doc_id * 37) % 1000) / 1000e0, 3) AS cosine, quality = 1 AS relevant FROM labels"


@query(f"""
WITH r AS ({_RATED}), t AS (SELECT DISTINCT cosine AS t FROM r UNION SELECT 0e0 UNION SELECT 1e0), x AS (
  SELECT t, (SELECT count(*) FROM r WHERE relevant AND cosine >= t)::DOUBLE / (SELECT count(*) FROM r WHERE relevant) AS recall, (SELECT count(*) FROM r WHERE NOT relevant AND cosine < t)::DOUBLE / (SELECT count(*) FROM r WHERE NOT relevant) AS rejection FROM t)
SELECT least(recall, rejection) AS balance, rejection, recall, t AS threshold FROM x ORDER BY 1 DESC, 2 DESC, 3 DESC, 4 DESC LIMIT 1
""")
def select_threshold(t: Tables) -> DataFrame:
    return E.select_threshold(t.labels.select((F.col("doc_id") * 37 % 1000 / 1000.0).alias("cosine"), (F.col("quality") == 1).alias("relevant")))


_REVIEWS = "SELECT doc_id AS item, 'r' || (doc_id % 3) AS reviewer, CASE WHEN quality = 1 THEN 'supported' ELSE 'unsupported' END AS label FROM labels UNION ALL SELECT doc_id, 'r' || (CASE WHEN doc_id % 8 = 0 THEN doc_id % 3 ELSE (doc_id + 1) % 3 END), CASE WHEN toxic = 0 THEN 'supported' ELSE 'unsupported' END FROM labels"
_JUDGES = "SELECT doc_id AS item, 'r' || (doc_id % 4) AS judge, 'unsupported' AS verdict FROM labels WHERE doc_id % 3 = 1"


def _reviews(t: Tables) -> DataFrame:
    label = lambda c: F.when(c, "supported").otherwise("unsupported")
    name = lambda n: F.concat(F.lit("r"), n.cast("string"))
    one = t.labels.select(F.col("doc_id").alias("item"), name(F.col("doc_id") % 3).alias("reviewer"), label(F.col("quality") == 1).alias("label"))
    other = F.when(F.col("doc_id") % 8 == 0, F.col("doc_id") % 3).otherwise((F.col("doc_id") + 1) % 3)
    two = t.labels.select("doc_id", name(other), label(F.col("toxic") == 0))
    judged = t.labels.filter("doc_id % 3 = 1").select(F.col("doc_id").alias("item"), name(F.col("doc_id") % 4).alias("judge"), F.lit("unsupported").alias("verdict"))
    return E.reviewed_label(one.union(two), judged)


_LABELLED = f"""
SELECT r.item, CASE WHEN count(DISTINCT reviewer) >= 2 AND count(DISTINCT label) = 1 THEN min(label) WHEN min(j.judge) IS NOT NULL AND NOT list_contains(list(reviewer), min(j.judge)) THEN min(j.verdict) END AS label
FROM ({_REVIEWS}) r LEFT JOIN ({_JUDGES}) j ON r.item = j.item GROUP BY r.item
"""


@query(_LABELLED)
def reviewed_label(t: Tables) -> DataFrame:
    return _reviews(t)


#: Judged items, a group each; their contents, some of which calibration has seen; what the judge and the cosine say.
_JUDGED = f"""
SELECT x.item, 'g' || CASE WHEN x.item % 400 = 0 THEN 7 ELSE x.item END AS group_id, 'c' || x.item AS content, CASE WHEN x.item % 1000 = 999 THEN 'train' ELSE 'qualification' END AS split, x.label, x.item % 20 <> 0 AS judged, (((x.item * 37) % 1000) / 1000e0 >= 0.1e0) = (x.label = 'supported') AS near FROM ({_LABELLED}) x
"""
_QUALIFY = f"""
WITH j AS (SELECT * FROM ({_JUDGED}) y WHERE {{1}}), cal AS (SELECT 'c' || item_id AS content FROM benchmark WHERE item_id % 9 = {{2}}),
p AS (SELECT list_filter([CASE WHEN EXISTS (SELECT 1 FROM j WHERE split <> 'qualification') THEN 'not_held_out' END, CASE WHEN (SELECT count(*) - count(DISTINCT group_id) FROM j) > 0 THEN 'dependent_groups' END, CASE WHEN (SELECT count(*) - count(DISTINCT content) FROM j) > 0 THEN 'duplicate_content' END,
  CASE WHEN EXISTS (SELECT 1 FROM j WHERE content IN (SELECT content FROM cal)) THEN 'calibration_overlap' END, CASE WHEN EXISTS (SELECT 1 FROM j WHERE label IS NULL) THEN 'unresolved_review' END], lambda x: x IS NOT NULL) AS problems),
l AS (SELECT s.label, s.least, count(j.item) AS n, (count(*) FILTER ({{0}}))::DOUBLE / greatest(count(j.item), 1) AS p FROM (VALUES ('supported', 0.90e0), ('unsupported', 0.95e0)) s(label, least) LEFT JOIN j USING (label) GROUP BY ALL)
SELECT label, n, {_R6.format('(' + _WILSON + ')')} AS low, array_to_string(problems, ',') AS problems, ({_WILSON}) >= least AND len(problems) = 0 AS qualified FROM l, (SELECT problems FROM p) pp
"""


def _judged(t: Tables, hit: str) -> DataFrame:
    item, text = F.col("item"), F.col("item").cast("string")
    near = (item * 37 % 1000 / 1000.0 >= 0.1) == (F.col("label") == "supported")
    group = F.concat(F.lit("g"), F.when(item % 400 == 0, 7).otherwise(item).cast("string"))
    split = F.when(item % 1000 == 999, "train").otherwise("qualification")
    return _reviews(t).select("item", group.alias("group_id"), F.concat(F.lit("c"), text).alias("content"), split.alias("split"), "label", (near if hit == "near" else item % 20 != 0).alias("hit"))


def _calibrated(t: Tables, rest: int) -> DataFrame:
    return t.benchmark.filter(F.col("item_id") % 9 == rest).select(F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("content"))


def _told(found: DataFrame) -> DataFrame:
    return found.withColumns({"low": C.fixed(F.col("low"), 6), "problems": F.concat_ws(",", "problems")})


@query(_QUALIFY.format("judged", "true", 4))
def qualify_judge(t: Tables) -> DataFrame:
    """A judge's agreement with each reviewed label, over all items: their groups, contents and reviews have defects."""
    return _told(E.qualified(_judged(t, "judged"), _calibrated(t, 4)))


@query(_QUALIFY.format("near", "label IS NOT NULL AND item % 400 <> 0 AND item % 1000 <> 999 AND item % 9 <> 5", 5))
def qualify_retrieval(t: Tables) -> DataFrame:
    """The same for a cosine threshold, over the items without defects."""
    rows = _judged(t, "near").filter("label is not null and item % 400 <> 0 and item % 1000 <> 999 and item % 9 <> 5")
    return _told(E.qualified(rows, _calibrated(t, 5)))


@query("SELECT question_id, count(*) AS n, CASE WHEN count(*) >= 3 THEN count(DISTINCT nullif(recommendation, '')) = 1 AND count(nullif(recommendation, '')) = count(*) END AS agrees FROM answers GROUP BY question_id")
def equivalent_agreement(t: Tables) -> DataFrame:
    return E.agreement(t.answers.withColumn("p", F.nullif("recommendation", F.lit(""))), "question_id", "p", 3)


@query("SELECT answer_id, count(*) AS n, CASE WHEN count(*) >= 3 THEN count(DISTINCT status) = 1 AND count(status) = count(*) END AS agrees FROM answers GROUP BY answer_id")
def repeat_agreement(t: Tables) -> DataFrame:
    return E.agreement(t.answers, "answer_id", "status", 3)


@query("""
WITH p AS (SELECT answer_id, question_id, min(recommendation) AS rec FROM answers GROUP BY ALL), c AS (SELECT a.answer_id, b.answer_id AS control, a.rec AS x, b.rec AS y FROM p a JOIN p b ON b.answer_id = a.answer_id + 1)
SELECT answer_id, bool_and(x <> y) AS distinguished FROM c GROUP BY answer_id
""")
def negative_controls(t: Tables) -> DataFrame:
    """A changed question must not get the same answer: here each answer's control is the next one."""
    p = t.answers.groupBy("answer_id").agg(F.min("recommendation").alias("rec")).withColumn("distinct_from", F.array(F.col("answer_id") + 1))
    wanted = p.select("answer_id", "rec", F.explode("distinct_from").alias("control"))
    return wanted.join(p.select(F.col("answer_id").alias("control"), F.col("rec").alias("other")), "control").groupBy("answer_id").agg(F.bool_and(F.col("rec") != F.col("other")).alias("distinguished"))


@query("SELECT 'missing' AS side, item_id, n FROM (SELECT item_id, count(*) AS n FROM (SELECT item_id FROM benchmark EXCEPT ALL SELECT item_id FROM benchmark WHERE item_id % 7 <> 0) GROUP BY 1)")
def result_agreement(t: Tables) -> DataFrame:
    """Rows that one result has and the other lacks, duplicates counted, order ignored."""
    expected, got = t.benchmark.select("item_id"), t.benchmark.filter("item_id % 7 <> 0").select("item_id")
    side = lambda name, df: df.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "item_id", "n")
    return side("missing", expected.exceptAll(got)).union(side("extra", got.exceptAll(expected)))
