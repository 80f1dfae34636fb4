"""Queries of guardrails, rules, tiers, answer memory and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.catalog import query
from riskloom.operators import factsheet as S
from riskloom.operators import leaves as V
from riskloom.operators import quality as Q
from riskloom.operators import scans as N
from riskloom.plans.sources import _scratch
from riskloom.sources.views import Tables

_INJ = "|".join(Q.INJECTION)


@query(f"SELECT answer_id, seq, regexp_matches(lower(text), '{_INJ}') AS injected FROM answers")
def injection_filter(t: Tables) -> DataFrame:
    return t.answers.select("answer_id", "seq", Q.injected(F.col("text")).alias("injected"))


def _listed(phrases: tuple[str, ...]) -> str:
    return "list_filter([" + ", ".join(f"'{p}'" for p in phrases) + "], lambda p: contains(body, p))"


@query(f"""
WITH b AS (SELECT *, lower(recommendation || ' ' || text) AS body FROM answers), f AS (SELECT *, {_listed(Q.PROHIBITED)} AS bad, {_listed(Q.HIGH_TIER)} AS high,
  CASE analysis_type WHEN 'factsheet' THEN 'low' ELSE 'medium' END AS base FROM b),
g AS (SELECT *, recommendation <> '' AND base = 'low' AND len(high) = 0 AS lifted FROM f)
SELECT answer_id, seq, CASE WHEN len(bad) > 0 THEN 'prohibited' WHEN len(high) > 0 OR answer_status = 'ESCALATE' THEN 'high' WHEN lifted THEN 'medium' ELSE base END AS tier,
  array_to_string(list_sort(CASE WHEN len(bad) > 0 THEN list_transform(bad, lambda p: 'prohibited_action:' || replace(p, ' ', '_')) ELSE list_concat(list_transform(high, lambda p: 'material_conclusion:' || replace(p, ' ', '_')),
  list_filter([CASE WHEN lifted THEN 'carries_a_recommendation' END, CASE WHEN answer_status = 'ESCALATE' THEN 'model_requested_escalation' END], lambda x: x IS NOT NULL)) END), ',') AS reasons FROM g
""")
def action_tier(t: Tables) -> DataFrame:
    body = F.lower(F.concat_ws(" ", "recommendation", "text"))
    rows = t.answers.withColumn("x", Q.tier(body, F.col("analysis_type"), F.col("recommendation"), F.col("answer_status")))
    return rows.select("answer_id", "seq", "x.tier", F.concat_ws(",", "x.reasons").alias("reasons"))


#: A registry of rules and their evidence; the third rule's evidence doesn't cite its threshold.
_RULES = """
SELECT * FROM (VALUES ('sama.watchlist.utilisation', 'utilisation_pct', 'gte', 60.0e0, 'pct', 'SAMA', 'sme,corporate', DATE '1995-01-01', CAST(NULL AS DATE), 'E1'),
  ('cbuae.utilisation', 'utilisation_pct', 'gt', 40.0e0, 'pct', 'CBUAE', 'retail,sme,corporate', DATE '1996-01-01', DATE '2030-01-01', 'E2'),
  ('sama.uncited', 'utilisation_pct', 'lt', 20.0e0, 'pct', 'SAMA', 'retail', DATE '1996-01-01', CAST(NULL AS DATE), 'E3'),
  ('sama.unit', 'utilisation_pct', 'lt', 20.0e0, 'x', 'SAMA', 'corporate', DATE '1996-01-01', CAST(NULL AS DATE), 'E1'),
  ('sama.expired', 'utilisation_pct', 'gt', 1.0e0, 'pct', 'SAMA', 'retail', DATE '1990-01-01', DATE '1999-01-01', 'E1'),
  ('cbuae.noevidence', 'utilisation_pct', 'lte', 50.0e0, 'pct', 'CBUAE', 'sme', DATE '1996-01-01', CAST(NULL AS DATE), 'E9'))
AS r(rule_id, metric, operator, threshold, unit, jurisdiction, portfolio_list, effective_from, effective_to, evidence_id)
"""
_EVIDENCE = "SELECT * FROM (VALUES ('E1', 'A utilisation of 60.0 per cent is watched, 1,200 cases.'), ('E2', 'Above 40 per cent.'), ('E3', 'No figure here.')) AS e(evidence_id, text)"
_AS_OF = "2001-12-31"


def _rules(t: Tables) -> DataFrame:
    return t.spark.sql(_RULES).withColumn("portfolios", F.split("portfolio_list", ","))


def _sheets(t: Tables) -> DataFrame:
    w = S.windows(S.metric_columns(t.om))
    m = F.col("last.utilisation_pct")
    return w.select("obligor_id", "last.portfolio", "last.jurisdiction", m["value"].alias("value"), m["unit"].alias("metric_unit"), m["validation_status"].alias("metric_status"))


@query(f"""
SELECT obligor_id, observation_date, rule_id FROM om JOIN ({_RULES}) r ON om.jurisdiction = r.jurisdiction AND list_contains(string_split(portfolio_list, ','), om.portfolio) AND effective_from <= observation_date AND (effective_to IS NULL OR effective_to >= observation_date)
""")
def rules_applicable(t: Tables) -> DataFrame:
    """The rules that apply to each obligor's month, by jurisdiction, portfolio and date."""
    return Q.applicable(t.om, _rules(t), F.col("observation_date")).select("obligor_id", "observation_date", "rule_id")


_SHEETS = """
SELECT obligor_id, portfolio, jurisdiction, CASE WHEN facility_limit > 0 THEN floor(floor(outstanding / facility_limit * 1e6 + 0.5e0) / 1e6 * 100e0 * 1e4 + 0.5e0) / 1e4 END AS value,
  CASE WHEN facility_limit > 0 THEN 'valid' ELSE 'invalid' END AS metric_status FROM (SELECT *, row_number() OVER (PARTITION BY obligor_id ORDER BY observation_date DESC) AS z FROM om) WHERE z = 1
"""
_JOINED = f"""
SELECT s.*, r.rule_id, r.operator, r.threshold, r.unit, e.text AS evidence FROM ({_SHEETS}) s JOIN ({_RULES}) r ON s.jurisdiction = r.jurisdiction AND list_contains(string_split(portfolio_list, ','), s.portfolio)
  AND effective_from <= DATE '{_AS_OF}' AND (effective_to IS NULL OR effective_to >= DATE '{_AS_OF}') LEFT JOIN ({_EVIDENCE}) e ON r.evidence_id = e.evidence_id
"""


@query(f"""
WITH j AS (SELECT *, CASE WHEN metric_status = 'invalid' THEN 'metric_invalid' WHEN unit <> 'pct' THEN 'unit_mismatch' WHEN evidence IS NULL THEN 'evidence_absent'
  WHEN len(list_filter(regexp_extract_all(evidence, '[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda x: abs(CAST(replace(x, ',', '') AS DOUBLE) - threshold) <= 1e-9 * threshold)) = 0 THEN 'threshold_not_cited' END AS reason FROM ({_JOINED}) x)
SELECT obligor_id, rule_id, reason, CASE WHEN reason IS NOT NULL THEN 'unevaluable' WHEN CASE operator WHEN 'gte' THEN value >= threshold WHEN 'gt' THEN value > threshold WHEN 'lt' THEN value < threshold ELSE value <= threshold END THEN 'fired' ELSE 'not_fired' END AS outcome FROM j
""")
def evaluate_rules(t: Tables) -> DataFrame:
    return Q.evaluate_rules(_sheets(t), _rules(t), t.spark.sql(_EVIDENCE), _AS_OF)


@query(f"SELECT obligor_id, rule_id, threshold FROM ({_JOINED}) j")
def rule_factsheet_join(t: Tables) -> DataFrame:
    day = F.lit(_AS_OF).cast("date")
    rules = _rules(t).filter((F.col("effective_from") <= day) & (F.col("effective_to").isNull() | (F.col("effective_to") >= day))).withColumnRenamed("jurisdiction", "j")
    return _sheets(t).join(F.broadcast(rules), (F.col("jurisdiction") == F.col("j")) & F.array_contains("portfolios", F.col("portfolio"))).select("obligor_id", "rule_id", "threshold")  # a registry


_PASSAGES = "SELECT doc_id, text, CASE doc_id % 7 WHEN 0 THEN 'E1' WHEN 1 THEN 'E2' WHEN 2 THEN 'E3' ELSE 'X' END AS evidence_id FROM policy_docs WHERE approval_status = 'approved'"


@query(rf"""
WITH r AS ({_RULES}), e AS ({_PASSAGES})
SELECT rule_id, doc_id, coalesce(len(list_filter(regexp_extract_all(text, '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: abs(TRY_CAST(replace(x, ',', '') AS DOUBLE) - threshold) <= 1e-9 * threshold)) > 0, false) AS cited FROM r LEFT JOIN e USING (evidence_id)
""")
def rule_evidence_lookup(t: Tables) -> DataFrame:
    """The passages that each rule names as its evidence, and whether they cite its threshold; a rule without any stays."""
    found = t.sql(_PASSAGES, "policy_docs").join(F.broadcast(_rules(t).select("rule_id", "evidence_id", "threshold")), "evidence_id", "right")  # a registry
    return found.select("rule_id", "doc_id", F.coalesce(Q.threshold_cited(F.col("threshold"), F.col("text")), F.lit(False)).alias("cited"))


@query(r"""
SELECT doc_id, len(list_filter(regexp_extract_all(text, '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: abs(TRY_CAST(replace(x, ',', '') AS DOUBLE) - 42e0) <= 42e-9)) > 0 AS cited FROM documents
""")
def threshold_cited(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.coalesce(Q.threshold_cited(F.lit(42.0), F.col("text")), F.lit(False)).alias("cited"))


_SPACES = r"'[ \t\n\x0B\f\r]+'"
#: DuckDB: a statement's normal form, the sentences of a text, and whether one is among the other.
NORM = rf"lower(regexp_replace(trim(regexp_replace({{0}}, {_SPACES}, ' ', 'g')), '\.+$', ''))"
SUPPORTED = rf"coalesce({NORM.format('{0}')} <> '' AND list_contains(list_transform(string_split_regex(regexp_replace({{1}}, '([.!?])[ \t\n\x0B\f\r]+', E'\\1\n', 'g'), '\n+'), lambda z: {NORM.format('z')}), {NORM.format('{0}')}), false)"


@query(rf"""
WITH s AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'not in the text at all' WHEN 1 THEN '. ' WHEN 2 THEN ' ' || string_split_regex(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', E'\\1\n', 'g'), '\n+')[1] || '.'
  ELSE regexp_extract(text, '^[^.!?]*') END AS statement FROM documents)
SELECT doc_id, {SUPPORTED.format('statement', 'text')} AS supported FROM s
""")
def supported_text(t: Tables) -> DataFrame:
    first = F.element_at(F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), "\n+"), 1)
    statement = F.when(F.col("doc_id") % 4 == 0, "not in the text at all").when(F.col("doc_id") % 4 == 1, ". ").when(F.col("doc_id") % 4 == 2, F.concat(F.lit(" "), first, F.lit("."))).otherwise(F.regexp_extract("text", r"^[^.!?]*", 0))
    return t.documents.select("doc_id", Q.supported(statement, F.col("text")).alias("supported"))


@query("SELECT answer_id, seq, status FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY seq DESC) AS n FROM answers) WHERE n = 1")
def latest_memory(t: Tables) -> DataFrame:
    return Q.latest(t.answers, "answer_id").select("answer_id", "seq", "status")


@query("""
SELECT question_id, context_id, answer_id, seq, status FROM (SELECT *, row_number() OVER (PARTITION BY question_id, context_id ORDER BY CASE status WHEN 'verified' THEN 0 WHEN 'system' THEN 1 WHEN 'model' THEN 2 ELSE 3 END, seq DESC, answer_id DESC) AS n FROM answers) WHERE n = 1
""")
def memory_lookup(t: Tables) -> DataFrame:
    return Q.lookup(t.answers, "question_id", "context_id").select("question_id", "context_id", "answer_id", "seq", "status")


@query("""
SELECT a.answer_id, a.seq, max({'s': b.seq, 'i': b.answer_id}).i AS previous_id FROM answers a JOIN answers b ON a.question_id = b.question_id AND a.context_id <> b.context_id AND b.status IN ('verified', 'system') GROUP BY ALL
""")
def memory_previous(t: Tables) -> DataFrame:
    return Q.previous(t.answers)


_ASKED = """
SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN '  What   is the DSCR of OBL-' || CAST(c_custkey AS VARCHAR(12)) || ' ? ' WHEN 1 THEN 'Stage of obl ' || CAST(c_custkey AS VARCHAR(12)) || '!!' WHEN 2 THEN 'limit of FAC-00' || CAST(c_custkey % 100 AS VARCHAR(12)) || '?'
  WHEN 3 THEN 'Is OBL-' || CAST(10000 + c_custkey AS VARCHAR(12)) || ' like obl ' || CAST(c_custkey AS VARCHAR(12)) || ' or fac 9?' WHEN 4 THEN 'fac_' || CAST(c_custkey AS VARCHAR(12)) || '-02 and FAC0003 7.' WHEN 5 THEN '? !Global obl-x 12'
  WHEN 6 THEN 'obl' || CAST(c_custkey * 1000003 AS VARCHAR(16)) || ' ' ELSE 'No entity here. ' END AS text FROM customer
"""
# the text between the ids and the ids, each in its form, put together again
_ID = r"\b(?:obl|fac)[-_ ]?[0-9]+(?:[-_ ][0-9]+)?\b"
_PADDED = "upper(m[1:3]) || '-' || lpad(ltrim(regexp_extract(m, '[0-9]+'), '0'), CAST(greatest(4, length(ltrim(regexp_extract(m, '[0-9]+'), '0'))) AS INTEGER), '0') || CASE WHEN regexp_matches(m, '[0-9][-_ ][0-9]') THEN '-' || CAST(regexp_extract(m, '[0-9]+$') AS BIGINT) ELSE '' END"
_QUESTIONS = rf"""
WITH q AS (SELECT id, rtrim(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))), '?.! ') AS x FROM ({_ASKED}) a),
n AS (SELECT id, string_split_regex(x, '{_ID}') AS apart, list_transform(regexp_extract_all(x, '{_ID}'), lambda m: {_PADDED}) AS ids FROM q)
SELECT id, array_to_string(list_transform(range(1, len(apart) + 1), lambda i: apart[i] || coalesce(ids[i], '')), '') AS question FROM n
"""


@query(_QUESTIONS)
def normalise_question(t: Tables) -> DataFrame:
    return t.sql(_ASKED, "customer").select("id", Q.normal_question(F.col("text")).alias("question"))


@query(f"""
WITH k AS (SELECT id, question, sha256('{{"context":' || (id % 7) || '}}') AS context_key FROM ({_QUESTIONS}) x)
SELECT id, context_key, sha256('{{"context_key":"' || context_key || '","question":' || CAST(to_json(question) AS VARCHAR) || '}}') AS answer_key,
  sha256('{{"plan":"p' || (id % 3) || '","question":' || CAST(to_json(question) AS VARCHAR) || '}}') AS question_key FROM k
""")
def answer_keys(t: Tables) -> DataFrame:
    """Keys of a context, of a question in it, and of a question about a plan in any context."""
    key = lambda *columns: F.sha2(F.to_json(F.struct(*columns)), 256)
    rows = t.sql(_ASKED, "customer").select("id", Q.normal_question(F.col("text")).alias("question"), key((F.col("id") % 7).alias("context")).alias("context_key"))
    plan = F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("plan")
    return rows.select("id", "context_key", key("context_key", "question").alias("answer_key"), key(plan, "question").alias("question_key"))


@query("""
SELECT a.obligor_id, a.observation_date, array_to_string(list_filter([CASE WHEN a.outstanding IS DISTINCT FROM b.outstanding THEN 'outstanding' END, CASE WHEN a.pit_pd IS DISTINCT FROM b.pit_pd THEN 'pit_pd' END,
  CASE WHEN a.stage IS DISTINCT FROM b.stage THEN 'stage' END], lambda x: x IS NOT NULL), ',') AS changed FROM loads a JOIN loads b ON a.obligor_id = b.obligor_id AND a.observation_date = b.observation_date AND a.load_id = 1 AND b.load_id = 2
""")
def field_diff(t: Tables) -> DataFrame:
    side = lambda n, name: t.loads.filter(F.col("load_id") == n).select("obligor_id", "observation_date", F.struct("outstanding", "pit_pd", "stage").alias(name))
    joined = side(1, "a").join(side(2, "b"), ["obligor_id", "observation_date"])
    return joined.select("obligor_id", "observation_date", F.concat_ws(",", Q.changed("outstanding", "pit_pd", "stage")).alias("changed"))


_NESTED = """
SELECT event_id, '{"k": ' || CAST(event_id % 7 AS VARCHAR(4)) || ', "facts": [{"ids": ["a", "b' || CAST(user_id AS VARCHAR(12)) || '"]}, {"value": ' || CAST(event_id % 3 AS VARCHAR(4)) || '.5}], "odd.key": null}' AS doc,
  CASE event_id % 5 WHEN 0 THEN 'k' WHEN 1 THEN 'facts.0.ids.1' WHEN 2 THEN 'facts.1.value' WHEN 3 THEN 'facts.7.value' ELSE 'facts.ids' END AS path FROM events
"""


@query(f"""
WITH n AS ({_NESTED}) SELECT event_id, CASE path WHEN 'k' THEN json_extract_string(doc, '$.k') WHEN 'facts.0.ids.1' THEN json_extract_string(doc, '$.facts[0].ids[1]') WHEN 'facts.1.value' THEN json_extract_string(doc, '$.facts[1].value') END AS value FROM n
""")
def json_path_field(t: Tables) -> DataFrame:
    """A field by a dotted path, numbers being places in lists: each document is followed along its own path, in one pass."""
    rows = t.sql(_NESTED, "events").withColumn("doc", F.try_parse_json("doc"))
    return V.fields(rows, "doc", "path", "f").select("event_id", F.col("f.text").alias("value"))


_MODEL = "SELECT answer_id, seq, CASE answer_id % 4 WHEN 0 THEN '```json' || chr(10) || '{\"status\": \"' || status || '\", \"stage\": ' || (answer_id % 3 + 1) || '}' || chr(10) || '```' WHEN 1 THEN '{\"status\": \"' || status || '\", \"stage\": 2}' WHEN 2 THEN '{\"status\": \"' || status ELSE 'no json' END AS raw FROM answers"


@query(rf"""
WITH m AS ({_MODEL}), c AS (SELECT *, trim(coalesce(nullif(regexp_extract(raw, '(?s)```(?:json)?\s*(.*?)\s*```', 1), ''), raw)) AS body FROM m)
SELECT answer_id, seq, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.status') END AS status, CASE WHEN json_valid(body) THEN CAST(json_extract_string(body, '$.stage') AS BIGINT) END AS stage, starts_with(body, '{{') AND NOT ends_with(body, '}}') AS truncated FROM c
""")
def parse_model_json(t: Tables) -> DataFrame:
    fenced = F.nullif(F.regexp_extract("raw", r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit(""))
    rows = t.sql(_MODEL, "answers").withColumn("body", F.trim(F.coalesce(fenced, "raw")))
    whole = F.when(F.expr("try_parse_json(body) is not null"), F.from_json("body", "status string, stage long"))
    rows = rows.withColumn("j", whole)
    return rows.select("answer_id", "seq", "j.status", "j.stage", (F.startswith("body", F.lit("{")) & ~F.endswith("body", F.lit("}"))).alias("truncated"))


@query("SELECT user_id AS run, event_id AS iter, floor(value * 100 + 0.5e0)::BIGINT AS cents, CASE WHEN event_type = 'error' THEN 'valid' ELSE 'train' END AS split FROM events")
def read_run_metrics(t: Tables) -> DataFrame:
    """Training logs written as text lines and parsed again."""
    path = _scratch(t, "logs")
    split = F.when(F.col("event_type") == "error", "valid").otherwise("train")
    t.events.select(F.format_string("run %d iter %d %s loss %d", "user_id", "event_id", split, F.floor(F.col("value") * 100 + 0.5)).alias("value")).write.text(path)
    part = lambda i: F.regexp_extract("value", r"^run (\d+) iter (\d+) (\w+) loss (-?\d+)$", i)
    return t.spark.read.text(path).select(part(1).cast("long").alias("run"), part(2).cast("long").alias("iter"), part(4).cast("long").alias("cents"), part(3).alias("split"))


@query("""
WITH r AS (SELECT user_id AS run, min(event_id) AS first, max(event_id) AS last, arg_min(ts, event_id) AS a, arg_max(ts, event_id) AS z FROM events GROUP BY 1)
SELECT run, last - first AS units, floor((epoch_us(z) - epoch_us(a)) / 1000000)::BIGINT AS seconds FROM r
""")
def progress_rate(t: Tables) -> DataFrame:
    r = t.events.groupBy(F.col("user_id").alias("run")).agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.min_by("ts", "event_id").alias("a"), F.max_by("ts", "event_id").alias("z"))
    return r.select("run", (F.col("last") - F.col("first")).alias("units"), F.expr("floor((unix_micros(cast(z as timestamp)) - unix_micros(cast(a as timestamp))) / 1000000)").cast("long").alias("seconds"))


@query("""
WITH RECURSIVE l AS (SELECT user_id AS run, event_id AS iter, value AS loss, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT run, k, iter AS best_iter, loss AS best, 0 AS misses FROM l WHERE k = 1 UNION ALL
  SELECT f.run, l.k, CASE WHEN l.loss < f.best - 0.05e0 THEN l.iter ELSE f.best_iter END, CASE WHEN l.loss < f.best - 0.05e0 THEN l.loss ELSE f.best END, CASE WHEN l.loss < f.best - 0.05e0 THEN 0 ELSE f.misses + 1 END
  FROM f JOIN l ON l.run = f.run AND l.k = f.k + 1 WHERE f.misses < 5)
SELECT run, best_iter, floor(best * 100 + 0.5e0)::BIGINT AS best_cents, k = (SELECT max(k) FROM l x WHERE x.run = f.run) AND misses < 5 AS ran_out FROM f QUALIFY row_number() OVER (PARTITION BY run ORDER BY k DESC) = 1
""")
def best_checkpoint(t: Tables) -> DataFrame:
    """The iteration of a run's best loss, by the margin of 0.05; a run is over after five misses."""
    found = N.best_steps(t.events, "user_id", "event_id", "value", 0.05)
    return found.select("run", F.col("best_place").alias("best_iter"), F.floor(F.col("best") * 100 + 0.5).cast("long").alias("best_cents"), "ran_out")


@query("""
WITH p AS (SELECT *, lag(context_id) OVER w AS c, lag(status) OVER w AS s, lag(recommendation) OVER w AS r, lag(answer_id) OVER w AS before FROM answers WINDOW w AS (PARTITION BY question_id ORDER BY answer_id, seq))
SELECT answer_id, seq, array_to_string(list_filter([CASE WHEN context_id IS DISTINCT FROM c THEN 'context_id' END, CASE WHEN status IS DISTINCT FROM s THEN 'status' END, CASE WHEN recommendation IS DISTINCT FROM r THEN 'recommendation' END], lambda x: x IS NOT NULL), ',') AS changed FROM p WHERE before IS NOT NULL
""")
def context_changes(t: Tables) -> DataFrame:
    """What changed in the context since a question's previous answer."""
    fields = F.struct("context_id", "status", "recommendation")
    rows = t.answers.select("question_id", "answer_id", "seq", fields.alias("b"))
    rows = N.lagged(rows, ["question_id"], ["answer_id", "seq"], F.col("b"), "a").filter("a is not null")
    return rows.select("answer_id", "seq", F.concat_ws(",", Q.changed("context_id", "status", "recommendation")).alias("changed"))


@query("SELECT answer_id, seq, array_to_string(list_sort(list_transform(string_split(recommendation, ' '), lambda x: lower(trim(x)))), ' ') AS projection FROM answers")
def normal(t: Tables) -> DataFrame:
    """An answer's list of words in a form without order and case."""
    words = F.transform(F.split("recommendation", " "), lambda x: F.lower(F.trim(x)))
    return t.answers.select("answer_id", "seq", F.concat_ws(" ", F.sort_array(words)).alias("projection"))
