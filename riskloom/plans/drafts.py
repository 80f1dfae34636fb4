"""Queries over drafted answers: citations, derivations, guardrails, admission, scores and assessments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.catalog import CATALOG, query
from riskloom.functions import columns as C
from riskloom.operators import assessment as A
from riskloom.operators import drafts as D
from riskloom.operators import evaluation as E
from riskloom.operators import factsheet as S
from riskloom.operators import leaves as V
from riskloom.operators import quality as Q
from riskloom.plans import quality as P
from riskloom.sources.shared import written
from riskloom.sources.views import Tables

_VALUE = "calculated_metrics.utilisation_pct"


def _sheets(t: Tables) -> DataFrame:
    return P._sheets(t).select("obligor_id", F.lit("utilisation_pct").alias("metric"), "value", "metric_unit", "metric_status")


def _sources(t: Tables, sheets: DataFrame | None = None) -> DataFrame:
    """What a draft may cite: its passages, and its factsheet if there is one."""
    sheets = _sheets(t) if sheets is None else sheets
    said = F.coalesce(F.concat(F.lit(f"{_VALUE} = "), C.number_text(F.col("value")), F.lit(".")), F.lit(""))
    own = t.drafts.join(sheets, "obligor_id").select("answer_id", "seq", F.col("sheet_id").alias("evidence_id"), "jurisdiction", said.alias("text"))
    return t.draft_sources.unionByName(own)


def _facts(t: Tables, sheets: DataFrame | None = None) -> DataFrame:
    sheets = _sheets(t) if sheets is None else sheets
    rows = t.draft_facts.join(sheets.select("obligor_id", "value"), "obligor_id", "left")
    observed = F.col("value") + F.col("d_shift")
    own = F.coalesce(F.concat(F.lit(f"{_VALUE} = "), C.number_text(observed), F.lit(".")), F.lit("no sheet"))
    d = F.struct(F.col("d_metric").alias("metric"), observed.alias("observed"), F.col("d_unit").alias("unit"), F.col("d_operator").alias("operator"), F.col("d_threshold").alias("threshold"), F.col("d_holds").alias("holds"), F.col("d_evidence").alias("evidence_id"), F.col("d_rule").alias("rule_id"))
    return rows.select("answer_id", "seq", "fact_no", "obligor_id", F.coalesce("statement", own).alias("statement"), D.listed(F.col("cites")).alias("cites"), F.when(F.col("d_metric").isNotNull(), d).alias("d"))


def _rules(t: Tables, sheets: DataFrame | None = None) -> DataFrame:
    """The rules that were evaluated for each obligor, and whether they hold (null: unevaluable)."""
    found = CATALOG["evaluate_rules"].build(t) if sheets is None else Q.evaluate_rules(sheets, P._rules(t), t.spark.sql(P._EVIDENCE), P._AS_OF)
    found = found.withColumn("holds", F.when(F.col("outcome") != "unevaluable", F.col("outcome") == "fired"))
    return found.join(F.broadcast(P._rules(t).select("rule_id", "metric", "unit", "operator", "evidence_id", "threshold")), "rule_id")  # a registry


def _derivations(t: Tables, facts: DataFrame, sheets: DataFrame) -> DataFrame:
    # the registry names its evidence E1 where a draft's passage is E0
    rules = _rules(t, sheets if "portfolio" in sheets.columns else None).withColumn("evidence_id", F.when(F.col("evidence_id") == "E1", "E0").otherwise(F.col("evidence_id")))
    return D.derivation_failures(facts, sheets.drop("portfolio", "jurisdiction"), t.draft_sources, rules)


def _narrated(t: Tables) -> DataFrame:
    narrative = F.concat(F.array("summary", "recommendation"), *(D.listed(F.col(c)) for c in ("drivers", "missing_information", "mitigants", "inferences", "bases")))
    return t.drafts.withColumns({"narrative": narrative, "structured": D.listed(F.col("structured_ids"))})


def _merged(df: DataFrame, name: str) -> DataFrame:
    """Written, and never broadcast: texts repeat, so that millions of rows make a file of a few MB, by whose size Spark would
    collect them in the driver."""
    return written(df, name).hint("merge")


@dataclass
class _Parts:
    """What several checks of the drafts need, each computed once."""

    sheets: DataFrame
    facts: DataFrame
    sources: DataFrame
    derivations: DataFrame
    drafts: DataFrame

    @classmethod
    def of(cls, t: Tables) -> _Parts:
        whole = _merged(P._sheets(t).withColumn("metric", F.lit("utilisation_pct")), "sheets")
        sheets = whole.drop("portfolio", "jurisdiction")
        facts, sources = _merged(_facts(t, sheets), "facts"), _merged(_sources(t, sheets), "sources")
        return cls(sheets, facts, sources, _merged(_derivations(t, facts, whole), "derivations"), _merged(_narrated(t), "drafts"))

    def failures(self) -> DataFrame:
        return D.output_failures(self.drafts, self.facts, self.sources, self.derivations)


_LIST = "list_filter(list_transform(string_split({0}, ','), lambda x: trim(x)), lambda x: x <> '')"
_NEAR = "coalesce(abs({0} - {1}) <= greatest(abs({0}), abs({1})) * 1e-9, false)"
_NUMBERS = r"list_transform(regexp_extract_all({0}, '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: CAST(replace(x, ',', '') AS DOUBLE))"
_BASE = f"""
sh AS ({P._SHEETS}),
s AS (SELECT answer_id, seq, evidence_id, jurisdiction, text, true AS passage FROM draft_sources UNION ALL
  SELECT answer_id, seq, sheet_id, d.jurisdiction, CASE WHEN value IS NULL THEN '' ELSE '{_VALUE} = ' || value || '.' END, false FROM drafts d JOIN sh USING (obligor_id)),
f AS (SELECT x.*, value, metric_status, value + d_shift AS d_observed, coalesce(statement, '{_VALUE} = ' || (value + d_shift) || '.', 'no sheet') AS said, {_LIST.format('cites')} AS ids FROM draft_facts x LEFT JOIN sh USING (obligor_id)),
fc AS (SELECT answer_id, seq, fact_no, unnest(ids) AS evidence_id, unnest(range(1, len(ids) + 1)) AS place FROM f),
ft AS (SELECT answer_id, seq, fact_no, string_agg(text, ' ' ORDER BY place) AS cited_text, count(text) AS known FROM fc LEFT JOIN s USING (answer_id, seq, evidence_id) GROUP BY ALL),
g AS (SELECT f.*, coalesce(known, 0) AS known, {P.SUPPORTED.format('said', "coalesce(cited_text, '')")} AS supported FROM f LEFT JOIN ft USING (answer_id, seq, fact_no)),
ru AS (SELECT obligor_id, e.rule_id, CASE WHEN outcome <> 'unevaluable' THEN outcome = 'fired' END AS holds, metric, unit, operator, threshold, replace(evidence_id, 'E1', 'E0') AS evidence_id FROM ({CATALOG['evaluate_rules'].sql}) e JOIN ({P._RULES}) r ON e.rule_id = r.rule_id),
dj AS (SELECT f.*, p.text AS source, CASE WHEN d_metric = 'utilisation_pct' THEN metric_status END AS m, r.rule_id IS NOT NULL AS ruled, r.metric AS r_metric, r.unit AS r_unit, r.operator AS r_operator, r.evidence_id AS r_evidence, r.threshold AS r_threshold, r.holds AS r_holds
  FROM f LEFT JOIN s p ON p.passage AND p.answer_id = f.answer_id AND p.seq = f.seq AND p.evidence_id = d_evidence LEFT JOIN ru r ON r.obligor_id = f.obligor_id AND r.rule_id = d_rule WHERE d_metric IS NOT NULL),
dv AS (SELECT answer_id, seq, fact_no, d_rule, ruled AND r_holds IS DISTINCT FROM d_holds AS contradicts, list_sort(list_filter([
  CASE WHEN m IS NULL THEN 'metric_not_found' END, CASE WHEN m <> 'valid' THEN 'metric_not_valid' END, CASE WHEN m = 'valid' AND NOT {_NEAR.format('value', 'd_observed')} THEN 'observed_value_mismatch' END,
  CASE WHEN m = 'valid' AND d_unit <> 'pct' THEN 'unit_mismatch' END, CASE WHEN source IS NULL THEN 'threshold_evidence_not_found' END, CASE WHEN d_rule IS NOT NULL AND NOT ruled THEN 'rule_not_found' END,
  CASE WHEN ruled AND r_metric <> d_metric THEN 'rule_metric_mismatch' END, CASE WHEN ruled AND r_unit <> d_unit THEN 'rule_unit_mismatch' END, CASE WHEN ruled AND r_operator <> d_operator THEN 'rule_operator_mismatch' END,
  CASE WHEN ruled AND r_evidence <> d_evidence THEN 'rule_evidence_mismatch' END, CASE WHEN ruled AND NOT {_NEAR.format('r_threshold', 'd_threshold')} THEN 'rule_threshold_mismatch' END,
  CASE WHEN d_rule IS NULL AND len(list_filter({_NUMBERS.format('source')}, lambda x: {_NEAR.format('x', 'd_threshold')})) = 0 THEN 'threshold_not_in_evidence' END, CASE WHEN d_observed IS NULL THEN 'nonfinite_comparison' END,
  CASE WHEN d_holds <> CASE d_operator WHEN 'gt' THEN d_observed > d_threshold WHEN 'gte' THEN d_observed >= d_threshold WHEN 'lt' THEN d_observed < d_threshold WHEN 'eq' THEN {_NEAR.format('d_observed', 'd_threshold')} END THEN 'comparison_result_mismatch' END,
  CASE WHEN NOT list_contains(ids, d_evidence) THEN 'threshold_evidence_not_cited_by_claim' END], lambda x: x IS NOT NULL)) AS failures FROM dj),
alls AS (SELECT answer_id, seq, string_agg(text, ' ' ORDER BY text) AS all_text FROM s GROUP BY ALL),
na AS (SELECT answer_id, seq, unnest(list_concat([summary, recommendation], {_LIST.format('drivers')}, {_LIST.format('missing_information')}, {_LIST.format('mitigants')}, {_LIST.format('inferences')}, {_LIST.format('bases')})) AS said FROM drafts),
rf AS (SELECT answer_id, seq, evidence_id FROM fc UNION ALL SELECT answer_id, seq, unnest({_LIST.format('structured_ids')}) FROM drafts),
fl AS (
  SELECT answer_id, seq, 'unsupported_claim' AS failure FROM g WHERE NOT supported UNION SELECT answer_id, seq, 'material_fact_without_citation' FROM g WHERE len(ids) = 0
  UNION SELECT answer_id, seq, 'unknown_citation:' || evidence_id FROM rf WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.answer_id = rf.answer_id AND s.seq = rf.seq AND s.evidence_id = rf.evidence_id)
  UNION SELECT answer_id, seq, 'invalid_derivation:' || unnest(failures) FROM dv UNION SELECT answer_id, seq, 'rule_contradiction:' || d_rule FROM dv WHERE contradicts
  UNION SELECT answer_id, seq, 'unverified_narrative' FROM na LEFT JOIN alls USING (answer_id, seq) WHERE said <> '' AND NOT {P.SUPPORTED.format('said', "coalesce(all_text, '')")}
  UNION SELECT answer_id, seq, 'credit_recommendation_requires_human_approval' FROM drafts WHERE NOT human_approval AND recommendation <> ''),
fs AS (SELECT answer_id, seq, list_sort(list(failure)) AS failures FROM fl GROUP BY ALL)
"""


@query(f"WITH {_BASE} SELECT answer_id, seq, fact_no, array_to_string(failures, ',') AS failures FROM dv")
def check_derivation(t: Tables) -> DataFrame:
    """Each fact's derivation against the factsheet, the cited threshold and the rule."""
    sheets = _sheets(t)
    return _derivations(t, _facts(t, sheets), sheets).select("answer_id", "seq", "fact_no", F.concat_ws(",", "failures").alias("failures"))


@query(f"""
WITH {_BASE}, r AS (SELECT rf.*, s.evidence_id IS NULL AS unknown, s.jurisdiction FROM rf LEFT JOIN s USING (answer_id, seq, evidence_id))
SELECT d.answer_id, d.seq, (SELECT count(*) FROM r WHERE r.answer_id = d.answer_id AND r.seq = d.seq) AS citations, (SELECT count(*) FROM r WHERE r.answer_id = d.answer_id AND r.seq = d.seq AND unknown) AS unknown,
  (SELECT count(*) FROM f WHERE f.answer_id = d.answer_id AND f.seq = d.seq AND len(ids) = 0) AS uncited, (SELECT count(*) FROM s WHERE s.answer_id = d.answer_id AND s.seq = d.seq AND s.jurisdiction <> d.jurisdiction) AS foreign_jurisdiction FROM drafts d
""")
def citation_resolution(t: Tables) -> DataFrame:
    """Citations of facts and conclusions, those that resolve to nothing, facts without one, and foreign sources, cited or not."""
    facts, sources, drafts = _facts(t), _sources(t), _narrated(t)
    refs = facts.select(*D.KEYS, F.explode("cites").alias("evidence_id")).union(drafts.select(*D.KEYS, F.explode("structured")))
    cited = refs.join(sources.select(*D.KEYS, "evidence_id", F.lit(True).alias("there")), [*D.KEYS, "evidence_id"], "left")
    counts = cited.groupBy(*D.KEYS).agg(F.count(F.lit(1)).alias("citations"), F.count_if(F.col("there").isNull()).alias("unknown"))
    bare = facts.groupBy(*D.KEYS).agg(F.count_if(F.size("cites") == 0).alias("uncited"))
    foreign = sources.join(drafts.select(*D.KEYS, F.col("jurisdiction").alias("own")), D.KEYS).groupBy(*D.KEYS).agg(F.count_if(F.col("jurisdiction") != F.col("own")).alias("foreign_jurisdiction"))
    rows = drafts.select(*D.KEYS)
    for part in (counts, bare, foreign):
        rows = rows.join(part, D.KEYS, "left")
    return rows.na.fill(0)


@query(f"WITH {_BASE} SELECT answer_id, seq, coalesce(array_to_string(failures, ','), '') AS failures FROM drafts LEFT JOIN fs USING (answer_id, seq)")
def validate_output(t: Tables) -> DataFrame:
    """Facts against their sources, citations, derivations, rules, narrative and human approval."""
    per = _Parts.of(t).failures().groupBy(*D.KEYS).agg(F.concat_ws(",", F.array_sort(F.collect_set("failure"))).alias("failures"))
    return t.drafts.select(*D.KEYS).join(per, D.KEYS, "left").na.fill("")


_TARGET = ["answer_status", "summary", "recommendation", "drivers", "structured_ids", "missing_information", "mitigants", "inferences", "bases", "human_approval", "valid"]
_DERIVED = "coalesce(d_metric, ''), CASE WHEN d_metric IS NULL THEN '' ELSE coalesce(d_observed::VARCHAR, '') END, coalesce(d_unit, ''), coalesce(d_operator, ''), coalesce(d_threshold::VARCHAR, ''), coalesce(d_holds::VARCHAR, ''), coalesce(d_evidence, ''), coalesce(d_rule, '')"
#: Reviews of most drafts; some are of another person's approval, some of an older text.
_REVIEWS = f"""
hf AS (SELECT answer_id, seq, sha256(string_agg(x, '|' ORDER BY x)) AS h FROM (SELECT answer_id, seq, sha256(concat_ws('|', fact_no, said, array_to_string(ids, ','), {_DERIVED})) AS x FROM f) GROUP BY ALL),
hs AS (SELECT answer_id, seq, sha256(string_agg(x, '|' ORDER BY x)) AS h FROM (SELECT answer_id, seq, sha256(concat_ws('|', evidence_id, jurisdiction, text)) AS x FROM s) GROUP BY ALL),
ho AS (SELECT obligor_id, sha256(sha256(concat_ws('|', 'utilisation_pct', coalesce(value::VARCHAR, ''), 'pct', coalesce(metric_status, '')))) AS h FROM sh),
hc AS (SELECT answer_id, seq, sha256(concat_ws('|', {", ".join(f"{c}::VARCHAR" for c in _TARGET)}, coalesce(hf.h, ''), coalesce(hs.h, ''), coalesce(ho.h, ''))) AS content_hash FROM drafts d LEFT JOIN hf USING (answer_id, seq) LEFT JOIN hs USING (answer_id, seq) LEFT JOIN ho USING (obligor_id)),
rw AS (SELECT answer_id, seq, CASE WHEN answer_id % 17 <> 0 THEN 'r1' END AS reviewer, CASE WHEN answer_id % 4 = 1 THEN 'rejected' ELSE 'approved' END AS status, answer_id % 19 <> 0 AS semantic_supported, true AS numerics_verified,
  CASE WHEN answer_id % 6 = 1 THEN 'an older text' ELSE content_hash END AS content_hash FROM hc WHERE seq % 3 <> 1)
"""


@query(f"""
WITH {_BASE}, {_REVIEWS}, rv AS (SELECT DISTINCT answer_id, seq, content_hash FROM rw WHERE reviewer IS NOT NULL AND status = 'approved' AND semantic_supported AND numerics_verified),
op AS (SELECT DISTINCT g.answer_id, g.seq FROM g LEFT JOIN dv USING (answer_id, seq, fact_no) WHERE NOT supported AND (dv.failures IS NULL OR len(dv.failures) > 0)),
j AS (SELECT d.answer_id, d.seq, coalesce(fs.failures, []) AS fa, op.answer_id IS NOT NULL AS open_claim, rv.answer_id IS NOT NULL AS verified FROM drafts d LEFT JOIN fs USING (answer_id, seq) LEFT JOIN op USING (answer_id, seq) LEFT JOIN hc USING (answer_id, seq) LEFT JOIN rv ON rv.answer_id = d.answer_id AND rv.seq = d.seq AND rv.content_hash = hc.content_hash),
k AS (SELECT *, list_sort(list_concat(list_filter(fa, lambda x: x NOT IN ('unsupported_claim', 'unverified_narrative')), CASE WHEN (open_claim OR list_contains(fa, 'unverified_narrative')) AND NOT verified THEN ['semantic_and_numeric_review_required'] ELSE [] END)) AS hard FROM j)
SELECT answer_id, seq, array_to_string(hard, ',') AS failures, len(hard) = 0 AS admissible FROM k
""")
def training_admissible(t: Tables) -> DataFrame:
    """Hard failures are final; those of wording are waived by a review that is bound to the draft, its facts, its sources and
    its factsheet."""
    parts = _Parts.of(t)
    drafts = D.content_hash(parts.drafts, parts.facts, parts.sources, parts.sheets, _TARGET)
    reviews = drafts.filter("seq % 3 <> 1").select(
        *D.KEYS, F.when(F.col("answer_id") % 17 != 0, "r1").alias("reviewer"), F.when(F.col("answer_id") % 4 == 1, "rejected").otherwise("approved").alias("status"), (F.col("answer_id") % 19 != 0).alias("semantic_supported"),
        F.lit(True).alias("numerics_verified"), F.when(F.col("answer_id") % 6 == 1, "an older text").otherwise(F.col("content_hash")).alias("content_hash"),
    )
    found = D.admission(drafts, parts.failures(), parts.facts, parts.sources, parts.derivations, reviews)
    return found.select(*D.KEYS, F.concat_ws(",", "failures").alias("failures"), (F.size("failures") == 0).alias("admissible"))


_WORDS = r"list_distinct(list_transform({0}, lambda x: lower(trim(regexp_replace(x, '[ \t\n]+', ' ', 'g')))))"


@query(f"""
WITH {_BASE}, ff AS (SELECT answer_id, seq, count(*) AS n, avg(CASE WHEN len(ids) > 0 AND known = len(ids) THEN 1e0 ELSE 0e0 END) AS coverage, count(*) FILTER (len(ids) = 0) AS bare,
    max(CASE WHEN starts_with(said, '{_VALUE} = ') THEN TRY_CAST(regexp_replace(replace(said, '{_VALUE} = ', ''), '\\.$', '') AS DOUBLE) END) AS number FROM g GROUP BY ALL),
rs AS (SELECT answer_id, seq, count(*) FILTER (unknown) AS unknown_citations, list(DISTINCT evidence_id) AS refs FROM (SELECT rf.*, NOT EXISTS (SELECT 1 FROM s WHERE s.answer_id = rf.answer_id AND s.seq = rf.seq AND s.evidence_id = rf.evidence_id) AS unknown FROM rf) GROUP BY ALL),
x AS (SELECT d.*, sh.value, n, coverage, bare, number, coalesce(unknown_citations, 0) AS unk, coalesce(refs, []) AS refs, fs.failures AS fa, {_LIST.format('required_evidence')} AS need, {_WORDS.format(_LIST.format('required_drivers'))} AS want, {_WORDS.format(_LIST.format('d.drivers'))} AS have,
    CASE WHEN must_abstain OR is_injection THEN 'INSUFFICIENT_EVIDENCE' ELSE expected_status END AS due, (SELECT count(*) FROM s WHERE s.answer_id = d.answer_id AND s.seq = d.seq AND s.jurisdiction <> d.jurisdiction) AS foreign_ones
  FROM drafts d LEFT JOIN sh USING (obligor_id) LEFT JOIN ff USING (answer_id, seq) LEFT JOIN rs USING (answer_id, seq) LEFT JOIN fs USING (answer_id, seq)),
y AS (SELECT *, valid AND answer_status = due AND (due <> 'ANSWERED' OR n > 0 OR summary <> '' OR drivers <> '') AS correct FROM x),
z AS (SELECT *, outcome = 'answered' AS there, outcome = 'blocked' AND (must_abstain OR is_injection) AS fit FROM y)
SELECT answer_id, seq, CASE WHEN there THEN valid ELSE fit END AS schema_valid, CASE WHEN there THEN correct ELSE fit END AS answer_status_correct, CASE WHEN there THEN valid AND must_abstain AND answer_status = 'INSUFFICIENT_EVIDENCE' ELSE fit END AS abstained_correctly,
  CASE WHEN there THEN valid AND is_injection AND answer_status = 'INSUFFICIENT_EVIDENCE' ELSE fit AND is_injection END AS injection_blocked,
  CASE WHEN there AND valid THEN coalesce(coverage, 0e0) ELSE 0e0 END AS citation_coverage, CASE WHEN len(need) > 0 THEN CASE WHEN there AND valid THEN len(list_intersect(refs, need))::DOUBLE / len(need) ELSE 0e0 END END AS required_evidence_recall,
  there AND correct AND (value IS NULL OR coalesce(abs(number - value) <= 1e-6, false)) AS numeric_agreement, CASE WHEN NOT valid OR NOT there THEN 0e0 WHEN len(want) = 0 THEN 1e0 ELSE len(list_intersect(have, want))::DOUBLE / len(want) END AS driver_recall,
  CASE WHEN there AND valid THEN unk ELSE 0 END AS unknown_citations, CASE WHEN there AND valid THEN foreign_ones ELSE 0 END AS cross_jurisdiction, CASE WHEN NOT there THEN 0 WHEN valid THEN coalesce(bare, 0) ELSE 1 END AS unsupported_claims,
  CASE WHEN there THEN correct AND fa IS NULL ELSE fit END AS grounding_verified, outcome = 'failed' AS provider_failed FROM z
""")
def score_case(t: Tables) -> DataFrame:
    """Every metric of a draft against its case; the expected number is the factsheet's."""
    parts = _Parts.of(t)
    sheet = parts.sheets.select("obligor_id", "value")
    numerics = F.map_from_entries(F.array_compact(F.array(F.when(F.col("value").isNotNull(), F.struct(F.lit(_VALUE), F.col("value"))))))
    cases = parts.drafts.join(sheet, "obligor_id", "left").withColumns({"numerics": numerics, "drivers": D.listed(F.col("drivers")), "required_evidence": D.listed(F.col("required_evidence")), "required_drivers": D.listed(F.col("required_drivers"))})
    return D.scored(cases, parts.facts, parts.sources, parts.failures())


_TASK = "CASE WHEN answer_id % 6 = 5 THEN 'query_plan' ELSE 'credit_analysis' END"
_NONE = "CAST(NULL AS DOUBLE) AS value, 0e0 AS abs_tolerance, 0e0 AS rel_tolerance, CAST(NULL AS VARCHAR(8)) AS unit, CAST(NULL AS VARCHAR(8)) AS currency, CAST(NULL AS VARCHAR(10)) AS as_of_date"
_NO_PATHS = "CAST(NULL AS VARCHAR(40)) AS unit_path, CAST(NULL AS VARCHAR(40)) AS currency_path, CAST(NULL AS VARCHAR(40)) AS as_of_date_path"
#: What the cases expect of the answers' fields, numbers, confidences and plans.
_EXPECTED = f"""
SELECT answer_id, seq, 'field' AS kind, 'answer_status' AS path, 'answered' AS text_expected, {_NONE}, CAST(NULL AS INT) AS outcome, {_NO_PATHS} FROM drafts
UNION ALL SELECT answer_id, seq, 'field', 'summary', 'Exposure  rose.', {_NONE}, NULL, {_NO_PATHS} FROM drafts WHERE answer_id % 3 = 0
UNION ALL SELECT answer_id, seq, 'field', 'risk_drivers', 'LATE filing,the limit stands', {_NONE}, NULL, {_NO_PATHS} FROM drafts WHERE answer_id % 4 = 0
UNION ALL SELECT answer_id, seq, 'field', 'no.such.path', NULL, {_NONE}, NULL, {_NO_PATHS} FROM drafts WHERE answer_id % 10 = 1
UNION ALL SELECT answer_id, seq, 'numeric', '{_VALUE}.value', NULL, 50e0, 5e0, CASE WHEN answer_id % 2 = 0 THEN 0.4e0 ELSE 0e0 END, CASE answer_id % 3 WHEN 0 THEN ' PCT ' WHEN 1 THEN 'x' END, CASE WHEN answer_id % 7 = 2 THEN 'sar' END, CASE WHEN answer_id % 5 = 1 THEN '2023-06-30' END, NULL, NULL, NULL, 'sheet.date' FROM drafts
UNION ALL SELECT answer_id, seq, 'numeric', 'no.such.path', NULL, 1e0, 1e0, 0e0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM drafts WHERE answer_id % 10 = 0
UNION ALL SELECT answer_id, seq, 'confidence', CASE WHEN answer_id % 9 = 4 THEN 'summary' ELSE 'confidence' END, NULL, {_NONE}, answer_id % 2, {_NO_PATHS} FROM drafts WHERE answer_id % 3 <> 1
UNION ALL SELECT answer_id, seq, 'plan', 'plan.portfolio', 'SME', {_NONE}, NULL, {_NO_PATHS} FROM drafts
"""


@query(f"""
WITH {_BASE}, e AS ({_EXPECTED}), d AS (SELECT *, {_TASK} AS task, {_LIST.format('drivers')} AS has, CASE WHEN answer_id % 3 = 2 THEN 'sme' ELSE 'retail' END AS portfolio FROM drafts),
n AS (SELECT d.answer_id, d.seq, e.path, d.valid AND e.path <> 'no.such.path' AND coalesce(abs(sh.value - e.value) <= greatest(abs_tolerance, rel_tolerance * greatest(abs(sh.value), e.value)), false) AND (unit IS NULL OR lower(trim(unit)) = 'pct')
    AND (currency IS NULL OR (answer_id % 2 = 0 AND sh.value IS NOT NULL)) AND (as_of_date IS NULL OR answer_id % 4 <> 3) AS ok FROM e JOIN d USING (answer_id, seq) LEFT JOIN sh ON sh.obligor_id = d.obligor_id WHERE kind = 'numeric'),
fi AS (SELECT answer_id, seq, path, valid AND CASE path WHEN 'answer_status' THEN lower(answer_status) = 'answered' WHEN 'summary' THEN lower(trim(regexp_replace(summary, ' +', ' ', 'g'))) = 'exposure rose.' WHEN 'risk_drivers' THEN list_sort(list_transform(has, lambda x: lower(x))) = ['late filing', 'the limit stands'] ELSE true END AS ok
  FROM e JOIN d USING (answer_id, seq) WHERE kind = 'field'),
co AS (SELECT answer_id, seq, avg(CASE WHEN e.path = 'confidence' THEN pow((answer_id % 10) / 10e0 - e.outcome, 2) ELSE 1e0 END) AS v FROM e JOIN d USING (answer_id, seq) WHERE kind = 'confidence' AND valid AND task = 'credit_analysis' GROUP BY ALL),
rs AS (SELECT answer_id, seq, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM s WHERE s.answer_id = rf.answer_id AND s.seq = rf.seq AND s.evidence_id = rf.evidence_id)) AS known, list(DISTINCT evidence_id) AS refs FROM rf GROUP BY ALL),
c AS (SELECT d.*, coalesce(n, 0) AS n, known, coalesce(refs, []) AS refs, fs.failures IS NULL AS passed, list_distinct({_LIST.format('required_evidence')}) AS need, {_WORDS.format(_LIST.format('required_drivers'))} AS want, {_WORDS.format('has')} AS have, answer_status = 'INSUFFICIENT_EVIDENCE' AS abstains
  FROM d LEFT JOIN rs USING (answer_id, seq) LEFT JOIN fs USING (answer_id, seq)),
m AS (SELECT answer_id, seq, 'field:' || path AS metric, ok::DOUBLE AS v FROM fi UNION ALL SELECT answer_id, seq, 'numerical_agreement', avg(ok::INT::DOUBLE) FROM n GROUP BY ALL UNION ALL SELECT answer_id, seq, 'confidence_brier_score', v FROM co
  UNION ALL SELECT answer_id, seq, 'plan:plan.portfolio', (valid AND portfolio = 'sme')::DOUBLE FROM d WHERE task <> 'credit_analysis' UNION ALL SELECT answer_id, seq, 'json_validity', valid::DOUBLE FROM d UNION ALL SELECT answer_id, seq, 'plan_validity', valid::DOUBLE FROM d WHERE task <> 'credit_analysis'
  UNION ALL SELECT answer_id, seq, 'compilation_success', 0e0 FROM d WHERE task <> 'credit_analysis' AND NOT valid UNION ALL SELECT answer_id, seq, 'extractive_support_heuristic', (valid AND passed)::DOUBLE FROM c WHERE task = 'credit_analysis'
  UNION ALL SELECT answer_id, seq, 'citation_resolution', known::DOUBLE / n FROM c WHERE task = 'credit_analysis' AND valid AND n > 0 UNION ALL SELECT answer_id, seq, 'citation_recall', CASE WHEN valid THEN len(list_intersect(refs, need))::DOUBLE / len(need) ELSE 0e0 END FROM c WHERE task = 'credit_analysis' AND len(need) > 0
  UNION ALL SELECT answer_id, seq, 'driver_recall', CASE WHEN NOT valid THEN 0e0 WHEN len(want) > 0 THEN len(list_intersect(have, want))::DOUBLE / len(want) ELSE (len(have) = 0)::DOUBLE END FROM c WHERE task = 'credit_analysis' AND answer_id % 7 <> 1
  UNION ALL SELECT answer_id, seq, 'driver_precision', CASE WHEN NOT valid THEN 0e0 WHEN len(have) > 0 THEN len(list_intersect(have, want))::DOUBLE / len(have) ELSE (len(want) = 0)::DOUBLE END FROM c WHERE task = 'credit_analysis' AND answer_id % 7 <> 1
  UNION ALL SELECT answer_id, seq, 'abstention_recall', (valid AND abstains)::DOUBLE FROM c WHERE task = 'credit_analysis' AND must_abstain UNION ALL SELECT answer_id, seq, 'abstention_precision', must_abstain::DOUBLE FROM c WHERE task = 'credit_analysis' AND valid AND abstains)
SELECT answer_id, seq, metric, floor(v * 1e6 + 0.5e0) / 1e6 AS value FROM m
""")
def assess_case(t: Tables) -> DataFrame:
    """Every metric of every answer against its case; an answer is a JSON document, and one that isn't valid scores nothing."""
    parts = _Parts.of(t)
    odd = F.col("answer_id") % 2 == 0
    shown = F.struct("value", F.lit("pct").alias("unit"), F.when(odd & F.col("value").isNotNull(), "SAR").alias("currency"))
    document = F.struct(
        "answer_status", "summary", D.listed(F.col("drivers")).alias("risk_drivers"), (F.col("answer_id") % 10 / 10.0).alias("confidence"),
        F.struct(shown.alias("utilisation_pct")).alias("calculated_metrics"), F.struct(F.when(F.col("answer_id") % 4 != 3, "2023-06-30").otherwise("2022-12-31").alias("date")).alias("sheet"),
        F.struct(F.when(F.col("answer_id") % 3 == 2, "sme").otherwise("Retail").alias("portfolio")).alias("plan"),
    )
    drafts = parts.drafts.join(parts.sheets.select("obligor_id", "value"), "obligor_id", "left").withColumn("task", F.expr(_TASK))
    answers = drafts.select(*D.KEYS, "task", F.when(F.col("valid"), F.to_variant_object(document)).alias("document"))
    known = parts.sources.groupBy(*D.KEYS).agg(F.collect_set("evidence_id").alias("known"))
    cites = parts.facts.groupBy(*D.KEYS).agg(F.flatten(F.collect_list("cites")).alias("cites"))
    failed = parts.failures().select(*D.KEYS).distinct().withColumn("failed", F.lit(True))
    none = F.array().cast("array<string>")
    cases = drafts.join(known, D.KEYS, "left").join(cites, D.KEYS, "left").join(failed, D.KEYS, "left").select(
        *D.KEYS, F.col("failed").isNull().alias("passed"), F.concat(F.coalesce("cites", none), "structured").alias("refs"), F.coalesce("known", none).alias("known"), D.listed(F.col("required_evidence")).alias("required_evidence"),
        F.when(F.col("answer_id") % 7 != 1, D.listed(F.col("required_drivers"))).alias("risk_drivers"), D.listed(F.col("drivers")).alias("drivers"), "must_abstain", (F.col("answer_status") == "INSUFFICIENT_EVIDENCE").alias("abstains"),
    )
    return A.assessed(answers, t.sql(_EXPECTED, "drafts"), cases).withColumn("value", C.fixed(F.col("value"), 6))


@query()
def factsheet_statements(t: Tables) -> DataFrame:
    """Every factsheet as statements 'path = value.', for each text, number and date at any depth."""
    sheet = S.factsheets(t.om, P._AS_OF)
    whole = F.to_variant_object(F.struct(*(c for c in sheet.columns if c != "obligor_id")))
    return V.statements(sheet.select("obligor_id", whole.alias("sheet")), ["obligor_id"], "sheet")


_PLAIN = r"trim(regexp_replace(lower({0}), '[ \t\n]+', ' ', 'g'))"
_FIELDS = f"""
st AS (SELECT answer_id, seq, arg_min(stage, (NOT contains(lower(said), 'current'), fact_no)) AS stated FROM (
  SELECT answer_id, seq, fact_no, said, TRY_CAST(regexp_extract(clean, '(?i)\\bstage\\b[^0-9;]{{0,30}}?\\b([1-3])\\b', 1) AS INTEGER) AS stage, clean FROM (SELECT *, regexp_replace(said, '(?i)\\b(?:OBL|FAC)[-_ ]?[0-9]+(?:[-_ ][0-9]+)?\\b', ' ', 'g') AS clean FROM f) x)
  WHERE stage IS NOT NULL AND NOT regexp_matches(clean, '(?i)\\b(?:migrat\\w*|from\\s+(?:stage\\s+)?[1-3]\\s+to)\\b') GROUP BY ALL),
ci AS (SELECT answer_id, seq, array_to_string(list_sort(list(DISTINCT evidence_id)), ',') AS cited FROM fc GROUP BY ALL),
df AS (SELECT d.answer_id, d.seq, valid, question_id, split, status, answer_status, coalesce(conclusion_stage, stated) AS stage, array_to_string(list_sort(list_transform({_LIST.format('drivers')}, lambda x: {_PLAIN.format('x')})), ',') AS risk_drivers, {_PLAIN.format('d.recommendation')} AS recommendation, coalesce(cited, '') AS cited
  FROM drafts d JOIN (SELECT answer_id, seq, status FROM answers) z USING (answer_id, seq) LEFT JOIN st USING (answer_id, seq) LEFT JOIN ci USING (answer_id, seq))
"""


def _fields(t: Tables) -> DataFrame:
    return D.decision_fields(t.drafts, _facts(t))


@query(f"WITH {_BASE}, {_FIELDS} SELECT answer_id, seq, answer_status, stage, risk_drivers, recommendation, cited FROM df WHERE valid")
def decision_fields(t: Tables) -> DataFrame:
    """The declared fields of every valid decision."""
    return _fields(t).filter("fields is not null").select(*D.KEYS, "fields.*")


#: A second run of the verified drafts: some say another thing, some say nothing valid.
_REPLAY = f"""
{_FIELDS}, vs AS (SELECT * FROM df WHERE valid AND status = 'verified'),
rp AS (SELECT answer_id, seq, question_id, split, array_to_string(CASE WHEN answer_id % 35 = 30 THEN ['output'] ELSE list_filter([CASE WHEN answer_id % 15 = 5 AND answer_status <> 'ESCALATE' THEN 'answer_status' END, CASE WHEN seq % 6 = 4 AND stage IS DISTINCT FROM 3 THEN 'stage' END], lambda x: x IS NOT NULL) END, ',') AS differences FROM vs)
"""


def _replayed(t: Tables) -> DataFrame:
    verified = t.answers.filter("status = 'verified'").select(*D.KEYS)
    stored = _fields(t).filter("fields is not null").join(verified, D.KEYS)
    f = F.col("fields").withField("answer_status", F.when(F.col("answer_id") % 15 == 5, "ESCALATE").otherwise(F.col("fields.answer_status")))
    again = stored.select(*D.KEYS, f.withField("stage", F.when(F.col("seq") % 6 == 4, 3).otherwise(F.col("fields.stage"))).alias("fields")).filter("answer_id % 35 <> 30")
    return D.replayed(stored, again)


@query(f"WITH {_BASE}, {_REPLAY} SELECT answer_id, seq, differences FROM rp")
def replay_join(t: Tables) -> DataFrame:
    """The stored decision of each verified answer against that of a second run, field by field."""
    return _replayed(t).select(*D.KEYS, F.concat_ws(",", "differences").alias("differences"))


_MINIMA = "(VALUES ('repeated_agreement', 1.0e0), ('equivalent_agreement', 0.95e0), ('negative_control_distinction', 0.95e0)) g(gate, minimum)"
_SCOPES = "(VALUES ('validation'), ('test'), ('oot')) s(scope)"


@query(f"""
WITH {_BASE}, {_REPLAY},
ag AS (SELECT split, 'repeated_agreement' AS gate, answer_id AS key, count(*) AS n, CASE WHEN count(*) >= 3 THEN count(DISTINCT recommendation) = 1 AND count(recommendation) = count(*) END AS ok FROM df WHERE valid GROUP BY split, answer_id
  UNION ALL SELECT split, 'equivalent_agreement', question_id, count(*), CASE WHEN count(*) >= 3 THEN count(DISTINCT answer_status) = 1 AND count(answer_status) = count(*) END FROM df WHERE valid GROUP BY split, question_id
  UNION ALL SELECT a.split, 'negative_control_distinction', a.answer_id, 2, bool_and(a.rec <> b.rec) FROM (SELECT split, answer_id, min(recommendation) AS rec FROM df WHERE valid GROUP BY ALL) a JOIN (SELECT answer_id, min(recommendation) AS rec FROM df WHERE valid GROUP BY ALL) b ON b.answer_id = a.answer_id + 1 GROUP BY a.split, a.answer_id),
me AS (SELECT split AS scope, gate, avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END) AS value, count(*) AS denominator FROM ag WHERE ok IS NOT NULL GROUP BY ALL),
r1 AS (SELECT g.gate, s.scope, me.value, me.denominator, minimum, CASE WHEN me.value IS NULL THEN 'not_evaluated' WHEN me.value >= minimum THEN 'passed' ELSE 'failed' END AS status FROM {_MINIMA} CROSS JOIN {_SCOPES} LEFT JOIN me USING (gate, scope)),
r2 AS (SELECT 'verified_replay' AS gate, 'verified answers' AS scope, avg(CASE WHEN differences = '' THEN 1e0 ELSE 0e0 END) AS value, count(*) AS denominator, 1e0 AS minimum FROM rp),
r3 AS (SELECT 'regression_checks' AS gate, 'development checks' AS scope, count(*)::DOUBLE AS value FROM labels WHERE quality = 1 AND toxic = 1)
SELECT gate, scope, floor(value * 1e6 + 0.5e0) / 1e6 AS value, denominator, minimum, status FROM r1 UNION ALL SELECT gate, scope, floor(value * 1e6 + 0.5e0) / 1e6, denominator, minimum, CASE WHEN denominator = 0 THEN 'not_evaluated' WHEN value >= minimum THEN 'passed' ELSE 'failed' END FROM r2
UNION ALL SELECT gate, scope, value, NULL, NULL, CASE WHEN value <= 0 THEN 'passed' ELSE 'failed' END FROM r3
""")
def consistency_gates(t: Tables) -> DataFrame:
    """Agreement of repeats, of equivalent questions and distinction of controls by split; replay; checks that newly fail.

    A check passed before where `quality` is 1, and fails now where `toxic` is.
    """
    rows = _fields(t).filter("fields is not null").select(*D.KEYS, "fields.*").join(t.drafts.select(*D.KEYS, "split", "question_id"), D.KEYS)
    repeated = E.agreement(rows.withColumn("key", F.struct("split", "answer_id")), "key", "recommendation", 3).select("key.split", F.lit("repeated_agreement").alias("gate"), "agrees")
    equivalent = E.agreement(rows.withColumn("key", F.struct("split", "question_id")), "key", "answer_status", 3).select("key.split", F.lit("equivalent_agreement").alias("gate"), "agrees")
    one = rows.groupBy("split", "answer_id").agg(F.min("recommendation").alias("rec"))
    control = rows.groupBy((F.col("answer_id") - 1).alias("answer_id")).agg(F.min("recommendation").alias("other"))
    distinct = one.join(control, "answer_id").select("split", F.lit("negative_control_distinction").alias("gate"), (F.col("rec") != F.col("other")).alias("agrees"))
    before, after = (t.labels.filter(c).select("doc_id") for c in ("quality = 1", "toxic = 0"))
    return E.consistency(repeated.union(equivalent).union(distinct), _replayed(t), before.exceptAll(after))
