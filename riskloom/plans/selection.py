"""Queries of governed selection and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import registry as R
from riskloom.catalog import query
from riskloom.functions import columns as C
from riskloom.operators import governed as G
from riskloom.sources.views import Tables

_PLAN = R.Plan("corporate", "SAMA", "1996-01-31", "1999-12-31", "2000-06-30", ("current_ratio", "dscr", "utilisation_pct"))


@query("""
SELECT cash_flow.* FROM (SELECT current_assets, current_liabilities, data_cutoff_date, debt_service, facility_limit, jurisdiction, model_run_date, observation_date,
  obligor_id, operating_cash_flow, outstanding, portfolio FROM om
  WHERE portfolio = 'corporate' AND jurisdiction = 'SAMA' AND observation_date BETWEEN DATE '1996-01-31' AND DATE '1999-12-31' AND data_cutoff_date <= DATE '2000-06-30') cash_flow
""")
def obligor_history(t: Tables) -> DataFrame:
    return G.history(t.om, _PLAN)


_FACILITIES = "SELECT f.*, c.portfolio, c.jurisdiction FROM fm f JOIN (SELECT DISTINCT obligor_id, portfolio, jurisdiction FROM om) c ON f.obligor_id = c.obligor_id"


@query(f"""
SELECT data_cutoff_date, facility_id, facility_limit, jurisdiction, observation_date, obligor_id, outstanding, portfolio, stage FROM ({_FACILITIES}) x
WHERE portfolio = 'sme' AND jurisdiction = 'CBUAE' AND observation_date BETWEEN DATE '1996-01-31' AND DATE '1999-12-31' AND data_cutoff_date <= DATE '1999-12-31'
""")
def facility_history(t: Tables) -> DataFrame:
    plan = R.Plan("sme", "CBUAE", "1996-01-31", "1999-12-31", "1999-12-31", ("utilisation_pct", "stage"))
    found = G.history(t.sql(_FACILITIES, "fm", "om"), plan, R.FACILITY)
    return found.select("data_cutoff_date", "facility_id", "facility_limit", "jurisdiction", "observation_date", "obligor_id", "outstanding", "portfolio", "stage")


@query("""
SELECT obligor_id, observation_date, pit_pd, stage FROM om
WHERE data_cutoff_date <= DATE '1998-07-05' AND model_run_date <= DATE '1998-07-05'
""")
def point_in_time_filter(t: Tables) -> DataFrame:
    return G.point_in_time(t.om, "1998-07-05", model_output=True).select("obligor_id", "observation_date", "pit_pd", "stage")


_PLANS = """
SELECT c.c_custkey AS plan_id,
  CASE WHEN c.c_mktsegment IN ('AUTOMOBILE','MACHINERY') THEN 'corporate' WHEN c.c_mktsegment IN ('BUILDING','FURNITURE') THEN 'sme' ELSE 'retail' END AS portfolio,
  CASE c.c_custkey % 5 WHEN 0 THEN 'FCA' WHEN 1 THEN 'CBUAE' ELSE 'SAMA' END AS jurisdiction,
  CASE c.c_custkey % 7 WHEN 0 THEN 'dscr' WHEN 1 THEN 'stage' WHEN 2 THEN 'pit_pd' WHEN 3 THEN 'internal_rating' WHEN 4 THEN 'utilisation_pct' WHEN 5 THEN 'ebit_margin' ELSE 'current_ratio' END AS metric,
  CASE WHEN c.c_custkey % 3 = 0 THEN 'facility_month' ELSE 'obligor_month' END AS grain,
  CASE WHEN c.c_custkey % 4 = 0 THEN 'portfolio' ELSE 'obligor' END AS entity_level,
  CASE WHEN c.c_custkey % 11 <> 0 THEN c.c_custkey END AS obligor_id,
  CASE c.c_custkey % 6 WHEN 0 THEN 'stage' WHEN 1 THEN 'stage,internal_rating' WHEN 2 THEN 'obligor_id' WHEN 3 THEN 'stage,internal_rating,observation_date' ELSE '' END AS group_by,
  CAST(DATE '1995-01-31' + INTERVAL 1 DAY * CAST(c.c_custkey % 900 AS INT) AS DATE) AS date_from,
  CAST(DATE '1999-01-31' + INTERVAL 1 DAY * CAST(c.c_custkey % 1100 AS INT) AS DATE) AS date_to,
  DATE '2001-01-31' AS as_of
FROM customer c
"""
_SPAN = "CAST((year(date_to) - year(date_from)) * 12 + month(date_to) - month(date_from) + 1 AS BIGINT)"


def _plans(t: Tables) -> DataFrame:
    return t.sql(_PLANS, "customer").withColumn("months", C.months_between(F.col("date_from"), F.col("date_to")) + 1)


@query(f"""
WITH p AS ({_PLANS})
SELECT plan_id, {_SPAN} AS months, {_SPAN} <= 60 AS within, date_from <= date_to AND date_to <= as_of AS ordered FROM p
""")
def month_span_check(t: Tables) -> DataFrame:
    return _plans(t).select("plan_id", "months", (F.col("months") <= R.MAXIMUM_MONTHS).alias("within"), ((F.col("date_from") <= F.col("date_to")) & (F.col("date_to") <= F.col("as_of"))).alias("ordered"))


@query(f"""
WITH p AS (SELECT *, {_SPAN} AS months FROM ({_PLANS})),
q AS (SELECT plan_id, list_filter([
  CASE WHEN jurisdiction NOT IN ('SAMA', 'CBUAE') THEN 'jurisdiction_not_allowed' END,
  CASE WHEN metric = 'ebit_margin' THEN 'metric_not_allowed' END,
  CASE WHEN portfolio = 'retail' AND metric IN ('dscr', 'current_ratio') THEN 'metric_not_for_portfolio' END,
  CASE WHEN grain = 'facility_month' AND metric IN ('dscr', 'current_ratio', 'pit_pd', 'internal_rating') THEN 'metric_not_for_grain' END,
  CASE WHEN length(group_by) - length(replace(group_by, ',', '')) > 1 THEN 'too_many_dimensions' END,
  CASE WHEN group_by = 'obligor_id' THEN 'dimension_not_allowed' END,
  CASE WHEN entity_level = 'portfolio' AND metric IN ('dscr', 'current_ratio', 'utilisation_pct') THEN 'ratio_aggregation' END,
  CASE WHEN entity_level = 'portfolio' AND metric = 'internal_rating' THEN 'not_aggregatable' END,
  CASE WHEN months > 60 THEN 'window_too_long' END,
  CASE WHEN NOT (date_from <= date_to AND date_to <= as_of) THEN 'dates_out_of_order' END,
  CASE WHEN entity_level <> 'portfolio' AND obligor_id IS NULL THEN 'entity_missing' END], lambda x: x IS NOT NULL) AS r FROM p)
SELECT plan_id, len(r) = 0 AS accepted, array_to_string(r, ',') AS reasons FROM q
""")
def plan_admission(t: Tables) -> DataFrame:
    plans = _plans(t)
    judged = plans.withColumn("r", G.plan_reasons(plans))
    return judged.select("plan_id", (F.size("r") == 0).alias("accepted"), F.concat_ws(",", "r").alias("reasons"))


@query(f"""
WITH p AS ({_PLANS}) SELECT plan_id, array_to_string(list_sort(string_split(group_by, ',')), ',') AS group_by FROM p
""")
def plan_normalise(t: Tables) -> DataFrame:
    return _plans(t).select("plan_id", F.concat_ws(",", F.sort_array(F.split("group_by", ","))).alias("group_by"))


_COHORT = """
SELECT portfolio, jurisdiction, stage, count(DISTINCT obligor_id) AS cohort_size, count(*) AS months, floor(avg(outstanding) * 1e2 + 0.5e0) / 1e2 AS avg_outstanding, floor(sum(days_past_due) + 0.5e0)::BIGINT AS sum_dpd
FROM {0} GROUP BY portfolio, jurisdiction, stage HAVING count(DISTINCT obligor_id) >= 25
"""


def _shown(rows: DataFrame) -> DataFrame:
    found = G.cohort(rows, ("stage",), {"months": ("count", "stage"), "avg_outstanding": ("avg", "outstanding"), "sum_dpd": ("sum", "days_past_due")})
    return found.withColumns({"avg_outstanding": C.fixed(F.col("avg_outstanding"), 2), "sum_dpd": F.col("sum_dpd").cast("long")})


@query(_COHORT.format("(SELECT * FROM om WHERE data_cutoff_date <= DATE '1999-12-31')"))
def cohort_aggregate(t: Tables) -> DataFrame:
    return _shown(G.point_in_time(t.om, "1999-12-31", model_output=False))


@query("""
WITH r AS (SELECT portfolio, jurisdiction, stage, obligor_id, CASE WHEN outstanding IS NOT NULL AND facility_limit > 0
    THEN floor(floor(outstanding / facility_limit * 1e6 + 0.5e0) / 1e6 * 100e0 * 1e4 + 0.5e0) / 1e4 END AS u FROM om WHERE data_cutoff_date <= DATE '1999-12-31')
SELECT portfolio, jurisdiction, stage, count(DISTINCT obligor_id) AS cohort_size, floor(avg(u) * 1e4 + 0.5e0) / 1e4 AS avg_utilisation_pct
FROM r GROUP BY portfolio, jurisdiction, stage HAVING count(DISTINCT obligor_id) >= 25
""")
def cohort_of_ratios(t: Tables) -> DataFrame:
    rows = G.point_in_time(t.om, "1999-12-31", model_output=False).withColumn("u", C.CALCULATORS["utilisation_pct"]()["value"])
    return G.cohort(rows, ("stage",), {"avg_utilisation_pct": ("avg", "u")}).withColumn("avg_utilisation_pct", C.fixed(F.col("avg_utilisation_pct"), 4))


_LATEST = """
SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY obligor_id, observation_date ORDER BY load_id DESC) AS n
FROM loads WHERE load_id <= {0} AND data_cutoff_date <= DATE '{1}') WHERE n = 1
"""


@query(f"""
SELECT portfolio, jurisdiction, stage, count(DISTINCT obligor_id) AS cohort_size, floor(avg(outstanding) * 1e2 + 0.5e0) / 1e2 AS avg_outstanding
FROM ({_LATEST.format(2, "1999-12-31")}) GROUP BY portfolio, jurisdiction, stage HAVING count(DISTINCT obligor_id) >= 25
""")
def cohort_snapshot(t: Tables) -> DataFrame:
    rows = G.latest_load(G.point_in_time(t.loads.filter("load_id <= 2"), "1999-12-31", model_output=False), R.OBLIGOR.grain)
    return G.cohort(rows, ("stage",), {"avg_outstanding": ("avg", "outstanding")}).withColumn("avg_outstanding", C.fixed(F.col("avg_outstanding"), 2))


@query(f"SELECT obligor_id, observation_date, stage, outstanding, load_id FROM ({_LATEST.format(2, '1998-12-31')})")
def snapshot_latest(t: Tables) -> DataFrame:
    rows = G.point_in_time(t.loads.filter("load_id <= 2"), "1998-12-31", model_output=False)
    return G.latest_load(rows, R.OBLIGOR.grain).select("obligor_id", "observation_date", "stage", "outstanding", "load_id")


_CONTEXTS = "SELECT 1 AS context_id, 1 AS watermark, DATE '1999-12-31' AS as_of UNION ALL SELECT 2, 2, DATE '1999-12-31' UNION ALL SELECT 3, 2, DATE '1998-03-31'"


@query(f"""
WITH c AS ({_CONTEXTS}), s AS (
  SELECT context_id, obligor_id, observation_date, stage, load_id, row_number() OVER (PARTITION BY context_id, obligor_id, observation_date ORDER BY load_id DESC) AS n
  FROM loads l JOIN c ON l.load_id <= c.watermark AND l.data_cutoff_date <= c.as_of)
SELECT context_id, obligor_id, observation_date, stage, load_id FROM s WHERE n = 1
""")
def asof_latest_version(t: Tables) -> DataFrame:
    found = G.asof_versions(t.loads, F.broadcast(t.spark.sql(_CONTEXTS)), R.OBLIGOR.grain)  # three contexts
    return found.select("context_id", "obligor_id", "observation_date", "stage", "load_id")


@query("""
SELECT obligor_id, observation_date, outstanding, n > 24 AS truncated FROM (
  SELECT obligor_id, observation_date, outstanding, row_number() OVER (PARTITION BY obligor_id ORDER BY observation_date) AS k, count(*) OVER (PARTITION BY obligor_id) AS n FROM om) WHERE k <= 24
""")
def limit_with_overflow(t: Tables) -> DataFrame:
    by = Window.partitionBy("obligor_id")
    rows = t.om.withColumns({"k": F.row_number().over(by.orderBy("observation_date")), "n": F.count(F.lit(1)).over(by)})
    return rows.filter("k <= 24").select("obligor_id", "observation_date", "outstanding", (F.col("n") > 24).alias("truncated"))


@query("SELECT obligor_id, observation_date, outstanding FROM om ORDER BY outstanding DESC, obligor_id, observation_date LIMIT 120")
def head_limit(t: Tables) -> DataFrame:
    return t.om.select("obligor_id", "observation_date", "outstanding").orderBy(F.col("outstanding").desc(), "obligor_id", "observation_date").limit(R.MAXIMUM_ROWS)
