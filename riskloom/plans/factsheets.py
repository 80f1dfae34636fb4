"""Queries of ratios and factsheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.catalog import query
from riskloom.functions import columns as C
from riskloom.operators import factsheet as S
from riskloom.sources.views import Tables

AS_OF = "2001-12-31"


def _ratio_sql(top: str, bottom: str, digits: str = "floor({0} * 1e6 + 0.5e0) / 1e6") -> str:
    return f"CASE WHEN {bottom} > 0 AND isfinite({top}) AND isfinite({bottom}) THEN {digits.format(f'(({top}) / {bottom})')} END"


def _status_sql(top: str, bottom: str) -> str:
    return f"CASE WHEN ({top}) IS NULL OR {bottom} IS NULL THEN 'warning' WHEN {bottom} > 0 AND isfinite({top}) AND isfinite({bottom}) THEN 'valid' ELSE 'invalid' END"


_UTIL = "floor(floor({0} * 1e6 + 0.5e0) / 1e6 * 100e0 * 1e4 + 0.5e0) / 1e4"
_PAIRS = {"current_ratio": ("current_assets", "current_liabilities"), "net_debt_to_ebitda": ("(total_debt - cash)", "ebitda"), "dscr": ("operating_cash_flow", "debt_service"), "interest_coverage": ("ebitda", "interest_expense"), "utilisation_pct": ("outstanding", "facility_limit")}
_RATIOS = ", ".join(f"{_ratio_sql(a, b, _UTIL) if n == 'utilisation_pct' else _ratio_sql(a, b)} AS {n}, {_status_sql(a, b)} AS {n}_status" for n, (a, b) in _PAIRS.items())


@query(f"SELECT obligor_id, observation_date, {_RATIOS} FROM om")
def governed_ratios(t: Tables) -> DataFrame:
    rows = S.metric_columns(t.om)
    return rows.select("obligor_id", "observation_date", *(x for n in C.CALCULATORS for x in (F.col(f"{n}.value").alias(n), F.col(f"{n}.validation_status").alias(f"{n}_status"))))


_FIRST_LAST = """
SELECT obligor_id, count(*) AS observation_months, min(observation_date) AS first_date, max(observation_date) AS last_date,
  arg_min(outstanding, observation_date) AS first_outstanding, arg_max(outstanding, observation_date) AS last_outstanding, arg_max(internal_rating, observation_date) AS internal_rating,
  arg_max(stage, observation_date) AS stage, arg_max(pit_pd, observation_date) AS pit_pd FROM om GROUP BY obligor_id
"""


@query(_FIRST_LAST)
def factsheet_first_last(t: Tables) -> DataFrame:
    w = S.windows(t.om)
    return w.select("obligor_id", "observation_months", F.col("first.observation_date").alias("first_date"), F.col("last.observation_date").alias("last_date"), F.col("first.outstanding").alias("first_outstanding"), F.col("last.outstanding").alias("last_outstanding"), "last.internal_rating", "last.stage", "last.pit_pd")


_F = lambda x, n: f"floor({x} * 1e{n} + 0.5e0) / 1e{n}"
_PP = ", ".join(f"{_F(f'((l.{c} - f.{c}) * 100e0)', 4)} AS {c}_change_pp" for c in ("ttc_pd", "pit_pd", "lgd"))
_PCT = ", ".join(f"CASE WHEN f.{c} > 0 THEN {_F(f'((l.{c} - f.{c}) / f.{c} * 100e0)', 4)} END AS {c}_change_pct" for c in ("revenue", "ebitda", "outstanding"))


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY obligor_id ORDER BY observation_date) AS a, row_number() OVER (PARTITION BY obligor_id ORDER BY observation_date DESC) AS z FROM om),
f AS (SELECT * FROM r WHERE a = 1), l AS (SELECT * FROM r WHERE z = 1)
SELECT l.obligor_id, {_PP}, {_PCT}, {_F(f"({_ratio_sql('l.outstanding', 'l.facility_limit', _UTIL)} - {_ratio_sql('f.outstanding', 'f.facility_limit', _UTIL)})", 4)} AS utilisation_change_pp
FROM l JOIN f ON l.obligor_id = f.obligor_id
""")
def factsheet_trends(t: Tables) -> DataFrame:
    return S.trends(S.windows(t.om))


@query("""
WITH g AS (SELECT obligor_id, count(*) FILTER (days_past_due >= 30) AS d, max(stage) AS w, count(*) FILTER (stage = 2) AS s2, bool_or(restructuring_flag) AS r, bool_or(watchlist_flag) AS o,
  arg_min(stage, observation_date) AS s0, arg_max(stage, observation_date) AS s1, count(stage) AS n FROM om GROUP BY obligor_id)
SELECT obligor_id, array_to_string(list_filter([CASE WHEN d > 0 THEN d || '_months_at_30dpd_or_worse' END, CASE WHEN w = 3 THEN 'stage_3_observed_in_window' WHEN s2 > 0 THEN 'stage_2_observed_in_window' END,
  CASE WHEN r THEN 'restructuring_flagged' END, CASE WHEN o THEN 'watchlist_flagged' END, CASE WHEN n >= 2 AND s1 > s0 THEN 'stage_migration_' || s0 || '_to_' || s1 END], lambda x: x IS NOT NULL), ',') AS events FROM g
""")
def factsheet_events(t: Tables) -> DataFrame:
    return S.windows(t.om).select("obligor_id", F.concat_ws(",", S.events()).alias("events"))


@query(f"""
WITH g AS (SELECT obligor_id, count(*) AS n, count(observation_date) AS d, count(DISTINCT observation_date) AS u, max(observation_date) AS m FROM om GROUP BY obligor_id),
s AS (SELECT *, (2001 - year(m)) * 12 + 12 - month(m) AS old FROM g)
SELECT obligor_id, array_to_string(list_filter([CASE WHEN d < n THEN 'unparseable_observation_date' END, CASE WHEN u < d THEN 'duplicate_observation_dates' END,
  CASE WHEN old > 3 THEN 'latest_observation_' || old || '_months_old' END], lambda x: x IS NOT NULL), ',') AS flags FROM s -- as of {AS_OF}
""")
def factsheet_quality(t: Tables) -> DataFrame:
    return S.windows(t.om).select("obligor_id", F.concat_ws(",", S.quality(AS_OF)).alias("flags"))


_NULLABLE = ["current_assets", "current_liabilities", "debt_service", "ebitda", "interest_expense", "operating_cash_flow", "revenue", "total_debt"]


@query(f"""
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY obligor_id ORDER BY observation_date DESC) AS z FROM om) WHERE z = 1)
SELECT obligor_id, array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _NULLABLE)}], lambda x: x IS NOT NULL)), ',') AS missing FROM l
""")
def factsheet_missing(t: Tables) -> DataFrame:
    return S.windows(t.om).select("obligor_id", F.concat_ws(",", S.missing(_NULLABLE)).alias("missing"))


@query()
def factsheet(t: Tables) -> DataFrame:
    return S.factsheets(t.om, AS_OF)


@query("""
WITH r AS (SELECT portfolio, lag(stage) OVER (PARTITION BY obligor_id ORDER BY observation_date) AS before, stage FROM om)
SELECT portfolio, before AS from_stage, stage AS to_stage, count(*) AS n FROM r WHERE before IS NOT NULL GROUP BY ALL
""")
def stage_transitions(t: Tables) -> DataFrame:
    before = F.lag("stage").over(Window.partitionBy("obligor_id").orderBy("observation_date"))
    moved = t.om.select("portfolio", before.alias("from_stage"), F.col("stage").alias("to_stage")).filter("from_stage is not null")
    return moved.groupBy("portfolio", "from_stage", "to_stage").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH r AS (SELECT obligor_id, observation_date, pit_pd, outstanding, lag(pit_pd) OVER w AS p, lag(outstanding) OVER w AS o FROM om WINDOW w AS (PARTITION BY obligor_id ORDER BY observation_date))
SELECT obligor_id, observation_date, {_F("((pit_pd - p) * 100e0)", 4)} AS pd_change_pp, CASE WHEN o > 0 THEN {_F("((outstanding - o) / o * 100e0)", 4)} END AS outstanding_change_pct FROM r
""")
def pp_change(t: Tables) -> DataFrame:
    w = Window.partitionBy("obligor_id").orderBy("observation_date")
    return t.om.select("obligor_id", "observation_date", C.pp_change(F.col("pit_pd"), F.lag("pit_pd").over(w)).alias("pd_change_pp"), C.relative_change(F.col("outstanding"), F.lag("outstanding").over(w)).alias("outstanding_change_pct"))


@query("SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) AS month_end FROM orders")
def month_end(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.last_day(F.col("o_orderdate").cast("date")).alias("month_end"))


@query("""
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY obligor_id ORDER BY observation_date DESC) AS z FROM om) WHERE z = 1),
f AS (SELECT obligor_id, 0 AS kind, 'days_past_due' AS name, CAST(days_past_due AS DOUBLE) AS value FROM l UNION ALL SELECT obligor_id, 0, 'facility_limit', facility_limit FROM l
  UNION ALL SELECT obligor_id, 0, 'outstanding', outstanding FROM l UNION ALL SELECT obligor_id, 0, 'stage', CAST(stage AS DOUBLE) FROM l
  UNION ALL SELECT obligor_id, 1, 'utilisation_pct', CASE WHEN facility_limit > 0 THEN floor(floor(outstanding / facility_limit * 1e6 + 0.5e0) / 1e6 * 100e0 * 1e4 + 0.5e0) / 1e4 END FROM l)
SELECT obligor_id, CAST(n AS INTEGER) AS n, name, value FROM (SELECT *, row_number() OVER (PARTITION BY obligor_id ORDER BY kind, name) AS n FROM f WHERE value IS NOT NULL) WHERE n <= 60
""")
def cap_facts(t: Tables) -> DataFrame:
    """At most 60 facts an obligor: its latest position first, then its metrics, by name."""
    last = S.windows(S.metric_columns(t.om))
    fact = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), value.cast("double").alias("value"))
    position = [fact(0, c, F.col(f"last.{c}")) for c in ("days_past_due", "facility_limit", "outstanding", "stage")]
    facts = last.withColumn("f", F.explode(F.array(*position, fact(1, "utilisation_pct", F.col("last.utilisation_pct.value"))))).select("obligor_id", "f.*").filter("value is not null")
    n = F.row_number().over(Window.partitionBy("obligor_id").orderBy("kind", "name"))
    return facts.withColumn("n", n).filter("n <= 60").select("obligor_id", "n", "name", "value")


@query(f"""
WITH r AS (SELECT obligor_id, observation_date, revenue, lag(revenue) OVER (PARTITION BY obligor_id ORDER BY observation_date) AS p FROM om)
SELECT obligor_id, observation_date, CASE WHEN p > 0 THEN {_F("((revenue - p) / p * 100e0)", 4)} END AS revenue_change_pct FROM r
""")
def relative_change(t: Tables) -> DataFrame:
    before = F.lag("revenue").over(Window.partitionBy("obligor_id").orderBy("observation_date"))
    return t.om.select("obligor_id", "observation_date", C.relative_change(F.col("revenue"), before).alias("revenue_change_pct"))
