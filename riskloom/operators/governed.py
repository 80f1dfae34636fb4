"""Governed selection: plans become DataFrames over the append-only tables; nothing outside the registry is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import registry as R


def point_in_time(rows: DataFrame, as_of: str, model_output: bool) -> DataFrame:
    """What was knowable at `as_of`; model outputs also need their run date to lie before it."""
    day = F.lit(as_of).cast("date")
    rows = rows.filter(F.col("data_cutoff_date") <= day)
    return rows.filter(F.col("model_run_date") <= day) if model_output else rows


def latest_load(rows: DataFrame, grain: tuple[str, ...], *more: str) -> DataFrame:
    """The row of the latest load of each grain. Filters go before: the order is part of the meaning."""
    newest = Window.partitionBy(*grain, *more).orderBy(F.col("load_id").desc())
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def _selected(plan: R.Plan, table: R.Table) -> list[str]:
    unknown = [m for m in plan.metrics if m not in R.METRICS or plan.portfolio not in R.METRICS[m].portfolios]
    if unknown:
        raise ValueError(f"metrics not allowed: {unknown}")
    needed = {c for m in plan.metrics for c in R.METRICS[m].depends}
    return sorted({*table.grain, "data_cutoff_date", "model_run_date", "portfolio", "jurisdiction", *needed})


def months(plan: R.Plan) -> int:
    y1, m1 = map(int, plan.date_from.split("-")[:2])
    y2, m2 = map(int, plan.date_to.split("-")[:2])
    return (y2 - y1) * 12 + m2 - m1 + 1


def history(rows: DataFrame, plan: R.Plan, table: R.Table = R.OBLIGOR) -> DataFrame:
    """Rows of a portfolio and jurisdiction (and one obligor or facility, if the plan names it) in a date window."""
    if months(plan) > R.MAXIMUM_MONTHS or not plan.date_from <= plan.date_to <= plan.as_of:
        raise ValueError("a plan needs date_from <= date_to <= as_of and at most 60 months")
    columns = _selected(plan, table)
    output = any(table.columns[c].model_output for c in columns if c in table.columns)
    rows = rows.filter((F.col("portfolio") == plan.portfolio) & (F.col("jurisdiction") == plan.jurisdiction))
    rows = rows.filter(F.col("observation_date").between(F.lit(plan.date_from).cast("date"), F.lit(plan.date_to).cast("date")))
    for name in ("obligor_id", "facility_id"):
        if getattr(plan, name) is not None:
            rows = rows.filter(F.col(name) == getattr(plan, name))
    rows = point_in_time(rows, plan.as_of, output)
    if plan.watermark is not None:
        rows = latest_load(rows.filter(F.col("load_id") <= plan.watermark), table.grain)
    return rows.select(*[c for c in columns if c in rows.columns])


def cohort(rows: DataFrame, by: tuple[str, ...], aggregations: dict[str, tuple[str, str]], minimum: int = R.MINIMUM_COHORT) -> DataFrame:
    """Aggregates of portfolio, jurisdiction and at most two dimensions; cohorts under the floor aren't shown.

    `aggregations`: name -> (function, column). The count of obligors is exact: the floor is a privacy control.
    """
    if len(by) > R.MAXIMUM_GROUP_BY or set(by) - set(R.GROUP_BY):
        raise ValueError(f"not allowed to group by {by}")
    for how, column in aggregations.values():
        if how not in R.AGGREGATIONS or column in R.METRICS and R.METRICS[column].formula or column in R.OBLIGOR.columns and R.OBLIGOR.columns[column].kind not in R.AGGREGATABLE:
            raise ValueError(f"not allowed: {how}({column})")
    some = [getattr(F, how)(column).alias(name) for name, (how, column) in aggregations.items()]
    grouped = rows.groupBy("portfolio", "jurisdiction", *by).agg(F.count_distinct("obligor_id").alias("cohort_size"), *some)
    return grouped.filter(F.col("cohort_size") >= minimum)


def asof_versions(loads: DataFrame, contexts: DataFrame, grain: tuple[str, ...]) -> DataFrame:
    """For every context (context_id, watermark, as_of): the latest version of each grain that it may see.

    Contexts are few (a reader's watermarks); loads meet them by load_id up to the watermark.
    """
    seen = loads.join(contexts, (F.col("load_id") <= F.col("watermark")) & (F.col("data_cutoff_date") <= F.col("as_of")))
    return latest_load(seen, grain, "context_id")


def plan_reasons(plans: DataFrame) -> Column:
    """Why a row of a plans table isn't admitted; empty if it is. Metric checks come from the registry."""
    by = F.split("group_by", ",")
    listed = F.col("group_by") != ""
    known = F.create_map(*(x for n, m in R.METRICS.items() for x in (F.lit(n), F.array(*map(F.lit, m.portfolios)))))
    ratio = F.col("metric").isin([n for n, m in R.METRICS.items() if m.formula])
    grain = F.create_map(*(x for n, m in R.METRICS.items() for x in (F.lit(n), F.array(*map(F.lit, m.grains)))))
    cohort = F.col("entity_level") == "portfolio"
    cases = [
        ("jurisdiction_not_allowed", ~F.col("jurisdiction").isin(*R.JURISDICTIONS)),
        ("metric_not_allowed", ~F.col("metric").isin(*R.METRICS)),
        ("metric_not_for_portfolio", F.col("metric").isin(*R.METRICS) & ~F.array_contains(F.try_element_at(known, "metric"), F.col("portfolio"))),
        ("metric_not_for_grain", F.col("metric").isin(*R.METRICS) & ~F.array_contains(F.try_element_at(grain, "metric"), F.col("grain"))),
        ("too_many_dimensions", listed & (F.size(by) > R.MAXIMUM_GROUP_BY)),
        ("dimension_not_allowed", listed & (F.size(F.array_except(by, F.array(*map(F.lit, R.GROUP_BY)))) > 0)),
        ("ratio_aggregation", cohort & ratio),
        ("not_aggregatable", cohort & F.col("metric").isin("internal_rating")),
        ("window_too_long", F.col("months") > R.MAXIMUM_MONTHS),
        ("dates_out_of_order", ~((F.col("date_from") <= F.col("date_to")) & (F.col("date_to") <= F.col("as_of")))),
        ("entity_missing", ~cohort & F.col("obligor_id").isNull()),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in cases)))
