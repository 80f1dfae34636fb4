"""Governed selection: golden rows, restatements, floors, refused plans, and the physical plan."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom import registry as R
from riskloom.operators import factsheet, governed
from riskloom.sources.views import Tables

D = dt.date


def test_restatement_is_seen_only_from_its_watermark_and_cutoff(spark):
    """The load filter and the point in time go before the latest load is taken."""
    rows = spark.createDataFrame([(1, D(2024, 6, 30), D(2024, 7, 5), 1, 1), (1, D(2024, 6, 30), D(2024, 10, 1), 3, 2)], "obligor_id long, observation_date date, data_cutoff_date date, stage int, load_id int")
    contexts = spark.createDataFrame([(1, 1, D(2024, 12, 31)), (2, 2, D(2024, 12, 31)), (3, 2, D(2024, 8, 1)), (4, 2, D(2024, 7, 1))], "context_id int, watermark int, as_of date")
    got = {r.context_id: r.stage for r in governed.asof_versions(rows, contexts, R.OBLIGOR.grain).collect()}
    assert got == {1: 1, 2: 3, 3: 1}


def test_a_later_load_leaves_earlier_snapshots_alone(spark, data_dir):
    t = Tables(spark, data_dir)
    before = governed.latest_load(t.loads.filter("load_id <= 1"), R.OBLIGOR.grain).select("obligor_id", "observation_date", "stage", "outstanding")
    assert before.exceptAll(t.om.select("obligor_id", "observation_date", "stage", "outstanding")).count() == 0


def test_no_small_cohort_is_shown(spark, data_dir):
    found = governed.cohort(Tables(spark, data_dir).om, ("stage", "internal_rating"), {"n": ("count", "stage")})
    assert found.filter(F.col("cohort_size") < R.MINIMUM_COHORT).count() == 0


@pytest.mark.parametrize("by,aggregations", [(("obligor_id",), {}), (("stage", "internal_rating", "observation_date"), {}), ((), {"x": ("max", "outstanding")}), ((), {"x": ("avg", "current_ratio")}), ((), {"x": ("avg", "internal_rating")})])
def test_refused_cohorts(spark, data_dir, by, aggregations):
    with pytest.raises(ValueError):
        governed.cohort(Tables(spark, data_dir).om, by, aggregations)


def test_refused_plans(spark, data_dir):
    om = Tables(spark, data_dir).om
    for plan in (R.Plan("retail", "SAMA", "1996-01-01", "1996-12-31", "2000-01-01", ("dscr",)), R.Plan("sme", "SAMA", "1990-01-01", "1999-12-31", "2000-01-01"), R.Plan("sme", "SAMA", "1999-01-01", "1998-12-31", "2000-01-01")):
        with pytest.raises(ValueError):
            governed.history(om, plan)


def obligor_rows(spark):
    base = {"obligor_id": 8, "portfolio": "corporate", "jurisdiction": "SAMA", "current_liabilities": 100.0, "facility_limit": 100.0, "internal_rating": "5", "ttc_pd": 0.02, "lgd": 0.4, "ead": 50.0, "ecl": 1.0, "watchlist_flag": False, "restructuring_flag": False}
    months = [
        base | {"observation_date": D(2025, 4, 30), "current_assets": 120.0, "outstanding": 50.0, "pit_pd": 0.02, "days_past_due": 0, "stage": 1},
        base | {"observation_date": D(2025, 5, 31), "current_assets": 100.0, "outstanding": 70.0, "pit_pd": 0.03, "days_past_due": 35, "stage": 2},
        base | {"observation_date": D(2025, 6, 30), "current_assets": 90.0, "outstanding": 80.0, "pit_pd": 0.05, "days_past_due": 40, "stage": 2},
    ]
    more = {c: None for c in ("revenue", "ebitda", "total_debt", "cash", "debt_service", "operating_cash_flow", "interest_expense")}
    schema = ", ".join(f"{k} {('date' if k.endswith('date') else 'long' if k == 'obligor_id' else 'int' if k in ('stage', 'days_past_due') else 'boolean' if k.endswith('flag') else 'string' if k in ('portfolio', 'jurisdiction', 'internal_rating') else 'double')}" for k in [*months[0], *more])
    return spark.createDataFrame([tuple((m | more).values()) for m in months], schema)


def test_golden_factsheet(spark):
    w = factsheet.windows(factsheet.metric_columns(obligor_rows(spark)))
    moved = factsheet.trends(w).first()
    assert (moved.pit_pd_change_pp, moved.utilisation_change_pp) == (3.0, 30.0) and moved.revenue_change_pct is None
    row = w.select(factsheet.events().alias("e"), F.col("last.current_ratio.value").alias("r"), F.col("last.utilisation_pct.value").alias("u"), F.col("last.dscr.validation_status").alias("s")).first()
    assert row.e == ["2_months_at_30dpd_or_worse", "stage_2_observed_in_window", "stage_migration_1_to_2"]
    assert (row.r, row.u, row.s) == (0.9, 80.0, "warning")
    assert factsheet.factsheets(obligor_rows(spark), "2025-12-31").first().data_quality_flags == ["latest_observation_6_months_old"]


def test_filters_reach_the_scan(spark, tmp_path, data_dir):
    path = str(tmp_path / "loads")
    Tables(spark, data_dir).loads.write.partitionBy("load_id").parquet(path)
    rows = governed.point_in_time(spark.read.parquet(path).filter("load_id <= 1"), "1999-12-31", model_output=False).select("obligor_id", "stage")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(load_id" in plan and "LessThanOrEqual(data_cutoff_date" in plan and "outstanding" not in plan
