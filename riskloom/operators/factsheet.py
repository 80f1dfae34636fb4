"""Factsheets for all obligors in one job: first and last month, ratios, trends, events, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import columns as C

POSITION = ("outstanding", "facility_limit", "days_past_due", "internal_rating", "stage")
MODEL_OUTPUTS = ("ttc_pd", "pit_pd", "lgd", "ead", "ecl")
STALE_MONTHS = 3


def windows(rows: DataFrame) -> DataFrame:
    """One row an obligor: its first and last month as structs, and what its months add up to. One shuffle.

    Months without a date come first; of months with one date, the smaller by all other columns does, so that reruns agree.
    """
    everything = F.struct(*rows.columns)
    rest = [c for c in rows.columns if c != "observation_date"]
    order = F.struct(F.coalesce("observation_date", F.lit("0001-01-01").cast("date")), F.struct(*rest))
    stage_on = lambda pick: pick(F.when(F.col("stage").isNotNull(), F.col("stage")), F.when(F.col("stage").isNotNull(), F.col("observation_date")))
    return rows.groupBy("obligor_id").agg(
        F.count(F.lit(1)).alias("observation_months"),
        F.min_by(everything, order).alias("first"),
        F.max_by(everything, order).alias("last"),
        F.count_if(F.col("days_past_due") >= 30).alias("dpd_30"),
        F.max("stage").alias("worst"),
        F.count_if(F.col("stage") == 2).alias("stage_2"),
        F.coalesce(F.bool_or("restructuring_flag"), F.lit(False)).alias("restructured"),
        F.coalesce(F.bool_or("watchlist_flag"), F.lit(False)).alias("watched"),
        stage_on(F.min_by).alias("stage_0"),
        stage_on(F.max_by).alias("stage_1"),
        F.count("stage").alias("stages"),
        F.count("observation_date").alias("dated"),
        F.count_distinct("observation_date").alias("dates"),
        F.max("observation_date").alias("latest"),
    )


def of(side: str, name: str) -> Column:
    """A governed metric computed on one side's month."""
    fields = {"utilisation_pct": ("outstanding", "facility_limit")}[name]
    return C.metric(F.col(f"{side}.{fields[0]}"), F.col(f"{side}.{fields[1]}"), "pct", "ratio.utilisation.v2", list(fields), 6, 100.0)


def trends(w: DataFrame) -> DataFrame:
    """Probabilities change in percentage points, amounts in per cent."""
    out = [C.pp_change(F.col(f"last.{c}"), F.col(f"first.{c}")).alias(f"{c}_change_pp") for c in ("ttc_pd", "pit_pd", "lgd")]
    out += [C.relative_change(F.col(f"last.{c}"), F.col(f"first.{c}")).alias(f"{c}_change_pct") for c in ("revenue", "ebitda", "outstanding")]
    change = of("last", "utilisation_pct")["value"] - of("first", "utilisation_pct")["value"]
    return w.select("obligor_id", *out, C.fixed(change, 4).alias("utilisation_change_pp"))


def events() -> Column:
    """Labels in fixed order."""
    return F.array_compact(
        F.array(
            F.when(F.col("dpd_30") > 0, F.concat(F.col("dpd_30").cast("string"), F.lit("_months_at_30dpd_or_worse"))),
            F.when(F.col("worst") == 3, "stage_3_observed_in_window").when(F.col("stage_2") > 0, "stage_2_observed_in_window"),
            F.when(F.col("restructured"), "restructuring_flagged"),
            F.when(F.col("watched"), "watchlist_flagged"),
            F.when((F.col("stages") >= 2) & (F.col("stage_1") > F.col("stage_0")), F.concat(F.lit("stage_migration_"), F.col("stage_0").cast("string"), F.lit("_to_"), F.col("stage_1").cast("string"))),
        )
    )


def quality(as_of: str) -> Column:
    stale = C.months_between(F.col("latest"), F.lit(as_of).cast("date"))
    return F.array_compact(
        F.array(
            F.when(F.col("dated") < F.col("observation_months"), "unparseable_observation_date"),
            F.when(F.col("dates") < F.col("dated"), "duplicate_observation_dates"),
            F.when(stale > STALE_MONTHS, F.concat(F.lit("latest_observation_"), stale.cast("string"), F.lit("_months_old"))),
        )
    )


def metric_columns(rows: DataFrame) -> DataFrame:
    """The governed ratios of every row, a struct each."""
    return rows.withColumns({name: build() for name, build in C.CALCULATORS.items()})


def missing(columns: list[str]) -> Column:
    """Sorted names of the last month's empty columns."""
    return F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"last.{c}").isNull(), F.lit(c)) for c in columns))))


def factsheets(rows: DataFrame, as_of: str) -> DataFrame:
    """The nested document of every obligor."""
    w = windows(metric_columns(rows))
    names = list(C.CALCULATORS)
    invalid = F.array_compact(F.array(*(F.when(F.col(f"last.{n}.validation_status") == "invalid", F.lit(f"invalid_metric:{n}")) for n in names)))
    lacking = F.array_compact(F.array(*(F.when(F.col(f"last.{n}.missing_data_flag"), F.lit(n)) for n in names)))
    plain = [c for c in rows.columns]
    body = w.select(
        "obligor_id", F.col("last.portfolio").alias("portfolio"), F.col("last.jurisdiction").alias("jurisdiction"), F.lit(as_of).cast("date").alias("as_of_date"), "observation_months",
        F.struct(*(F.col(f"last.{c}").alias(c) for c in POSITION)).alias("current_position"),
        F.struct(*(F.col(f"last.{n}").alias(n) for n in names)).alias("calculated_metrics"),
        events().alias("events"), F.struct(*(F.col(f"last.{c}").alias(c) for c in MODEL_OUTPUTS)).alias("model_outputs"),
        F.array_sort(F.array_distinct(F.concat(missing(plain), lacking))).alias("missing_information"), F.concat(quality(as_of), invalid).alias("data_quality_flags"),
    )
    moved = trends(w)
    body = body.join(moved.select("obligor_id", F.struct(*moved.columns[1:]).alias("trends")), "obligor_id")
    key = F.sha2(F.concat_ws("|", F.col("obligor_id").cast("string"), F.col("portfolio"), F.lit(as_of)), 256)
    return body.withColumn("case_id", F.concat_ws("-", F.lit("CASE"), F.col("obligor_id").cast("string"), F.lit(as_of), F.substring(key, 1, 12)))
