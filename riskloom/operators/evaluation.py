"""Evaluation: scores with group minima, gates with confidence bounds, calibration, bootstrap, paired comparison."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import registry as R
from riskloom.functions import columns as C
from riskloom.operators import resampling


def unpivot(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return rows.unpivot(keys, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def score_cases(observed: DataFrame, scopes: list[str]) -> DataFrame:
    """(scope, slice, metric, score, n): the least value within a group, then the mean over groups.

    `observed`: group_id, the scope columns, metric, value; nulls aren't eligible. One explode gives all scopes.
    """
    scope = F.explode(F.array(F.struct(F.lit("overall").alias("scope"), F.lit("all").alias("slice")), *(F.struct(F.lit(s).alias("scope"), F.col(s).alias("slice")) for s in scopes)))
    rows = observed.filter("value is not null").withColumn("x", scope).select("x.*", "metric", "group_id", "value")
    groups = rows.groupBy("scope", "slice", "metric", "group_id").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("cases"))
    return groups.groupBy("scope", "slice", "metric").agg(F.avg("value").alias("score"), F.sum("cases").alias("n"))


def hoeffding_lower(mean: Column, n: Column, confidence: float = 0.95) -> Column:
    return F.greatest(F.lit(0.0), mean - F.sqrt(F.lit(math.log(2 / (1 - confidence)) / 2) / n))


def gate_status(score: Column, n: Column, threshold: Column, binary: Column, least: int = R.MINIMUM_ELIGIBLE) -> Column:
    """A gate without evidence isn't passed: nothing, too little, a breach, or a bound below the threshold."""
    lower = F.when(binary, C.wilson_lower(score * n, n)).otherwise(hoeffding_lower(score, n))
    return F.when(n == 0, "not_applicable").when(n < least, "insufficient").when(score < threshold, "failed").when(lower < threshold, "insufficient").otherwise("passed")


def calibration(rows: DataFrame) -> DataFrame:
    """(bin, n, mean_confidence, accuracy) in five half-open bins of 0.2, the last one closed."""
    bin_ = F.least(F.floor(F.col("confidence") * 5.0), F.lit(4)).cast("int")
    return rows.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.sum((F.col("confidence") - F.col("correct")) * (F.col("confidence") - F.col("correct"))).alias("squares"))


def calibration_summary(bins: DataFrame) -> DataFrame:
    """One row: denominator, Brier score, expected calibration error, status; no observations aren't evaluated."""
    n = F.sum("n")
    return bins.agg(
        F.coalesce(n, F.lit(0)).alias("denominator"), (F.sum("squares") / n).alias("brier_score"), (F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))) / n).alias("calibration_error"),
        F.when(n >= R.REPORTABLE_SLICE, "reportable").when(n > 0, "small_sample").otherwise("not_evaluated").alias("status"),
    )


#: Ranges of the values from 0 to 1 whose sums are carried on.
RANGES = 1000


def select_threshold(rows: DataFrame) -> DataFrame:
    """The threshold with the greatest (least of recall and rejection, rejection, recall, threshold).

    `rows`: cosine, relevant. Candidates are 0, 1 and the clamped cosines, to six digits, so at most a million; counts per
    value, then running sums within ranges of values, which start from what the ranges before add up to.
    """
    t = C.fixed(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cosine"))), 6)
    cells = rows.groupBy(t.alias("t")).agg(F.count_if("relevant").alias("pos"), F.count_if(~F.col("relevant")).alias("neg"))
    ends = rows.sparkSession.createDataFrame([(0.0, 0, 0), (1.0, 0, 0)], "t double, pos long, neg long")
    cells = cells.union(ends).groupBy("t").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cells = cells.withColumn("range", F.floor(F.col("t") * RANGES))
    sums = cells.groupBy("range").agg(F.sum("pos").alias("range_pos"), F.sum("neg").alias("range_neg"))
    before, every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()  # RANGES + 1 rows
    carried = sums.select("range", *(F.coalesce(F.sum(f"range_{c}").over(before), F.lit(0)).alias(f"carried_{c}") for c in ("pos", "neg")), *(F.sum(f"range_{c}").over(every).alias(f"all_{c}") for c in ("pos", "neg")))
    up = Window.partitionBy("range").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)  # at most a million / RANGES values
    cells = cells.join(F.broadcast(carried), "range").withColumns({f"below_{c}": F.coalesce(F.sum(c).over(up), F.lit(0)) + F.col(f"carried_{c}") for c in ("pos", "neg")})
    recall = F.coalesce(F.try_divide((F.col("all_pos") - F.col("below_pos")).cast("double"), F.col("all_pos")), F.lit(0.0))
    reject = F.coalesce(F.try_divide(F.col("below_neg").cast("double"), F.col("all_neg")), F.lit(0.0))
    best = F.max(F.struct(F.least(recall, reject).alias("balance"), reject.alias("rejection"), recall.alias("recall"), F.col("t").alias("threshold")))
    return cells.agg(best.alias("b")).select("b.*")


def _poisson_steps() -> list[float]:
    """Where a uniform number passes from one count of a Poisson law of mean one to the next."""
    steps, total, term = [], 0.0, math.exp(-1)
    for k in range(1, 13):
        total += term
        steps.append(total)
        term /= k
    return steps


POISSON_STEPS = _poisson_steps()
#: Digests that one task of a bootstrap makes, about.
DRAWS = 20_000_000


def bootstrap(rows: DataFrame, keys: list[str], item: str, value: str, samples: int = R.BOOTSTRAPS) -> DataFrame:
    """Elements 25 and 975 of a thousand resampled means, per key.

    A resample takes each row as often as a Poisson law of mean one says, by inversion of a digest of sample, keys and item.
    Rows are dealt to tasks of about `DRAWS` digests, each makes them many at once and hands on the sums of its rows.
    """
    tail = F.concat_ws("|", F.lit(""), *keys, F.col(item).cast("string"))
    listed = rows.select(F.struct(*keys).alias("k"), F.to_json(F.struct(*keys)).alias("name"), F.col(value).cast("double").alias("v"), tail.alias("tail"))
    dealt = listed.repartition(max(1, math.ceil(rows.count() * samples / DRAWS)))
    heads = [str(x).encode() for x in range(1, samples + 1)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = batch["name"].dictionary_encode().indices.to_numpy()
            tails, v = [x.encode() for x in batch["tail"].to_pylist()], batch["v"].fill_null(0.0).to_numpy()
            order = np.argsort(name, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(name[order])) + 1) if len(order) else []:
                w, wv = np.zeros(samples), np.zeros(samples)
                for some in (own[i : i + 1024] for i in range(0, len(own), 1024)):
                    times = resampling.weights(heads, [tails[i] for i in some], POISSON_STEPS).astype(np.float64)
                    w += times.sum(1)
                    wv += times @ v[some] if np.isfinite(v[some]).all() else np.where(times > 0, times * v[some], 0.0).sum(1)
                drawn = np.flatnonzero(w > 0)
                key = batch["k"].take(pa.array(np.full(len(drawn), own[0])))
                yield pa.RecordBatch.from_arrays([key, pa.array(drawn + 1, pa.int32()), pa.array(w[drawn]), pa.array(wv[drawn])], names=["k", "sample", "w", "wv"])

    drawn = dealt.mapInArrow(sums, f"k {listed.schema['k'].dataType.simpleString()}, sample int, w double, wv double").select("k.*", "sample", "w", "wv")
    means = drawn.groupBy(*keys, "sample").agg((F.sum("wv") / F.sum("w")).alias("m"))
    listed = means.groupBy(*keys).agg(F.array_sort(F.collect_list("m")).alias("m"))  # a list of samples
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    at = lambda k: F.element_at("m", F.greatest(F.lit(1), F.floor(F.size("m") * k / samples).cast("int")))
    return listed.join(n, keys).select(*keys, "n", at(25 * samples // 1000).alias("low"), at(975 * samples // 1000).alias("high"))


def paired_deltas(left: DataFrame, right: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Mean change, wins, losses and ties over the cases that both runs have."""
    joined = left.withColumnRenamed("value", "a").join(right.withColumnRenamed("value", "b"), keys)
    d = F.col("b") - F.col("a")
    return joined.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_delta"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"))


def both_sides(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Metric rows of two runs; one-sided metrics stay, the denominator is the lesser one."""
    a, b = left.toDF(*keys, "base", "base_n"), right.toDF(*keys, "candidate", "candidate_n")
    return a.join(b, keys, "full_outer").withColumn("denominator", F.least("base_n", "candidate_n"))


def champion(slices: DataFrame, target: str, tolerance: float = R.REGRESSION_TOLERANCE) -> DataFrame:
    """Promote if no slice drops by more than the tolerance (a missing one does) and the target metric improves."""
    drop = F.coalesce(F.col("base") - F.col("candidate") > tolerance, F.lit(True))
    better = (F.col("metric") == target) & (F.col("candidate") > F.col("base"))
    found = slices.filter("base is not null").agg(F.count_if(drop).alias("regressions"), F.coalesce(F.bool_or(better), F.lit(False)).alias("improved"))
    return found.withColumn("promote", (F.col("regressions") == 0) & F.col("improved"))


def reviewed_label(reviews: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """The label two distinct reviewers agree on, else an independent adjudicator's; null if neither."""
    agreed = reviews.groupBy("item").agg(F.collect_set("reviewer").alias("who"), F.collect_set("label").alias("labels"))
    joined = agreed.join(adjudicated.toDF("item", "judge", "verdict"), "item", "left")
    independent = F.col("judge").isNotNull() & ~F.array_contains("who", F.col("judge"))
    label = F.when((F.size("who") >= 2) & (F.size("labels") == 1), F.element_at("labels", 1)).when(independent, F.col("verdict"))
    return joined.select("item", label.alias("label"))


def agreement(rows: DataFrame, key: str, value: str, least: int) -> DataFrame:
    """Whether all members of a key share one projection, none missing; keys with too few members have no verdict."""
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(value).alias("kinds"), F.count_if(F.col(value).isNull()).alias("missing"))
    return found.select(key, "n", F.when(F.col("n") >= least, (F.col("kinds") == 1) & (F.col("missing") == 0)).alias("agrees"))


def qualified(rows: DataFrame, calibration_content: DataFrame, supported: float = 0.90, unsupported: float = 0.95) -> DataFrame:
    """(label, n, low, problems, qualified): the lower bound of agreement with each reviewed label, and what is wrong with the
    observations as a whole: groups that aren't independent, repeated content, overlap with calibration, a missing label.

    `rows`: item, group_id, content, split, label (reviewed; null without agreement), hit; `calibration_content`: content.
    """
    none = F.array().cast("array<string>")
    count = lambda df, name: df.agg((F.count(F.lit(1)) > 0).alias(name))
    found = [
        count(rows.filter("split is distinct from 'qualification' or group_id is null"), "not_held_out"),
        count(rows.filter("group_id is not null").groupBy("group_id").count().filter("count > 1"), "dependent_groups"),
        count(rows.groupBy("content").count().filter("count > 1"), "duplicate_content"),
        count(rows.join(calibration_content.select("content").distinct(), "content", "left_semi"), "calibration_overlap"),
        count(rows.filter("label is null"), "unresolved_review"),
    ]
    names = ["not_held_out", "dependent_groups", "duplicate_content", "calibration_overlap", "unresolved_review"]
    problems = found[0]
    for f in found[1:]:
        problems = problems.join(F.broadcast(f))  # a row each
    problems = problems.select(C.named(*((n, F.col(n)) for n in names)).alias("problems"))
    sides = rows.sparkSession.createDataFrame([("supported", supported), ("unsupported", unsupported)], "label string, least double")
    per = rows.filter("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))
    joined = sides.join(per, "label", "left").na.fill(0, ["n", "hits"]).join(F.broadcast(problems))
    low = C.wilson_lower(F.col("hits"), F.col("n"))
    return joined.select("label", "n", low.alias("low"), F.coalesce("problems", none).alias("problems"), ((low >= F.col("least")) & (F.size("problems") == 0)).alias("qualified"))


def consistency(agreements: DataFrame, replays: DataFrame, newly_failing: DataFrame) -> DataFrame:
    """(gate, scope, value, denominator, minimum, status) of a candidate. `agreements`: split, gate, agrees (null: no
    verdict); `replays`: differences; `newly_failing`: a row for each check that passed before and fails now."""
    spark = agreements.sparkSession
    wanted = spark.createDataFrame([(g, s, m) for g, m in R.AGREEMENT_MINIMA.items() for s in ("validation", "test", "oot")], "gate string, scope string, minimum double")
    share = lambda c: F.avg(c.cast("double"))
    found = agreements.filter("agrees is not null").groupBy("gate", F.col("split").alias("scope")).agg(share(F.col("agrees")).alias("value"), F.count(F.lit(1)).alias("denominator"))
    by_split = wanted.join(found, ["gate", "scope"], "left")
    replay = replays.agg(F.lit("verified_replay").alias("gate"), F.lit("verified answers").alias("scope"), share(F.size("differences") == 0).alias("value"), F.count(F.lit(1)).alias("denominator")).withColumn("minimum", F.lit(R.REPLAY_MINIMUM))
    status = F.when(F.col("value").isNull(), "not_evaluated").when(F.col("value") >= F.col("minimum"), "passed").otherwise("failed")
    columns = ["gate", "scope", "value", "denominator", "minimum"]
    gates = by_split.select(columns).union(replay.select(columns)).withColumn("status", status).withColumn("value", C.fixed(F.col("value"), 6))
    lost = newly_failing.agg(F.count(F.lit(1)).cast("double").alias("value"))
    none = lambda kind: F.lit(None).cast(kind)
    return gates.union(lost.select(F.lit("regression_checks"), F.lit("development checks"), "value", none("long"), none("double"), F.when(F.col("value") <= R.MOST_NEWLY_FAILING, "passed").otherwise("failed")))
