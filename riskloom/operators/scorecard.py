"""The rating scorecard: factors, composite, rating, drivers, texts, and ordinal metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import registry as R
from riskloom.functions import columns as C

FACTORS = ("leverage", "coverage", "margin", "liquidity", "scale", "growth", "cyclicality", "position")


def factors(issuers: DataFrame) -> DataFrame:
    """The eight factor scores, 0 to 100."""
    tolerance = F.element_at(F.create_map(*(x for k, v in R.TOLERANCE.items() for x in (F.lit(k), F.lit(v)))), F.col("sector"))
    inputs = {
        "leverage": F.col("debt_to_ebitda") / tolerance, "coverage": F.col("interest_coverage"), "margin": F.col("ebitda_margin"), "liquidity": F.col("current_ratio"),
        "scale": F.log10(F.greatest(F.col("revenue_musd"), F.lit(1.0))), "growth": F.col("revenue_growth"), "cyclicality": F.col("cyclicality").cast("double"), "position": F.col("competitive_position").cast("double"),
    }
    return issuers.withColumns({f"f_{n}": C.interpolate(x, R.ANCHORS[n]) for n, x in inputs.items()})


def rate_adjustment() -> Column:
    rate = F.col("rate_environment")
    return F.when(rate == "Rising", -(1.0 + 0.6 * F.greatest(F.lit(0.0), F.col("debt_to_ebitda") - 3.0))).when(rate == "Falling", 0.8).otherwise(0.0)


def composite() -> Column:
    total = reduce(lambda a, b: a + b, (F.col(f"f_{n}") * w for n, w in R.WEIGHTS.items()))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total + rate_adjustment()))


def rating_of(score: Column) -> Column:
    out = F.when(score >= float(R.RATING_FLOORS[0][1]), R.RATING_FLOORS[0][0])
    for name, floor in R.RATING_FLOORS[1:]:
        out = out.when(score >= float(floor), name)
    return out.otherwise(R.RATINGS[-1])


def rated(issuers: DataFrame) -> DataFrame:
    rows = factors(issuers).withColumn("composite", composite())
    return rows.withColumn("rating", rating_of(F.col("composite")))


def rating_index(rating: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, R.RATINGS)), rating) - 1


def investment_grade(rating: Column) -> Column:
    return rating_index(rating) <= R.RATINGS.index("BBB")


def parse_rating(text: Column) -> Column:
    """A labelled rating in any case, else the first bare one; null if there is none."""
    names = "|".join(sorted(R.RATINGS, key=lambda x: (-len(x), x)))
    labelled = F.regexp_extract(text, rf"(?i)rating\s*[:\-]?\s*({names})\b", 1)
    bare = F.regexp_extract(text, rf"\b({names})\b", 1)
    return F.upper(F.coalesce(F.nullif(labelled, F.lit("")), F.nullif(bare, F.lit(""))))


def drivers() -> Column:
    """Factors by weight times distance from 50: the first two weak ones, the first two strong ones, one residual."""
    each = F.array(*(F.struct((-(F.abs(F.col(f"f_{n}") - 50.0) * w)).alias("order"), F.lit(n).alias("name"), F.col(f"f_{n}").alias("score")) for n, w in R.WEIGHTS.items()))
    ranked = F.array_sort(each)
    weak = F.slice(F.filter(ranked, lambda x: x["score"] < R.WEAK_BELOW), 1, 2)
    strong = F.slice(F.filter(ranked, lambda x: x["score"] > R.STRONG_ABOVE), 1, 2)
    used = F.transform(F.concat(weak, strong), lambda x: x["name"])
    residual = F.slice(F.filter(ranked, lambda x: (x["score"] < R.RESIDUAL_BELOW) & ~F.array_contains(used, x["name"])), 1, 1)
    names = lambda a: F.transform(a, lambda x: x["name"])
    return F.struct(names(weak).alias("weak"), names(strong).alias("strong"), names(residual).alias("residual"))


def profile() -> Column:
    """The issuer as a question of thirteen lines."""
    # The labels and the wording of the question.
    cyc, pos = ("Very low", "Low", "Moderate", "High", "Very high"), ("Weak", "Below average", "Average", "Strong", "Dominant")
    label = lambda names, c: F.concat(F.element_at(F.array(*map(F.lit, names)), F.col(c).cast("int")), F.lit(" ("), F.col(c).cast("string"), F.lit("/5)"))
    number = lambda x, d: F.format_string(f"%.{d}f", x)
    return F.concat_ws(
        "\n", F.lit("Assess the credit rating for the following issuer."), F.lit(""), F.concat(F.lit("Company: "), "name"), F.concat(F.lit("Sector: "), "sector"),
        F.concat(F.lit("Revenue: $"), F.format_number("revenue_musd", 0), F.lit("M")), F.concat(F.lit("Revenue growth: "), number(F.col("revenue_growth") * 100.0, 1), F.lit("%")),
        F.concat(F.lit("EBITDA margin: "), number(F.col("ebitda_margin") * 100.0, 1), F.lit("%")), F.concat(F.lit("Total debt / EBITDA: "), number(F.col("debt_to_ebitda"), 2), F.lit("x")),
        F.concat(F.lit("EBIT / interest expense: "), number(F.col("interest_coverage"), 2), F.lit("x")), F.concat(F.lit("Current ratio: "), number(F.col("current_ratio"), 2)),
        F.concat(F.lit("Industry cyclicality: "), label(cyc, "cyclicality")), F.concat(F.lit("Competitive position: "), label(pos, "competitive_position")), F.concat(F.lit("Rate environment: "), "rate_environment"),
    )


def _rounded(x: Column, digits: int) -> Column:
    """A number with so many decimals, thousands separated, rounded by the exact value of the double: 0.35, which lies a little below,
    gives 0.3; true halves go to the even neighbour. Good up to 1e15."""
    twice = 2.0 * 10**digits
    size = F.abs(x)
    product = size * twice  # with what rounding took from it, by splitting the double in two
    high = size * 134217729.0 - (size * 134217729.0 - size)
    lost = (high * twice - product) + (size - high) * twice
    half = (F.floor(product) == product) & (F.floor(product) % 2 == 1)
    below = F.floor(product / 2.0)
    up = F.when(half, (lost > 0) | ((lost == 0) & (below % 2 == 1))).otherwise(product / 2.0 - below >= 0.5)
    units = (below + F.when(up, 1).otherwise(0)).cast("decimal(20,0)")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.format_number(units * F.lit(f"{10.0**-digits:.{digits}f}").cast(f"decimal(10,{digits})"), digits))


def _filled(text: str, *parts: Column) -> Column:
    """A text with columns in the place of its {}."""
    first, *rest = text.split("{}")
    return F.concat(F.lit(first), *(x for part, after in zip(parts, rest, strict=True) for x in (part, F.lit(after))))


def picked(name: str, n: int) -> Column:
    """A choice of n by a hash of the issuer's name, for one kind of sentence: which wording is taken has no meaning."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{name}:"), "name")), 1, 8), 16, 10).cast("long") % n


def _phrase(factor: Column, strong: bool) -> Column:
    plain = lambda x, d: F.replace(_rounded(x, d), F.lit(","), F.lit(""))
    sector = F.lower("sector")
    figures = {
        "leverage": plain(F.col("debt_to_ebitda"), 1), "coverage": plain(F.col("interest_coverage"), 1), "margin": plain(F.col("ebitda_margin") * 100.0, 0), "liquidity": plain(F.col("current_ratio"), 1),
        "scale": _rounded(F.col("revenue_musd"), 0), "growth": plain(F.col("revenue_growth") * 100.0, 1), "cyclicality": sector,
    }
    out = F.lit(None).cast("string")
    for name, texts in R.DRIVER_PHRASES.items():
        text = texts[strong]
        out = F.when(factor == name, _filled(text, figures[name]) if "{}" in text else F.lit(text)).otherwise(out)
    return out


def _sentence(kind: str, names: Column, strong: bool) -> Column:
    """One sentence about up to two drivers; null if there is none."""
    phrases = F.array_join(F.transform(names, lambda f: _phrase(f, strong)), " and ")
    frames = R.FRAMES[kind]
    text = F.element_at(F.array(*(_filled(f, phrases) for f in frames)), (picked(kind, len(frames)) + 1).cast("int"))
    return F.when(F.size(names) > 0, F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30)))


def rationale() -> Column:
    """Two to four sentences: what weighs on the rating and what offsets it, or what supports it and what remains, a word on rates
    where debt is high, and what it comes to. Where several wordings are in use, a hash of the name picks one."""
    d = drivers()
    weak, strong = F.size(d["weak"]) > 0, F.size(d["strong"]) > 0
    body = (
        F.when(weak, F.array(_sentence("negative", d["weak"], False), _sentence("offset", d["strong"], True)))
        .when(strong, F.array(_sentence("positive", d["strong"], True), _sentence("residual", d["residual"], False)))
        .otherwise(F.array(_filled(R.BALANCED, F.lower("sector"))))
    )
    note = F.lit(None).cast("string")
    for rates, texts in R.RATE_NOTES.items():
        chosen = F.element_at(F.array(*map(F.lit, texts)), (picked("rates", len(texts)) + 1).cast("int"))
        note = F.when((F.col("rate_environment") == rates) & (F.col("debt_to_ebitda") > R.RATE_NOTE_LEVERAGE), chosen).otherwise(note)
    grade = F.when(investment_grade(F.col("rating")), "investment grade").otherwise("speculative grade")
    return F.array_join(F.array_compact(F.concat(body, F.array(note, _filled(R.CLOSING, F.col("rating"), grade)))), " ")


def dialogues(rated: DataFrame) -> DataFrame:
    """issuer_id and messages: the prompt, the profile as a question, and the rating with its rationale, as JSON."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    answer = F.concat(F.lit("Rating: "), "rating", F.lit("\n\nRationale: "), rationale())
    return rated.select("issuer_id", F.to_json(F.array(turn("system", F.lit(R.SYSTEM_PROMPT)), turn("user", profile()), turn("assistant", answer))).alias("messages"))


def pair_metrics(pairs: DataFrame) -> DataFrame:
    """Ordinal metrics of (truth_idx, pred_idx): a missing prediction counts against accuracy, not in the distances."""
    classes = len(R.RATINGS)
    d = F.abs(F.col("truth_idx") - F.col("pred_idx"))
    good = R.RATINGS.index("BBB")
    per_class = class_metrics(pairs)
    macro = per_class.filter("support > 0").agg(F.avg("f1").alias("macro_f1"))
    # distances are 0 to 6: their counts give the upper middle one without sorting rows
    of_d = [F.count_if(d == k).alias(f"d{k}") for k in range(classes)]
    one = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred_idx").isNull()).alias("unparseable"), F.count_if(d == 0).alias("exact"), F.sum(d).alias("far"), F.count_if(d <= 1).alias("near"),
        F.count_if((F.col("truth_idx") <= good) == (F.col("pred_idx") <= good)).alias("grade"), *of_d,
    )
    scored, half = F.col("n") - F.col("unparseable"), F.floor((F.col("n") - F.col("unparseable")) / 2)
    upto, median = F.lit(0), F.lit(None).cast("int")
    for k in reversed(range(classes)):
        upto = reduce(lambda a, b: a + b, (F.col(f"d{i}") for i in range(k + 1)))
        median = F.when(half < upto, F.lit(k)).otherwise(median)
    one = one.select(
        "n", "unparseable", (F.col("exact") / F.col("n")).alias("exact_accuracy"), F.try_divide(F.col("far"), scored).alias("mean_notch_error"), median.cast("long").alias("median_notch_error"),
        (F.col("near") / F.col("n")).alias("within_one_notch"), (F.col("grade") / F.col("n")).alias("ig_hy_accuracy"),
    )
    return one.join(F.broadcast(macro))  # one row each


def class_metrics(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every rating; 0 where undefined."""
    cells = pairs.groupBy("truth_idx", "pred_idx").agg(F.count(F.lit(1)).alias("c"))
    both = F.explode(F.array(F.struct(F.col("truth_idx").alias("idx"), F.lit(True).alias("truth")), F.struct(F.col("pred_idx").alias("idx"), F.lit(False).alias("truth"))))
    rows = cells.withColumn("x", both).select("x.idx", "x.truth", "c", (F.col("truth_idx") == F.col("pred_idx")).alias("hit")).filter("idx is not null")
    some = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0)).cast("double")
    sums = rows.groupBy("idx").agg(some(F.col("truth") & F.col("hit")).alias("tp"), some(~F.col("truth")).alias("predicted"), some(F.col("truth") & F.col("hit").isNotNull()).alias("scored"), some(F.col("truth")).cast("long").alias("support"))
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("scored")), F.lit(0.0))
    out = sums.select("idx", p.alias("precision"), r.alias("recall"), "support")
    return out.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def hash_rank(rows: DataFrame, key: str, stratum: str) -> DataFrame:
    """k and n: a row's place in the hash order of its stratum, and the stratum's size.

    Strata are few and large, so a window over one would put a share of all rows in one task. Rows are ranked within
    4,096 parts of the hash instead, and each part is shifted by the sizes of the parts before it.
    """
    rows = rows.withColumn("_h", F.sha2(F.col(key).cast("string"), 256)).withColumn("_p", F.substring("_h", 1, 3))
    parts = rows.groupBy(stratum, "_p").agg(F.count(F.lit(1)).alias("_c"))
    of = Window.partitionBy(stratum)  # at most 4,096 rows a stratum
    before = F.coalesce(F.sum("_c").over(of.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(stratum, "_p", before.alias("_before"), F.sum("_c").over(of).alias("n"))
    place = F.row_number().over(Window.partitionBy(stratum, "_p").orderBy("_h"))
    return rows.withColumn("_k", place).join(parts, [stratum, "_p"]).withColumn("k", F.col("_k") + F.col("_before")).drop("_h", "_p", "_k", "_before")


def stratified_split(rows: DataFrame, key: str, stratum: str) -> DataFrame:
    """80/10/10 inside each stratum, in hash order; small strata are all for training."""
    share = F.when(F.col("n") >= 10, F.greatest(F.lit(1), F.bround(F.col("n") * 0.1, 0).cast("int"))).otherwise(0)
    split = F.when(F.col("k") <= share, "valid").when(F.col("k") <= share * 2, "test").otherwise("train")
    return hash_rank(rows, key, stratum).withColumn("split", split).drop("k", "n")


def balance_quota(rows: DataFrame, key: str, label: str, total: int, classes: int) -> DataFrame:
    """At most total / classes rows of each label, in hash order."""
    order = Window.partitionBy(label).orderBy(F.sha2(F.col(key).cast("string"), 256))
    return rows.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= total // classes).drop("k")
