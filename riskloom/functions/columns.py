"""Scalar builders: each returns a Column; none runs Python on rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import registry as R


def fixed(x: Column, digits: int) -> Column:
    """Half-up rounding by floor, which gives the same double in every engine. Values so large that a double holds no such
    digit stay as they are (a floor is a long here)."""
    scale = float(10**digits)
    return F.when(F.abs(x) * scale < 2.0**53, F.floor(x * scale + 0.5).cast("double") / scale).otherwise(x)


def months_between(first: Column, last: Column) -> Column:
    """Calendar months from the month of `first` to the month of `last`."""
    return ((F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first)).cast("long")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def metric(top: Column, bottom: Column, unit: str, formula: str, sources: list[str], digits: int = 6, scale: float | None = None) -> Column:
    """A metric value: missing if an input is null, invalid if not finite or not above a positive denominator."""
    missing = top.isNull() | bottom.isNull()
    good = ~missing & finite(top) & finite(bottom) & (bottom > 0)
    value = fixed(top / bottom, digits)
    if scale is not None:
        value = fixed(value * scale, 4)
    return F.struct(
        F.when(good, value).alias("value"),
        F.lit(unit).alias("unit"),
        F.lit(formula).alias("formula_id"),
        F.array(*map(F.lit, sources)).alias("source_columns"),
        missing.alias("missing_data_flag"),
        F.when(missing, "warning").when(good, "valid").otherwise("invalid").alias("validation_status"),
    )


def _c(name: str) -> Column:
    return F.col(name)


#: Formulas by metric: each builds the metric value from governed columns.
CALCULATORS: dict[str, Callable[[], Column]] = {
    "current_ratio": lambda: metric(_c("current_assets"), _c("current_liabilities"), "x", "ratio.current_ratio.v2", ["current_assets", "current_liabilities"]),
    "net_debt_to_ebitda": lambda: metric(_c("total_debt") - _c("cash"), _c("ebitda"), "x", "ratio.net_debt_to_ebitda.v2", ["total_debt", "cash", "ebitda"]),
    "dscr": lambda: metric(_c("operating_cash_flow"), _c("debt_service"), "x", "ratio.dscr.v2", ["operating_cash_flow", "debt_service"]),
    "interest_coverage": lambda: metric(_c("ebitda"), _c("interest_expense"), "x", "ratio.interest_coverage.v2", ["ebitda", "interest_expense"]),
    "utilisation_pct": lambda: metric(_c("outstanding"), _c("facility_limit"), "pct", "ratio.utilisation.v2", ["outstanding", "facility_limit"], 6, 100.0),
}
if unknown := {m.formula for m in R.METRICS.values() if m.formula} - {f"ratio.{'utilisation' if n == 'utilisation_pct' else n}.v2" for n in CALCULATORS}:
    raise ValueError(f"metrics with an unknown formula: {sorted(unknown)}")

#: Comparisons by name, for policy rules.
COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "eq": lambda a, b: F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * 1e-9,
}


def pp_change(now: Column, before: Column) -> Column:
    return fixed((now - before) * 100.0, 4)


def relative_change(now: Column, before: Column) -> Column:
    return F.when((before > 0) & finite(before) & finite(now), fixed((now - before) / before * 100.0, 4))


def interpolate(x: Column, anchors: tuple[tuple[float, float], ...]) -> Column:
    """Linear between anchors, clamped at both ends."""
    out = F.when(x <= float(anchors[0][0]), F.lit(float(anchors[0][1])))
    for (x0, y0), (x1, y1) in zip(anchors[:-1], anchors[1:], strict=True):
        out = out.when(x <= float(x1), F.lit(float(y0)) + (x - F.lit(float(x0))) * ((y1 - y0) / (x1 - x0)))
    return F.when(x.isNotNull(), out.otherwise(F.lit(float(anchors[-1][1]))))


def wilson_lower(successes: Column, n: Column, z: float = R.WILSON_Z) -> Column:
    """Lower bound of a share; 0 where there is nothing."""
    p = successes.cast("double") / n.cast("double")
    half = z * F.sqrt(p * (1.0 - p) / n + (z * z) / (4.0 * n * n))
    return F.when(n > 0, (p + (z * z) / (2.0 * n) - half) / (1.0 + (z * z) / n)).otherwise(0.0)


def split_bucket(group: Column) -> Column:
    return F.pmod(F.conv(F.substring(F.sha2(group, 256), 1, 8), 16, 10).cast("long"), F.lit(100))


def stable_split(group: Column) -> Column:
    bucket = split_bucket(group)
    return F.when(bucket < 70, "train").when(bucket < 85, "valid").otherwise("test")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def named(*cases: tuple[str, Column]) -> Column:
    """The names of the cases that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in cases)))


def number_text(x: Column) -> Column:
    """A double as its shortest text: plain from 1e-4 up to 1e16, with an exponent of two digits beyond."""
    text = x.cast("string")
    plain = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    digits = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
    sign = F.when(power < 0, "-").otherwise("+")
    apart = F.concat(digits, F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
    apart = F.when(F.abs(power) > 99, F.concat(digits, F.lit("e"), sign, F.abs(power).cast("string"))).otherwise(apart)
    return F.when(~finite(x), F.lower(text)).when(x == 0, text).when(F.abs(x).between(1e-4, 9999999999999998.0), plain).otherwise(apart)
