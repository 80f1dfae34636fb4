"""Rationales by drivers, in known wordings."""

import random

from pyspark.sql import functions as F

from riskloom import registry as R
from riskloom.operators import scorecard as S

ISSUER = "issuer_id int, name string, sector string, revenue_musd double, revenue_growth double, ebitda_margin double, debt_to_ebitda double, interest_coverage double, current_ratio double, cyclicality int, competitive_position int, rate_environment string"


def test_figures_are_rounded_as_the_double_says(spark):
    rnd = random.Random(3)
    xs = [0.35, 0.25, 1.05, 2.5, 0.5, 1.5, -0.04, -2.25, 0.0, 12.65, 1234567.5, *(rnd.randrange(-5000, 5000) / 100 for _ in range(300)), *(rnd.uniform(-1e6, 1e6) for _ in range(100))]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", S._rounded(F.col("x"), 1).alias("one"), S._rounded(F.col("x"), 0).alias("none")).collect()
    for r in rows:
        assert (r.one, r.none) == (f"{r.x:,.1f}", f"{r.x:,.0f}"), r.x


def pattern(kind, drivers):
    return {(t := f.format(drivers))[0].upper() + t[1:] for f in R.FRAMES[kind]}


def test_sentences(spark):
    rows = [
        (1, "Weak Co", "Retail", 60.0, -0.12, 0.03, 7.0, 0.9, 0.6, 5, 1, "Rising"),
        (2, "Strong Co", "Utilities", 90_000.0, 0.2, 0.4, 0.6, 19.0, 3.0, 1, 5, "Falling"),
        (3, "Mixed Co", "Energy", 20_000.0, 0.02, 0.25, 6.5, 1.2, 1.4, 3, 4, "Stable"),
        (4, "Strong Co", "Utilities", 90_000.0, 0.2, 0.4, 0.6, 19.0, 3.0, 1, 5, "Falling"),
    ]
    rated = S.rated(spark.createDataFrame(rows, ISSUER)).select("*", S.rationale().alias("text"), S.drivers().alias("d")).collect()
    said = {r.issuer_id: r for r in rated}
    one, two, three = (said[i] for i in (1, 2, 3))
    weak = {"leverage": "elevated leverage of 7.0x debt/EBITDA", "coverage": "thin interest coverage of 0.9x", "margin": "a compressed EBITDA margin of 3%", "scale": "limited scale at $60M of revenue", "cyclicality": "high cyclicality in the retail sector", "position": "a weak competitive position"}
    assert any(one.text.startswith(p) for p in pattern("negative", " and ".join(weak[n] for n in one.d.weak)))
    assert any(n in one.text for n in R.RATE_NOTES["Rising"]) and one.text.endswith(f"supports a {one.rating} rating, in speculative grade territory.")
    strong = {"leverage": "conservative leverage of 0.6x debt/EBITDA", "coverage": "comfortable interest coverage of 19.0x", "margin": "a healthy EBITDA margin of 40%", "scale": "substantial scale at $90,000M of revenue", "cyclicality": "the stability of utilities sector cash flows"}
    assert any(two.text.startswith(p) for p in pattern("positive", " and ".join(strong[n] for n in two.d.strong)))
    assert "rate environment" not in two.text and two.text.endswith("in investment grade territory.") and said[4].text == two.text
    assert three.d.weak and three.d.strong and three.text.count(".  ") == 0 and "rates" not in three.text
