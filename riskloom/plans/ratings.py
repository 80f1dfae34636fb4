"""Queries of the rating scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import registry as R
from riskloom.catalog import CATALOG, query
from riskloom.functions import columns as C
from riskloom.operators import scorecard as S
from riskloom.sources.views import Tables


def _interp(x: str, name: str) -> str:
    a = R.ANCHORS[name]
    steps = "".join(f" WHEN {x} <= {x1!r}::DOUBLE THEN {float(y0)!r}::DOUBLE + ({x} - {x0!r}::DOUBLE) * {(y1 - y0) / (x1 - x0)!r}::DOUBLE" for (x0, y0), (x1, y1) in zip(a[:-1], a[1:], strict=True))
    return f"CASE WHEN {x} <= {a[0][0]!r}::DOUBLE THEN {float(a[0][1])!r}::DOUBLE{steps} ELSE {float(a[-1][1])!r}::DOUBLE END"


_TOL = "CASE sector " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in R.TOLERANCE.items()) + " END"
_IN = {"leverage": f"(debt_to_ebitda / {_TOL})", "coverage": "interest_coverage", "margin": "ebitda_margin", "liquidity": "current_ratio", "scale": "log10(greatest(revenue_musd, 1e0))", "growth": "revenue_growth", "cyclicality": "cyclicality::DOUBLE", "position": "competitive_position::DOUBLE"}
_FACTORS = "SELECT *, " + ", ".join(f"{_interp(x, n)} AS f_{n}" for n, x in _IN.items()) + " FROM issuers"
_ADJ = "CASE rate_environment WHEN 'Rising' THEN -(1e0 + 0.6e0 * greatest(0e0, debt_to_ebitda - 3e0)) WHEN 'Falling' THEN 0.8e0 ELSE 0e0 END"
_COMPOSITE = "greatest(0e0, least(100e0, " + " + ".join(f"f_{n} * {w!r}::DOUBLE" for n, w in R.WEIGHTS.items()) + f" + {_ADJ}))"
_RATING = "CASE " + " ".join(f"WHEN composite >= {f} THEN '{n}'" for n, f in R.RATING_FLOORS) + " ELSE 'CCC' END"
_RATED = f"SELECT *, {_RATING} AS rating FROM (SELECT *, {_COMPOSITE} AS composite FROM ({_FACTORS}) a) b"
_R4 = "floor({0} * 1e4 + 0.5e0) / 1e4"


@query(f"SELECT issuer_id, {_R4.format(_interp('debt_to_ebitda', 'leverage'))} AS score FROM issuers")
def piecewise_interpolate(t: Tables) -> DataFrame:
    return t.issuers.select("issuer_id", C.fixed(C.interpolate(F.col("debt_to_ebitda"), R.ANCHORS["leverage"]), 4).alias("score"))


@query(f"SELECT issuer_id, {', '.join(f'{_R4.format(f"f_{n}")} AS {n}' for n in S.FACTORS)} FROM ({_FACTORS}) a")
def scorecard_factors(t: Tables) -> DataFrame:
    return S.factors(t.issuers).select("issuer_id", *(C.fixed(F.col(f"f_{n}"), 4).alias(n) for n in S.FACTORS))


@query(f"SELECT issuer_id, {_R4.format(_ADJ)} AS adjustment FROM issuers")
def rate_adjustment(t: Tables) -> DataFrame:
    return t.issuers.select("issuer_id", C.fixed(S.rate_adjustment(), 4).alias("adjustment"))


@query(f"SELECT issuer_id, {_R4.format('composite')} AS composite, rating FROM ({_RATED}) r")
def scorecard_rating(t: Tables) -> DataFrame:
    return S.rated(t.issuers).select("issuer_id", C.fixed(F.col("composite"), 4).alias("composite"), "rating")


@query(f"SELECT issuer_id, rating IN ('AAA', 'AA', 'A', 'BBB') AS investment_grade FROM ({_RATED}) r")
def investment_grade(t: Tables) -> DataFrame:
    return S.rated(t.issuers).select("issuer_id", S.investment_grade(F.col("rating")).alias("investment_grade"))


@query(f"SELECT rating, count(*) AS n FROM ({_RATED}) r GROUP BY rating")
def rating_distribution(t: Tables) -> DataFrame:
    return S.rated(t.issuers).groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


_ANSWERS = "SELECT issuer_id, CASE issuer_id % 5 WHEN 0 THEN 'Rating: ' || lower(rating) || ' because of leverage' WHEN 1 THEN 'I would say ' || rating || ', maybe B' WHEN 2 THEN 'no view' WHEN 3 THEN 'RATING - ' || rating ELSE 'rating:' || rating || 'x and AA' END AS text FROM ({0}) r"
_ALT = "AAA|BBB|CCC|AA|BB|A|B"


@query(rf"""
SELECT issuer_id, upper(coalesce(nullif(regexp_extract(text, '(?i)rating\s*[:\-]?\s*({_ALT})\b', 1), ''), nullif(regexp_extract(text, '\b({_ALT})\b', 1), ''))) AS parsed FROM ({_ANSWERS.format(_RATED)}) a
""")
def parse_rating(t: Tables) -> DataFrame:
    rows = S.rated(t.issuers)
    said = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    r, k = F.col("rating"), F.col("issuer_id") % 5
    text = F.when(k == 0, said("Rating: ", F.lower(r), " because of leverage")).when(k == 1, said("I would say ", r, ", maybe B")).when(k == 2, F.lit("no view")).when(k == 3, said("RATING - ", r)).otherwise(said("rating:", r, "x and AA"))
    return rows.withColumn("text", text).select("issuer_id", S.parse_rating(F.col("text")).alias("parsed"))


@query(r"""
SELECT issuer_id, 'Assess the credit rating for the following issuer.' || chr(10) || chr(10) || 'Company: ' || name || chr(10) || 'Sector: ' || sector || chr(10)
  || 'Revenue: $' || format('{:,}', revenue_musd::BIGINT) || 'M' || chr(10) || 'Revenue growth: ' || printf('%.1f', revenue_growth * 100e0) || '%' || chr(10)
  || 'EBITDA margin: ' || printf('%.1f', ebitda_margin * 100e0) || '%' || chr(10) || 'Total debt / EBITDA: ' || printf('%.2f', debt_to_ebitda) || 'x' || chr(10)
  || 'EBIT / interest expense: ' || printf('%.2f', interest_coverage) || 'x' || chr(10) || 'Current ratio: ' || printf('%.2f', current_ratio) || chr(10)
  || 'Industry cyclicality: ' || ['Very low', 'Low', 'Moderate', 'High', 'Very high'][cyclicality] || ' (' || cyclicality || '/5)' || chr(10)
  || 'Competitive position: ' || ['Weak', 'Below average', 'Average', 'Strong', 'Dominant'][competitive_position] || ' (' || competitive_position || '/5)' || chr(10)
  || 'Rate environment: ' || rate_environment AS profile FROM issuers
""")
def render_profile(t: Tables) -> DataFrame:
    return t.issuers.select("issuer_id", S.profile().alias("profile"))


_LONG = " UNION ALL ".join(f"SELECT issuer_id, '{n}' AS name, f_{n} AS score, -(abs(f_{n} - 50e0) * {w!r}::DOUBLE) AS k FROM ({_FACTORS}) z" for n, w in R.WEIGHTS.items())


@query(f"""
WITH x AS ({_LONG}),
weak AS (SELECT *, row_number() OVER (PARTITION BY issuer_id ORDER BY k, name) AS n FROM x WHERE score < 45),
strong AS (SELECT *, row_number() OVER (PARTITION BY issuer_id ORDER BY k, name) AS n FROM x WHERE score > 62),
used AS (SELECT issuer_id, name FROM weak WHERE n <= 2 UNION ALL SELECT issuer_id, name FROM strong WHERE n <= 2),
residual AS (SELECT x.*, row_number() OVER (PARTITION BY x.issuer_id ORDER BY k, x.name) AS n FROM x ANTI JOIN used u ON x.issuer_id = u.issuer_id AND x.name = u.name WHERE score < 50)
SELECT i.issuer_id, coalesce((SELECT string_agg(name, ',' ORDER BY n) FROM weak w WHERE w.issuer_id = i.issuer_id AND n <= 2), '') AS weak,
  coalesce((SELECT string_agg(name, ',' ORDER BY n) FROM strong w WHERE w.issuer_id = i.issuer_id AND n <= 2), '') AS strong,
  coalesce((SELECT string_agg(name, ',' ORDER BY n) FROM residual w WHERE w.issuer_id = i.issuer_id AND n <= 1), '') AS residual FROM issuers i
""")
def top_drivers(t: Tables) -> DataFrame:
    d = S.factors(t.issuers).withColumn("d", S.drivers())
    return d.select("issuer_id", *(F.concat_ws(",", f"d.{c}").alias(c) for c in ("weak", "strong", "residual")))


def _sql_text(text: str, *parts: str) -> str:
    first, *rest = (f"'{x}'" for x in text.replace("'", "''").split("{}"))
    return " || ".join([first, *(x for pair in zip(parts, rest, strict=True) for x in pair)])


_FIGURES = {
    "leverage": "printf('%.1f', debt_to_ebitda)", "coverage": "printf('%.1f', interest_coverage)", "margin": "printf('%.0f', ebitda_margin * 100e0)", "liquidity": "printf('%.1f', current_ratio)",
    "scale": "format('{:,}', CAST(printf('%.0f', revenue_musd) AS BIGINT))", "growth": "printf('%.1f', revenue_growth * 100e0)", "cyclicality": "lower(sector)", "position": None,
}
_SAID = {strong: "CASE x.name " + " ".join(f"WHEN '{n}' THEN {_sql_text(t[strong], *([_FIGURES[n]] if _FIGURES[n] else []))}" for n, t in R.DRIVER_PHRASES.items()) + " END" for strong in (False, True)}
_PICK = "CAST(concat('0x', substr(md5('{0}:' || i.name), 1, 8)) AS BIGINT) % {1}"


def _sql_frame(kind: str, column: str) -> str:
    frames = R.FRAMES[kind]
    text = f"CASE {_PICK.format(kind, len(frames))} " + " ".join(f"WHEN {k} THEN {_sql_text(f, column)}" for k, f in enumerate(frames)) + " END"
    return f"CASE WHEN {column} IS NOT NULL THEN upper(substr({text}, 1, 1)) || substr({text}, 2) END"


_NOTE = "CASE WHEN debt_to_ebitda > 3 THEN CASE rate_environment " + " ".join(f"WHEN '{r}' THEN CASE {_PICK.format('rates', len(t))} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(t)) + " END" for r, t in R.RATE_NOTES.items()) + " END END"
_RATIONALE = f"""
x AS ({_LONG}), l AS (SELECT x.*, i.* EXCLUDE (issuer_id, name) FROM x JOIN issuers i USING (issuer_id)),
wk AS (SELECT issuer_id, string_agg(said, ' and ' ORDER BY n) AS said FROM (SELECT issuer_id, {_SAID[False]} AS said, row_number() OVER (PARTITION BY issuer_id ORDER BY k, name) AS n FROM l x WHERE score < 45) WHERE n <= 2 GROUP BY 1),
sg AS (SELECT issuer_id, string_agg(said, ' and ' ORDER BY n) AS said FROM (SELECT issuer_id, {_SAID[True]} AS said, row_number() OVER (PARTITION BY issuer_id ORDER BY k, name) AS n FROM l x WHERE score > 62) WHERE n <= 2 GROUP BY 1),
re AS (SELECT issuer_id, said FROM (SELECT issuer_id, {_SAID[False]} AS said, row_number() OVER (PARTITION BY issuer_id ORDER BY k, name) AS n FROM l x WHERE score < 50) WHERE n = 1),
ra AS (SELECT i.issuer_id, rating, concat_ws(' ', CASE WHEN wk.said IS NOT NULL THEN {_sql_frame('negative', 'wk.said')} WHEN sg.said IS NOT NULL THEN {_sql_frame('positive', 'sg.said')} ELSE {_sql_text(R.BALANCED, 'lower(sector)')} END,
  CASE WHEN wk.said IS NOT NULL THEN {_sql_frame('offset', 'sg.said')} WHEN sg.said IS NOT NULL THEN {_sql_frame('residual', 're.said')} END, {_NOTE},
  {_sql_text(R.CLOSING, 'rating', "CASE WHEN rating IN ('AAA', 'AA', 'A', 'BBB') THEN 'investment grade' ELSE 'speculative grade' END")}) AS rationale
  FROM issuers i JOIN (SELECT issuer_id, rating FROM ({CATALOG['scorecard_rating'].sql}) sr) q USING (issuer_id) LEFT JOIN wk USING (issuer_id) LEFT JOIN sg USING (issuer_id) LEFT JOIN re USING (issuer_id))
"""


@query(f"WITH {_RATIONALE} SELECT issuer_id, rating, rationale FROM ra")
def compose_rationale(t: Tables) -> DataFrame:
    return S.rated(t.issuers).select("issuer_id", "rating", S.rationale().alias("rationale"))


@query(f"""
WITH {_RATIONALE}, pf AS ({CATALOG['render_profile'].sql})
SELECT issuer_id, sha256({_sql_text(R.SYSTEM_PROMPT)}) AS system_sha, sha256(profile) AS user_sha, sha256('Rating: ' || rating || chr(10) || chr(10) || 'Rationale: ' || rationale) AS assistant_sha FROM ra JOIN pf USING (issuer_id)
""")
def chat_messages(t: Tables) -> DataFrame:
    """Training dialogues of three turns, as digests of what each turn says."""
    rows = S.dialogues(S.rated(t.issuers))
    said = F.from_json("messages", "array<struct<role:string,content:string>>")
    digest = lambda role: F.sha2(F.element_at(F.filter("m", lambda x: x["role"] == role), 1)["content"], 256).alias(f"{role}_sha")
    return rows.select("issuer_id", said.alias("m")).select("issuer_id", *map(digest, ("system", "user", "assistant")))


_PAIRS_SQL = "SELECT truth_idx, pred_idx, abs(truth_idx - pred_idx) AS d FROM rating_pairs"
_CLASSES = """
k(idx) AS (SELECT unnest(range(7))::INTEGER), c AS (
  SELECT idx, count(*) FILTER (truth_idx = idx AND pred_idx = idx)::DOUBLE AS tp, count(*) FILTER (pred_idx = idx)::DOUBLE AS predicted,
    count(*) FILTER (truth_idx = idx AND pred_idx IS NOT NULL)::DOUBLE AS scored, count(*) FILTER (truth_idx = idx) AS support FROM k, rating_pairs GROUP BY idx),
pr AS (SELECT idx, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0e0 END AS precision, CASE WHEN scored > 0 THEN tp / scored ELSE 0e0 END AS recall, support FROM c),
per AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2e0 * precision * recall / (precision + recall) ELSE 0e0 END AS f1 FROM pr)
"""


@query(f"WITH {_CLASSES} SELECT idx, {_R4.format('precision')} AS precision, {_R4.format('recall')} AS recall, {_R4.format('f1')} AS f1, support FROM per")
def rating_per_class(t: Tables) -> DataFrame:
    return S.class_metrics(t.rating_pairs).select("idx", *(C.fixed(F.col(c), 4).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(f"""
WITH p AS ({_PAIRS_SQL}), {_CLASSES}
SELECT count(*) AS n, count(*) FILTER (pred_idx IS NULL) AS unparseable, {_R4.format('(count(*) FILTER (d = 0)::DOUBLE / count(*))')} AS exact_accuracy, {_R4.format('avg(d)')} AS mean_notch_error,
  (SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) AS k FROM p WHERE d IS NOT NULL) WHERE k = (SELECT count(d) // 2 + 1 FROM p))::BIGINT AS median_notch_error,
  {_R4.format('(count(*) FILTER (d <= 1)::DOUBLE / count(*))')} AS within_one_notch, {_R4.format('(count(*) FILTER ((truth_idx <= 3) = (pred_idx <= 3))::DOUBLE / count(*))')} AS ig_hy_accuracy,
  (SELECT {_R4.format('avg(f1)')} FROM per WHERE support > 0) AS macro_f1 FROM p
""")
def rating_metrics(t: Tables) -> DataFrame:
    found = S.pair_metrics(t.rating_pairs)
    return found.withColumns({c: C.fixed(F.col(c), 4) for c in ("exact_accuracy", "mean_notch_error", "within_one_notch", "ig_hy_accuracy", "macro_f1")})


@query("SELECT truth_idx, " + ", ".join(f"count(*) FILTER (pred_idx = {i}) AS p{i}" for i in range(7)) + ", count(*) FILTER (pred_idx IS NULL) AS unparseable FROM rating_pairs GROUP BY truth_idx")
def confusion_matrix(t: Tables) -> DataFrame:
    named = t.rating_pairs.withColumn("p", F.coalesce(F.concat(F.lit("p"), F.col("pred_idx").cast("string")), F.lit("unparseable")))
    return named.groupBy("truth_idx").pivot("p", [*(f"p{i}" for i in range(7)), "unparseable"]).count().na.fill(0)


_TALLY = "PARTITION BY l_orderkey ORDER BY l_linenumber, truth_idx, pred_idx NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query(f"""
SELECT l_orderkey, l_linenumber, count(*) OVER w AS answered, count(*) FILTER (d = 0) OVER w AS exact, count(*) FILTER (d <= 1) OVER w AS within_one, {_R4.format('avg(d) OVER w')} AS mean_notch
FROM (SELECT *, abs(truth_idx - pred_idx) AS d FROM rating_pairs) p WINDOW w AS ({_TALLY})
""")
def session_tally(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "truth_idx", "pred_idx").rowsBetween(Window.unboundedPreceding, 0)
    d = F.abs(F.col("truth_idx") - F.col("pred_idx"))
    return t.rating_pairs.select("l_orderkey", "l_linenumber", F.count(F.lit(1)).over(w).alias("answered"), F.count_if(d == 0).over(w).alias("exact"), F.count_if(d <= 1).over(w).alias("within_one"), C.fixed(F.avg(d).over(w), 4).alias("mean_notch"))


@query(f"""
WITH r AS (SELECT issuer_id, rating, row_number() OVER (PARTITION BY rating ORDER BY sha256(issuer_id::VARCHAR)) AS k, count(*) OVER (PARTITION BY rating) AS n FROM ({_RATED}) q),
s AS (SELECT *, CASE WHEN n >= 10 THEN greatest(1, round_even(n * 0.1e0, 0)::INTEGER) ELSE 0 END AS share FROM r)
SELECT issuer_id, rating, CASE WHEN k <= share THEN 'valid' WHEN k <= share * 2 THEN 'test' ELSE 'train' END AS split FROM s
""")
def stratified_split(t: Tables) -> DataFrame:
    return S.stratified_split(S.rated(t.issuers).select("issuer_id", "rating"), "issuer_id", "rating")


@query(f"SELECT issuer_id, rating FROM (SELECT *, row_number() OVER (PARTITION BY rating ORDER BY sha256(issuer_id::VARCHAR)) AS k FROM ({_RATED}) q) WHERE k <= 60")
def class_balance_quota(t: Tables) -> DataFrame:
    return S.balance_quota(S.rated(t.issuers).select("issuer_id", "rating"), "issuer_id", "rating", 420, len(R.RATINGS))


_RUN = "CASE user_id % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'tuned' ELSE 'other' END"
_RUN_METRICS = f"""
SELECT {_RUN} AS run, 'events' AS metric, count(*)::DOUBLE AS value FROM events GROUP BY 1 UNION ALL SELECT {_RUN}, 'errors', count(*) FILTER (event_type = 'error') FROM events GROUP BY 1
UNION ALL SELECT {_RUN}, 'least_loss', min(value) FROM events GROUP BY 1 UNION ALL SELECT {_RUN}, 'runs', count(DISTINCT user_id) FROM events GROUP BY 1
"""


@query(f"""
SELECT metric, max(value) FILTER (run = 'base') AS base, max(value) FILTER (run = 'tuned') AS tuned, max(value) FILTER (run = 'other') AS other FROM ({_RUN_METRICS}) m GROUP BY metric
""")
def run_comparison(t: Tables) -> DataFrame:
    """Runs side by side: a row a metric, a column a run."""
    run = F.when(F.col("user_id") % 3 == 0, "base").when(F.col("user_id") % 3 == 1, "tuned").otherwise("other")
    per = t.events.groupBy(run.alias("run")).agg(F.count(F.lit(1)).cast("double").alias("events"), F.count_if(F.col("event_type") == "error").cast("double").alias("errors"), F.min("value").cast("double").alias("least_loss"), F.count_distinct("user_id").cast("double").alias("runs"))
    rows = per.unpivot("run", ["events", "errors", "least_loss", "runs"], "metric", "value")
    return rows.groupBy("metric").pivot("run", ["base", "tuned", "other"]).agg(F.max("value"))
