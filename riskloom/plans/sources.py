"""Queries of the append-only source: scans, validation, loads, ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import registry as R
from riskloom.catalog import query
from riskloom.operators import digests
from riskloom.operators.digests import tree_sql
from riskloom.sources import loads as L
from riskloom.sources.shared import folder, written
from riskloom.sources.views import Tables

_TODAY = "2010-01-01"


def _scratch(t: Tables, name: str) -> str:
    """A new folder that all executors share; a local session without one gets a folder of its machine."""
    return folder(t.spark, name)


_CELLS = {"obligor_id": "string", "observation_date": "date", "data_cutoff_date": "date", "portfolio": "string", "jurisdiction": "string", "outstanding": "number", "pit_pd": "probability", "days_past_due": "integer", "stage": "integer"}


@query("""
SELECT obligor_id, TRY_CAST(observation_date AS DATE) AS observation_date, TRY_CAST(outstanding AS DOUBLE) AS outstanding, TRY_CAST(pit_pd AS DOUBLE) AS pit_pd,
  CASE WHEN days_past_due <> '2.5' THEN TRY_CAST(days_past_due AS BIGINT) END AS days_past_due, TRY_CAST(stage AS BIGINT) AS stage FROM delivered
""")
def scan_load_file(t: Tables) -> DataFrame:
    """A file written and read again as text cells, then cast."""
    path = _scratch(t, "delivered")
    t.delivered.write.json(path)
    rows = L.typed(L.read_delivered(t.spark, path, "json", list(_CELLS)), R.OBLIGOR)
    return rows.select("obligor_id", "observation_date", "outstanding", "pit_pd", "days_past_due", "stage")


_VALIDATE = {
    "missing_required": [("obligor_id", "obligor_id IS NULL")],
    "blank_string": [("obligor_id", "trim(obligor_id) = ''")],
    "invalid_type": [("days_past_due", "days_past_due IS NOT NULL AND (TRY_CAST(days_past_due AS DOUBLE) IS NULL OR TRY_CAST(days_past_due AS DOUBLE) <> floor(TRY_CAST(days_past_due AS DOUBLE)))")],
    "below_minimum": [("outstanding", "TRY_CAST(outstanding AS DOUBLE) < 0")],
    "above_maximum": [("pit_pd", "TRY_CAST(pit_pd AS DOUBLE) > 1")],
    "not_allowed": [("jurisdiction", "jurisdiction NOT IN ('SAMA', 'CBUAE')"), ("stage", "TRY_CAST(stage AS BIGINT) NOT IN (1, 2, 3)")],
}
_PARTS = " UNION ALL ".join(f"SELECT '{code}' AS code, '{name}' AS name, count(*) FILTER ({when}) AS n FROM delivered" for code, some in _VALIDATE.items() for name, when in some)


@query(f"""
SELECT * FROM ({_PARTS} UNION ALL SELECT 'duplicate_grain', '', count(*) FROM (SELECT obligor_id, observation_date FROM delivered GROUP BY ALL HAVING count(*) > 1)) x WHERE n > 0
""")
def validate_load(t: Tables) -> DataFrame:
    return L.validate(t.delivered, R.OBLIGOR, _TODAY)


_BROKEN = " UNION ALL ".join(f"SELECT DISTINCT '{code}' AS code, '{name}' AS name, coalesce({name}, 'null') AS value FROM delivered WHERE {when}" for code, some in _VALIDATE.items() for name, when in some)


@query(f"""
WITH b AS ({_BROKEN} UNION ALL SELECT DISTINCT 'cutoff_before_observation', 'data_cutoff_date', data_cutoff_date FROM delivered WHERE data_cutoff_date < observation_date
  UNION ALL SELECT DISTINCT 'future_data_cutoff', 'data_cutoff_date', data_cutoff_date FROM delivered WHERE data_cutoff_date > '{_TODAY}')
SELECT code, name, value, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY code, name ORDER BY value) AS n FROM b) WHERE n <= 5
""")
def violation_examples(t: Tables) -> DataFrame:
    return L.examples(t.delivered, R.OBLIGOR, _TODAY)


@query("SELECT count(*) AS n FROM (SELECT obligor_id, observation_date FROM delivered GROUP BY ALL HAVING count(*) > 1)")
def duplicate_grain(t: Tables) -> DataFrame:
    return L.duplicate_grain(t.delivered, R.OBLIGOR)


@query("""
SELECT DISTINCT obligor_id, observation_date FROM delivered d WHERE EXISTS (SELECT 1 FROM loads l WHERE CAST(l.obligor_id AS VARCHAR) = d.obligor_id AND CAST(l.observation_date AS VARCHAR) = d.observation_date AND l.load_id = 2)
""")
def restated_rows(t: Tables) -> DataFrame:
    return L.restated(t.delivered, t.loads.filter("load_id = 2"), R.OBLIGOR.grain)


@query("SELECT min(TRY_CAST(observation_date AS DATE)) AS first_date, max(TRY_CAST(observation_date AS DATE)) AS last_date, max(TRY_CAST(data_cutoff_date AS DATE)) AS last_cutoff FROM delivered")
def load_window(t: Tables) -> DataFrame:
    return L.window(t.delivered)


@query("SELECT obligor_id, observation_date, outstanding, stage, 3 AS load_id FROM om WHERE observation_date >= DATE '2000-01-01'")
def append_load(t: Tables) -> DataFrame:
    path = _scratch(t, "source")
    fresh = t.om.filter("observation_date >= '2000-01-01'").select("obligor_id", "observation_date", "outstanding", "stage")
    n = L.append_load(fresh.select(*(F.col(c).cast("string").alias(c) for c in fresh.columns)), R.OBLIGOR, path, 3)
    if n != fresh.count():
        raise ValueError("a load's partition doesn't hold the rows that were validated")
    rows = t.spark.read.parquet(path)
    return rows.select(F.col("obligor_id").cast("long").alias("obligor_id"), "observation_date", "outstanding", F.col("stage").cast("int").alias("stage"), F.col("load_id").cast("int").alias("load_id"))


@query("SELECT load_id, count(*) AS n, sum(stage)::BIGINT AS stages FROM om GROUP BY load_id")
def seed_load_one(t: Tables) -> DataFrame:
    path = _scratch(t, "seed")
    L.seed(t.om.drop("load_id"), R.OBLIGOR, path)
    return t.spark.read.parquet(path).groupBy("load_id").agg(F.count(F.lit(1)).alias("n"), F.sum("stage").alias("stages"))


#: A year's months as one load: a longer ledger than the two loads of the adapter view.
_YEARLY = "SELECT obligor_id, observation_date, data_cutoff_date, CAST(year(observation_date) - 1994 AS BIGINT) AS load_id FROM om"
_ENTRIES = f"SELECT load_id, count(*) AS n_rows, min(observation_date) AS first_date, max(observation_date) AS last_date, max(data_cutoff_date) AS last_cutoff FROM ({_YEARLY}) y GROUP BY load_id"
#: Two tables a load; a table's digest is that of its keys.
_OBLIGORS, _FACILITIES = (tree_sql(f"SELECT CAST(year(observation_date) - 1994 AS BIGINT) AS load_id, CAST({key} AS VARCHAR) AS line FROM {table}", "load_id") for key, table in (("obligor_id", "om"), ("facility_id", "fm")))
_FILES = f"""
SELECT load_id, 'obligor_monthly' AS table_name, digest AS file_sha256, row_count FROM ({_OBLIGORS}) o JOIN (SELECT load_id, count(*) AS row_count FROM ({_YEARLY}) y GROUP BY 1) n USING (load_id)
UNION ALL SELECT load_id, 'facility_monthly', digest, row_count FROM ({_FACILITIES}) o JOIN (SELECT CAST(year(observation_date) - 1994 AS BIGINT) AS load_id, count(*) AS row_count FROM fm GROUP BY 1) n USING (load_id)
"""
_CHAIN = f"""
WITH RECURSIVE e AS (SELECT load_id, string_agg('{{"file_sha256": "' || file_sha256 || '", "row_count": ' || row_count || ', "table_name": "' || table_name || '"}}', ', ' ORDER BY table_name) AS text FROM ({_FILES}) f GROUP BY load_id),
c AS (SELECT 0::BIGINT AS load_id, '' AS prev_hash, repeat('0', 64) AS chain_hash
  UNION ALL SELECT e.load_id, c.chain_hash, sha256('{{"entries": [' || e.text || '], "previous": "' || c.chain_hash || '"}}') FROM c JOIN e ON e.load_id = c.load_id + 1)
"""


def _files(t: Tables) -> DataFrame:
    def side(rows: DataFrame, name: str, key: str) -> DataFrame:
        dated = rows.select((F.year("observation_date") - 1994).cast("long").alias("load_id"), F.col(key).cast("string").alias("line"))
        return digests.tree(dated, ["load_id"], F.col("line")).select("load_id", F.lit(name).alias("table_name"), F.col("digest").alias("file_sha256"), F.col("n").alias("row_count"))

    return side(t.om, "obligor_monthly", "obligor_id").union(side(t.fm, "facility_monthly", "facility_id"))


def _entries(t: Tables) -> DataFrame:
    return L.ledger(t.sql(_YEARLY, "om"))


@query(_ENTRIES)
def ledger_entry(t: Tables) -> DataFrame:
    return _entries(t)


@query(_CHAIN + "SELECT load_id, prev_hash, chain_hash FROM c WHERE load_id > 0")
def ledger_chain(t: Tables) -> DataFrame:
    return L.chain(_files(t))


@query(_CHAIN + """, st AS (SELECT load_id, prev_hash, CASE WHEN load_id = 4 THEN reverse(chain_hash) ELSE chain_hash END AS chain_hash FROM c WHERE load_id > 0)
SELECT a.load_id FROM st a LEFT JOIN st b ON b.load_id = a.load_id - 1 JOIN e ON e.load_id = a.load_id
WHERE a.prev_hash <> coalesce(b.chain_hash, repeat('0', 64)) OR a.chain_hash <> sha256('{"entries": [' || e.text || '], "previous": "' || coalesce(b.chain_hash, repeat('0', 64)) || '"}')
""")
def ledger_verify(t: Tables) -> DataFrame:
    """A ledger whose fourth hash was changed: the loads that don't follow."""
    files = written(_files(t), "ledger-files")
    stored = L.chain(files).withColumn("chain_hash", F.when(F.col("load_id") == 4, F.reverse("chain_hash")).otherwise(F.col("chain_hash")))
    return L.broken_links(stored, files)


@query(_CHAIN + "SELECT load_id, chain_hash FROM c WHERE load_id = (SELECT max(load_id) FROM c)")
def snapshot_watermark(t: Tables) -> DataFrame:
    return L.watermark(L.chain(_files(t)))


@query("SELECT 'obligor_monthly' AS source, load_id, count(*) AS n FROM loads GROUP BY load_id UNION ALL SELECT 'facility_monthly', 1, count(*) FROM fm")
def source_summary(t: Tables) -> DataFrame:
    one = t.loads.groupBy("load_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("obligor_monthly").alias("source"), "load_id", "n")
    return one.union(t.fm.agg(F.count(F.lit(1)).alias("n")).select(F.lit("facility_monthly"), F.lit(1), "n"))


_LINE = "obligor_id || ',' || observation_date || ',' || stage"


@query(f"""
WITH f AS (SELECT observation_date, string_agg({_LINE}, chr(10) ORDER BY {_LINE}) || chr(10) AS content FROM om GROUP BY observation_date)
SELECT sha256(content) AS sha256, octet_length(encode(content))::BIGINT AS length, observation_date < DATE '1999-01-01' AS refused FROM f
""")
def file_fingerprint(t: Tables) -> DataFrame:
    """A file a month, written and hashed; a file whose bytes the ledger has is refused (here those before 1999)."""
    path = _scratch(t, "files")
    line = F.concat_ws(",", F.col("obligor_id").cast("string"), F.col("observation_date").cast("string"), F.col("stage").cast("string"))
    lines = t.om.select(F.col("observation_date").cast("string").alias("month"), line.alias("value"))
    lines.repartition("month").sortWithinPartitions("month", "value").write.partitionBy("month").text(path)
    found = L.fingerprints(t.spark, f"{path}/*/*.txt")
    known = found.filter(F.regexp_extract("path", r"month=(\d{4})", 1) < "1999").select("sha256")
    unseen = L.unseen_files(found, known).select("path", F.lit(False).alias("new"))
    return found.join(unseen, "path", "left").select("sha256", "length", F.col("new").isNull().alias("refused"))


@query("SELECT obligor_id, observation_date, portfolio, jurisdiction, outstanding, stage FROM om WHERE observation_date = DATE '1999-06-30'")
def export_month(t: Tables) -> DataFrame:
    return L.export_month(t.om, "1999-06-30").select("obligor_id", "observation_date", "portfolio", "jurisdiction", "outstanding", "stage")


@query("SELECT obligor_id, observation_date, stage, load_id FROM loads")
def union_loads(t: Tables) -> DataFrame:
    base, later = t.loads.filter("load_id = 1"), t.loads.filter("load_id > 1")
    return base.unionByName(later).select("obligor_id", "observation_date", "stage", "load_id")


_NULLS = ["revenue", "current_assets", "current_liabilities", "ebitda", "total_debt", "cash", "debt_service", "operating_cash_flow", "interest_expense", "stage"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) - count({c}) AS n FROM om HAVING count(*) > count({c})" for c in _NULLS))
def missing_value_counts(t: Tables) -> DataFrame:
    return L.null_counts(t.om.select(*_NULLS))


@query("""
WITH r AS (SELECT * FROM loads WHERE portfolio IN ('sme', 'corporate')), a AS (
  SELECT 'portfolio_mismatch' AS code, count(*) FILTER (portfolio <> 'corporate') AS n FROM r UNION ALL SELECT 'jurisdiction_mismatch', count(*) FILTER (jurisdiction <> 'SAMA') FROM r
  UNION ALL SELECT 'point_in_time_breach', count(*) FILTER (data_cutoff_date > DATE '2000-01-31') FROM r UNION ALL SELECT 'date_out_of_range', count(*) FILTER (observation_date NOT BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') FROM r
  UNION ALL SELECT 'invalid_field:stage', count(*) FILTER (stage NOT IN (1, 2, 3)) FROM r UNION ALL SELECT 'duplicate_grain', count(*) - count(DISTINCT (obligor_id, observation_date)) FROM r UNION ALL SELECT 'truncated', count(*) - 120 FROM r)
SELECT * FROM a WHERE n > 0
""")
def validate_result(t: Tables) -> DataFrame:
    rows = t.loads.filter(F.col("portfolio").isin("sme", "corporate"))
    return L.validate_result(rows, R.OBLIGOR, "corporate", "SAMA", "2000-01-31", "1996-01-01", "1999-12-31", R.MAXIMUM_ROWS)
