"""Queries that run as streams to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import registry as R
from riskloom.catalog import query
from riskloom.operators.digests import tree_sql
from riskloom.plans.sources import _CELLS, _TODAY, _scratch
from riskloom.sources.ledgered import LedgeredSource
from riskloom.sources.views import Tables
from riskloom.streaming import streams as W


def json_sql(columns: list[str]) -> str:
    """A row of text cells as JSON, nulls included; the cells of a clean delivery have nothing to escape."""
    cell = lambda c: f"""coalesce('"' || CAST({c} AS VARCHAR) || '"', 'null')"""
    return "'{' || " + " || ',' || ".join(f"""'"{c}":' || {cell(c)}""" for c in columns) + " || '}'"


_CONTENT = tree_sql("SELECT 1 AS everything, " + json_sql(sorted(_CELLS)) + " AS line FROM om", "everything")


@query(f"""
WITH e AS (SELECT 1::BIGINT AS load_id, (SELECT digest FROM ({_CONTENT}) c) AS file_sha256, count(*) AS row_count, min(observation_date) AS first_date, max(observation_date) AS last_date, max(data_cutoff_date) AS last_cutoff FROM om)
SELECT *, sha256('{{"entries": [{{"file_sha256": "' || file_sha256 || '", "row_count": ' || row_count || ', "table_name": "obligor_monthly"}}], "previous": "' || repeat('0', 64) || '"}}') AS chain_hash FROM e
""")
def stream_append_loads(t: Tables) -> DataFrame:
    """A broken delivery, a clean one and the clean one again: the first goes to quarantine, the second becomes load 1, and the third
    is known. What comes out is the ledger."""
    incoming, away, checkpoint = (_scratch(t, n) for n in ("incoming", "quarantine", "stream-checkpoint"))
    target = LedgeredSource(t.spark, R.OBLIGOR, "obligor_monthly", _scratch(t, "stream-source"), _scratch(t, "stream-ledger"))
    cells = t.om.select(*(F.col(c).cast("string").alias(c) for c in _CELLS))
    for rows in (t.delivered, cells, cells):
        rows.write.mode("append").json(incoming)
        W.append_loads(t.spark, incoming, list(_CELLS), target, away, checkpoint, _TODAY).awaitTermination()
    return target.ledger().select("load_id", "file_sha256", "row_count", "first_date", "last_date", "last_cutoff", "chain_hash")


@query("SELECT interaction_id, seq, root_cause, review_status FROM (SELECT *, row_number() OVER (PARTITION BY interaction_id ORDER BY seq DESC) AS k FROM feedback_log) WHERE k = 1")
def stream_latest_feedback(t: Tables) -> DataFrame:
    log = t.feedback_log.select("interaction_id", "seq", "root_cause", "review_status")
    path = _scratch(t, "feedback")
    log.repartition(3, "seq").write.parquet(path)
    return W.keep_table(t.spark, path, log.schema, ["interaction_id"], W.latest_feedback, _scratch(t, "feedback-checkpoint"), _scratch(t, "feedback-out")).read()


@query("""
SELECT question_id, context_id, answer_id, seq, status FROM (SELECT *, row_number() OVER (PARTITION BY question_id, context_id ORDER BY CASE status WHEN 'verified' THEN 0 WHEN 'system' THEN 1 WHEN 'model' THEN 2 ELSE 3 END, seq DESC, answer_id DESC) AS n FROM answers) WHERE n = 1
""")
def stream_answer_memory(t: Tables) -> DataFrame:
    log = t.answers.select("question_id", "context_id", "answer_id", "seq", "status")
    path = _scratch(t, "answers")
    log.repartition(3, "seq").write.parquet(path)
    return W.keep_table(t.spark, path, log.schema, ["question_id", "context_id"], W.answer_memory, _scratch(t, "answers-checkpoint"), _scratch(t, "answers-out")).read()
