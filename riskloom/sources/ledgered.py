"""An append-only source whose ledger is the commit mark of its loads.

A load is staged as a partition of the source and becomes visible when its row is in the ledger; readers take the loads that the
ledger names. Its number is the ledger's last one plus one, so that a refused delivery uses none up, and a run that stops between
the two writes leaves a partition that the next run replaces. A delivery whose digest the ledger has is not appended again.
One writer at a time is assumed, as a stream has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import registry as R
from riskloom.operators import digests
from riskloom.sources import loads as L
from riskloom.sources.shared import written

SCHEMA = "load_id long, table_name string, file_sha256 string, row_count long, restated_rows long, first_date date, last_date date, last_cutoff date, prev_hash string, chain_hash string"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


@dataclass
class LedgeredSource:
    spark: SparkSession
    table: R.Table
    name: str
    source: str
    ledger_path: str

    def ledger(self) -> DataFrame:
        """One row a load, in the order of their numbers."""
        if not exists(self.spark, self.ledger_path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.ledger_path)

    def rows(self) -> DataFrame | None:
        """The rows of committed loads; None before the first."""
        if not exists(self.spark, self.source):
            return None
        loads = self.ledger().select("load_id")
        return self.spark.read.parquet(self.source).withColumn("load_id", F.col("load_id").cast("long")).join(F.broadcast(loads), "load_id", "left_semi")  # a row a load

    def stage(self, rows: DataFrame) -> dict | None:
        """Write a validated delivery as the next load's partition; returns its ledger entry without the hashes, or None if the
        ledger has the same content already."""
        text = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
        content = digests.tree(rows.withColumn("_all", F.lit(0)), ["_all"], text).first()
        known = self.ledger()
        if not known.filter(F.col("file_sha256") == content["digest"]).isEmpty():
            return None
        load = (known.agg(F.max("load_id")).first()[0] or 0) + 1
        before = self.rows()
        again = L.restated(rows, before, self.table.grain).count() if before is not None else 0
        n = L.append_load(rows, self.table, self.source, load)
        if n != content["n"]:
            raise ValueError(f"load {load} has {n} rows, the delivery {content['n']}")
        days = L.window(rows).first()
        return {"load_id": load, "table_name": self.name, "file_sha256": content["digest"], "row_count": n, "restated_rows": again, **days.asDict()}

    def commit(self, entry: dict) -> None:
        """Write the ledger row of a staged load, with the hash of the one before and its own."""
        last = self.ledger().orderBy(F.col("load_id").desc()).select("load_id", "chain_hash").first()
        if entry["load_id"] != (last["load_id"] if last else 0) + 1:
            raise ValueError(f"load {entry['load_id']} doesn't follow {last}")
        fields = SCHEMA.removesuffix(", prev_hash string, chain_hash string")
        row = self.spark.createDataFrame([tuple(entry[f.split()[0]] for f in fields.split(", "))], fields)
        text = L.load_texts(row).first()["text"]
        row = row.withColumn("prev_hash", F.lit(last["chain_hash"] if last else L.GENESIS))
        row.withColumn("chain_hash", L.chained(F.col("prev_hash"), F.lit(text))).coalesce(1).write.mode("append").parquet(self.ledger_path)

    def append(self, rows: DataFrame) -> int | None:
        """Stage and commit; the load's number, or None if the content is there already."""
        entry = self.stage(written(rows, "delivery"))
        if entry is None:
            return None
        self.commit(entry)
        return entry["load_id"]

    def broken(self) -> DataFrame:
        """Loads whose hashes don't follow from the ledger's entries."""
        return L.broken_links(self.ledger(), self.ledger())
