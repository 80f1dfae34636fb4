"""Streams over the append-only source and logs. No watermark: a late restatement must never be dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskloom import registry as R
from riskloom.operators import quality as Q
from riskloom.sources import loads as L
from riskloom.sources.ledgered import LedgeredSource, exists


def append_loads(spark: SparkSession, incoming: str, columns: list[str], target: LedgeredSource, quarantine: str, checkpoint: str, today: str) -> StreamingQuery:
    """Watch a folder of delivered JSON files. Each micro-batch is validated whole and becomes the next load of the ledger; one
    that breaks a rule goes to quarantine and takes no number. A batch that runs again after a crash finds its content in the
    ledger, or replaces what it had staged.
    """
    rows = spark.readStream.schema(", ".join(f"{c} string" for c in columns)).json(incoming)

    def batch(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            if df.isEmpty():
                return
            broken = L.validate(df, R.OBLIGOR, today).limit(1).count()
            if broken:
                df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(quarantine)
            else:
                target.append(df)
        finally:
            df.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_feedback(log: DataFrame) -> DataFrame:
    """The newest record of each interaction; a later correction wins whenever it comes."""
    body = F.struct(*[c for c in log.columns if c != "interaction_id"])
    return log.groupBy("interaction_id").agg(F.max_by(body, "seq").alias("r")).select("interaction_id", "r.*")


def answer_memory(log: DataFrame) -> DataFrame:
    """Per question and context: the answer of the best status, the newest within it."""
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in Q.PRECEDENCE.items() for x in kv)), F.col("status"))
    best = F.max_by(F.struct("answer_id", "seq", "status"), F.struct((-rank).alias("rank"), "seq", "answer_id"))
    return log.groupBy("question_id", "context_id").agg(best.alias("r")).select("question_id", "context_id", "r.*")


class KeyedTable:
    """A table of one row a key that a stream keeps up to date: a batch rewrites the shards of the keys that it changes.

    Rows lie in shards by a hash of their key. A batch writes new versions of the shards that it touches, and then one small
    file that says which version of which shard is current; that file is the commit, so a batch that stops before it leaves
    nothing behind that is read, and one that runs again after it does nothing.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType, shards: int = 64):
        self.spark, self.path, self.keys, self.schema, self.shards = spark, path, keys, schema, shards

    def _versions(self) -> DataFrame:
        """shard, version: the current ones."""
        if not exists(self.spark, f"{self.path}/commits"):
            return self.spark.createDataFrame([], "shard int, version long")
        return self.spark.read.schema("shard int, version long").parquet(f"{self.path}/commits").groupBy("shard").agg(F.max("version").alias("version"))

    def read(self, shards: list[int] | None = None) -> DataFrame:
        current = self._versions().collect()  # a row a shard: a fixed number
        folders = [f"{self.path}/rows/version={r['version']}/shard={r['shard']}" for r in current if shards is None or r["shard"] in shards]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def merge(self, rows: DataFrame, version: int, transform: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Put rows into the table: `transform` makes one row a key of old and new ones. Returns the shards that were rewritten."""
        if not self._versions().filter(F.col("version") >= version).isEmpty():
            return []
        shard = F.pmod(F.xxhash64(*self.keys), F.lit(self.shards)).cast("int")
        touched = sorted(r["shard"] for r in rows.select(shard.alias("shard")).distinct().collect())  # a fixed number at most
        merged = transform(self.read(touched).unionByName(rows)).withColumn("shard", shard)
        merged.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/rows/version={version}")
        done = self.spark.createDataFrame([(s, version) for s in touched], "shard int, version long")
        done.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return touched


def keep_table(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], transform: Callable[[DataFrame], DataFrame], checkpoint: str, out: str) -> KeyedTable:
    """Run over a folder of files as a stream, one file a batch, and keep the transformation's result as a table by key. The
    transformation must give the same whether it sees all rows of a key, or its own earlier result and the later rows."""
    result = transform(spark.createDataFrame([], schema)).schema
    table = KeyedTable(spark, out, keys, result)

    def batch(df: DataFrame, batch_id: int) -> None:
        table.merge(transform(df), batch_id, transform)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table
