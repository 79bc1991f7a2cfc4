"""Streams of interactions and of changed elements."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.upsert import latest
from codeloom.session import materialize, shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def windowed_stats(events: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events and their value per type and window; in update or append mode, events later than the watermark are dropped and the state of closed windows with them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def run_updates(stream: DataFrame, keys: list[str], base: str) -> DataFrame:
    """Runs an aggregating stream in update mode over what is there now, and returns its rows as they stand.

    A micro-batch holds the groups that changed, and is written to a folder of its own number, so that
    one that is replayed after a loss replaces itself. Progress and rows live under ``base``: a later
    run with the same folder goes on where this one stopped. Of several rows of a group the last counts.
    """
    spark = stream.sparkSession

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/epoch={epoch}")

    stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{_ddl(stream)}, epoch long").parquet(f"{base}/rows")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_last")).select(*keys, "_last.*")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def own_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"codeloom-{name}-{uuid.uuid4().hex}")


def interaction_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", base: str | None = None) -> DataFrame:
    """Daily statistics of an event folder, computed by a stream."""
    events = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 1000).parquet(folder)
    table = run_updates(windowed_stats(events), ["w", "event_type"], base or own_folder(spark, "interactions"))
    return table.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))


def incremental_index(spark: SparkSession, folder: str, schema: str, keys: list[str], version: str, base: str | None = None, buckets: int = 64) -> DataFrame:
    """A keyed table kept up to date from a folder of deliveries: every micro-batch is folded into the stored rows it touches.

    Rows are stored by a hash of their key in ``buckets`` parts; a batch reads and replaces only the parts that its
    keys fall into. Folding a batch twice changes nothing, and progress lives beside the table under
    ``base``, so that a run that was lost, or a later one, goes on from there. Null keys are dropped.
    """
    base = base or own_folder(spark, "index")
    path = f"{base}/table"

    def stored(session: SparkSession) -> DataFrame:
        where = session._jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(session._jsc.hadoopConfiguration()).exists(where)
        return session.read.schema(f"{schema}, _bucket int").parquet(path) if there else session.createDataFrame([], f"{schema}, _bucket int")

    def fold(batch: DataFrame, epoch: int) -> None:
        new = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most a number per bucket
        merged = materialize(latest(stored(batch.sparkSession).where(F.col("_bucket").isin(touched)).unionByName(new), keys, version), "merge")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)

    stream = spark.readStream.schema(schema).parquet(folder)
    stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return stored(spark).drop("_bucket")
