"""Reports and events as they arrive: repeated deliveries dropped, windows kept up to date, states merged."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suitelens.sources.sinks import merged_states
from suitelens.storage import shared_dir


def deduplicated(stream: DataFrame, key: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key once, for as long as the watermark remembers it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, time: str, size: str, by: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums per window of event time; rows later than the watermark are left out."""
    w = F.window(F.col(time), size)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def run_to_table(stream: DataFrame, key: list[str], name: str) -> DataFrame:
    """Run what has arrived to its end; of each key the last update."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/suitelens/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    updates = spark.read.parquet(f"{base}/out").drop("batch")
    columns = [c for c in updates.columns if c != "_batch"]
    last = updates.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key))).agg(F.max_by(F.struct(*columns), "_batch").alias("_r"))
    return last.select("_r.*")


def upsert_states(path: str, key: list[str], order: str):
    """A foreachBatch function that merges batches into the states at ``path``, each written as a new version."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = f"{path}/v={number}"
        if number:
            stored = spark.read.parquet(f"{path}/v={number - 1}")
            merged_states(stored, batch.select(*stored.columns), key, order).write.mode("overwrite").parquet(fresh)
        else:
            merged_states(batch.limit(0), batch, key, order).write.mode("overwrite").parquet(fresh)

    return merge


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each type per hour, read as a stream."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]").withColumn("at", F.col("ts").cast("timestamp"))
    stream = windowed(events, "at", "1 hour", ["event_type"], "value", late="40 days")
    out = run_to_table(stream, ["start", "event_type"], "event-windows")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {"event_windows": event_windows}
SQL = {"event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"}
