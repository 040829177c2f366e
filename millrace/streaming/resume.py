"""Resumable keyed upserts for Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import keep_last


def upsert(path: str, key: str, pos: str, resolved: str | None = None, buckets: int = 64):
    """A foreachBatch function: a Parquet table of generations by buckets of the key; a batch rewrites the buckets it
    touches, each with the last row of every key so far, and leaves the others. A key whose last row has resolved (a
    boolean column) goes. A batch that comes again writes the same generation."""
    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        own = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in own.select("bucket").distinct().collect()]
        before = _newest(spark, path, epoch)
        old = before.where(F.col("bucket").isin(touched)).select(*own.columns) if before is not None else None
        every = own if old is None else old.unionByName(own)
        last = keep_last(every, key, pos)
        last = last.where(~F.coalesce(F.col(resolved), F.lit(False))) if resolved else last
        # a bucket that becomes empty is written with a row that has no key
        none = spark.createDataFrame([(b,) for b in touched], "bucket int")
        last.select(*own.columns).unionByName(none, allowMissingColumns=True).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/g={epoch}")

    return run


def _newest(spark, path: str, before: int | None = None) -> DataFrame | None:
    """Rows of each bucket's newest generation."""
    try:
        df = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001  before the first batch there is no table
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None
    if before is not None:
        df = df.where(F.col("g") < before)
    newest = df.groupBy("bucket").agg(F.max("g").alias("g"))
    return df.join(F.broadcast(newest), ["bucket", "g"])


def current(spark, path: str, key: str) -> DataFrame:
    """The table that upsert() keeps."""
    return _newest(spark, path).where(F.col(key).isNotNull()).drop("bucket", "g")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"))
