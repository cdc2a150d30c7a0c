"""Streaming extensions: windowed activity with late data, and continuous upsert of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_activity(events: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("event_type",), value: str = "value", size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and key, batch or stream; a stream drops what is later than ``late``."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(ts, late)
    out = rows.groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.unix_seconds("w.start").alias("window_start_epoch"), *keys, "n", "total")


def upsert_commits(stream: DataFrame, folder: str, checkpoint: str, key: str = "commit_sha"):
    """Append the rows of commits that ``folder`` doesn't hold yet; replays of a batch change nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        from orebody.sources.index import exists

        spark = batch.sparkSession
        new = batch.dropDuplicates()
        if exists(spark, f"{folder}/_SUCCESS"):
            new = new.join(spark.read.parquet(folder).select(key).distinct(), key, "left_anti")
        new.write.mode("append").parquet(folder)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
