"""Snapshot trends and incremental analysis, as batch and as structured streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_counts(events: DataFrame, ts: str = "ts", value: str = "value", watermark: str | None = None) -> DataFrame:
    """(start, events, total) per day; with a watermark on a stream, days close once it has passed them."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    return rows.groupBy(F.window(ts, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "events", "total")


def daily_trend(events: DataFrame, keep: int = 30) -> DataFrame:
    """(day, events, total, change, age) of the last keep days; the windows run over one row per day."""
    d = daily_counts(events).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "events", F.round("total", 4).alias("total"))
    age = F.row_number().over(Window.orderBy(F.col("day").desc()))
    return d.withColumn("change", F.col("events") - F.lag("events").over(Window.orderBy("day"))).withColumn("age", age).where(F.col("age") <= keep)


def retained(snapshots: DataFrame, keep: int, by: str = "taken_at", scope: str | None = None) -> DataFrame:
    """The rows of the last keep snapshots of a scope; keep 0 retains none, -1 all."""
    if keep < 0:
        return snapshots
    w = (Window.partitionBy(scope) if scope else Window.partitionBy(F.lit(0))).orderBy(F.col(by).desc())
    times = snapshots.select(*([scope] if scope else []), by).distinct().withColumn("_age", F.row_number().over(w)).where(F.col("_age") <= keep).drop("_age")
    return snapshots.join(times, [*([scope] if scope else []), by], "left_semi")


def changed_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """files (path, content) whose content hash is not in seen (path, hash): only these need a new analysis."""
    return files.withColumn("hash", F.sha2("content", 256)).join(seen.select("path", "hash"), ["path", "hash"], "left_anti")


def stream_counts(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, watermark: str = "2 days") -> StreamingQuery:
    """Daily counts of Parquet files as they arrive in source, appended to out when a day has closed."""
    events = spark.readStream.schema(schema).parquet(source)
    return daily_counts(events, watermark=watermark).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_files(spark: SparkSession, source: str, analyse: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls analyse with each batch (path, content) of new source files."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length bigint, content binary").load(source)
    rows = files.select("path", F.col("content").cast("string").alias("content"))
    return rows.writeStream.foreachBatch(analyse).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
