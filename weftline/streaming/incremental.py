"""Linkage of newly arriving sources, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from weftline.sources.writers import upsert_parts


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def linked_stream(sources: DataFrame, match: Callable[[DataFrame], DataFrame], results: str, checkpoint: str, key: str = "src") -> StreamingQuery:
    """Matches each batch of new sources and upserts its results by key, so that a repeated batch changes nothing; only
    the parts of the table that a batch falls in are written again. Runs over all that is there, then ends."""

    def step(batch: DataFrame, _: int) -> None:
        upsert_parts(batch.sparkSession, match(batch), results, key)

    return sources.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timed(events: DataFrame, time: str = "ts") -> DataFrame:
    """Event times as timestamps: watermarks need those."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(events: DataFrame, length: str, by: str, value: str, time: str = "ts", late: str | None = None) -> DataFrame:
    """Number and sum of each window and type; on a stream with a watermark for late rows."""
    rows = timed(events, time)
    rows = rows.withWatermark(time, late) if late else rows
    out = rows.groupBy(F.window(time, length).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, gap: str, user: str, time: str = "ts", late: str | None = None) -> DataFrame:
    """Sessions of each user: rows less than a gap apart."""
    rows = timed(events, time)
    rows = rows.withWatermark(time, late) if late else rows
    out = rows.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("w.start").alias("session_start"), "n")
