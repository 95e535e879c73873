"""Structured Streaming forms: deduplicated minute bars of trades with a watermark, late rows counted."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapeline.functions.clean import clock_ticks, second_ticks
from tapeline.session import fresh_path


def event_times(feed: DataFrame) -> DataFrame:
    """The feed with ``at``, the moment of the change, from its date and clock."""
    ms = F.coalesce(second_ticks(F.col("timeseconds"), 1000), clock_ticks(F.col("hms"), 1000))
    midnight = F.unix_seconds(F.to_timestamp("trade_date", "yyyyMMdd"))
    return feed.withColumn("at", F.timestamp_millis(midnight * 1000 + ms)).where("at IS NOT NULL")


def minute_bars(feed: DataFrame, delay: str) -> DataFrame:
    """Trades a symbol and minute, each change once, of a stream or a table.

    On a stream state older than ``delay`` behind the latest event is dropped, and so are rows that come later than that;
    :func:`run_to_end` counts them. A table has no late rows.
    """
    key, trades = ["symbol", "trade_date", "seqno"], event_times(feed).where("actiontype = 2")
    once = trades.withWatermark("at", delay).dropDuplicatesWithinWatermark(key) if feed.isStreaming else trades.dropDuplicates(key)
    window = F.window("at", "1 minute")
    return once.groupBy("symbol", window).agg(F.count("*").alias("n"), F.sum("volume").alias("volume")).select(
        "symbol", F.col("window.start").alias("minute"), "n", "volume"
    )


def run_to_end(spark: SparkSession, path: str, schema: StructType, delay: str, files: int = 8) -> tuple[DataFrame, int]:
    """The stream of the files at ``path`` run until all are read, ``files`` a batch: its bars, written and committed file by file,
    and how many rows came too late to count.

    Output and progress go to the shared folder, so a restart goes on where the last batch was committed.
    """
    at = fresh_path(spark, "minute-bars")
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    kept = spark.conf.get(_KEPT)
    spark.conf.set(_KEPT, "1000000")  # a line of progress for each batch, which hold the counts
    try:
        query = (
            minute_bars(feed, delay)
            .writeStream.format("parquet")
            .option("path", f"{at}/data")
            .option("checkpointLocation", f"{at}/progress")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(_KEPT, kept)
    if query.exception():
        raise query.exception()
    # rows dropped by the deduplication, the first to see them
    late = sum(max((op.get("numRowsDroppedByWatermark", 0) for op in json.loads(p.json)["stateOperators"]), default=0) for p in query.recentProgress)
    return spark.read.schema("symbol string, minute timestamp, n long, volume long").parquet(f"{at}/data"), late


_KEPT = "spark.sql.streaming.numRecentProgressUpdates"
