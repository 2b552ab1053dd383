"""Class statistics of an event table that is still growing: an extension beyond batch reports.

New Parquet files of events are taken up as they come. Events count to windows by their own time, and those later than the watermark are
left out; histogram cells, not latencies, are the state, so it grows with the classes and the histogram, not with the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright import schemas
from tracewright.functions import hdr, sqltext


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schemas.ORDERED_EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_cells(events: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(window, fingerprint, cell, n): counts of latency cells by window and class."""
    timed = events.select(F.timestamp_micros("ts_micros").alias("ts"), sqltext.fingerprint(F.col("query")).alias("fingerprint"), hdr.highest(hdr.clamped(hdr.micros(F.col("orig_query_time_s")), 3)).alias("cell"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", window), "fingerprint", "cell").agg(F.count("*").alias("n"))


def quantiles(cells: DataFrame) -> DataFrame:
    """Batch side: the report of each window from its cells."""
    from pyspark.sql import Window as W

    keys = ("window", "fingerprint")
    upto = W.partitionBy(*keys).orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    ranked = cells.withColumn("upto", F.sum("n").over(upto)).withColumn("every", F.sum("n").over(W.partitionBy(*keys)))
    return ranked.groupBy(*keys).agg(F.sum("n").alias("count"), *[F.min(F.when(F.col("upto") >= F.greatest(F.ceil(q * F.col("every")), F.lit(1)), F.col("cell"))).alias(name) for name, q in hdr.LATENCY_QUANTILES.items()], F.max("cell").alias("max_us"))
