"""Medians of several passes of a replay.

``passes`` has a row for each pass and class: pass (from 0), fingerprint and the columns of a fingerprint's report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import scalars

COUNTS = ("count", "errors", "skipped", "not_run", "p50_us", "p95_us", "p99_us", "max_us")


def median_long(c: Column) -> Column:
    """The median of whole numbers; of two in the middle the mean, rounded down. Passes are few."""
    v = F.array_sort(F.collect_list(c))
    n = F.size(v)
    low, high = F.get(v, ((n - 1) / 2).cast("int")), F.get(v, (n / 2).cast("int"))
    return F.when(n > 0, F.floor((low + high) / 2).cast("long"))


def median_double(c: Column) -> Column:
    return F.median(c)


def median_classes(passes: DataFrame) -> DataFrame:
    """One row for each class of any pass."""
    present = F.col("result_bytes").isNotNull()
    of = lambda f: F.when(present, F.col(f"result_bytes.{f}"))
    digest = F.col("checksum.digest")
    out = passes.groupBy("fingerprint").agg(
        F.min_by("id", "pass").alias("id"),
        *[median_long(F.col(c)).alias(c) for c in COUNTS],
        median_double(F.col("mean_us")).alias("mean_us"),
        F.min_by("first_error", F.when(F.col("first_error").isNotNull(), F.col("pass"))).alias("first_error"),
        F.count_if(present).alias("_sized"),
        *[median_long(of(f)).alias(f"_{f}") for f in ("total", "min", "max", "p50", "p95")],
        median_double(of("mean")).alias("_mean"),
        F.min_by("checksum", "pass").alias("checksum"),
        (F.count_distinct(digest) > 1).alias("_varied"),
    )
    sizes = F.when(F.col("_sized") > 0, F.struct(*[F.col(f"_{f}").alias(f) for f in ("total", "min", "max", "mean", "p50", "p95")]))
    marked = F.when(F.col("checksum").isNotNull(), F.col("checksum").withField("nondeterministic", F.col("checksum.nondeterministic") | F.col("_varied")))
    return out.withColumns({"result_bytes": sizes, "checksum": marked}).drop("_sized", "_total", "_min", "_max", "_mean", "_p50", "_p95", "_varied")


def median_decades(passes: DataFrame) -> DataFrame:
    """A10: the median of each decade over the passes in which it appears; decades in order, unknown labels last."""
    each = passes.select("fingerprint", F.explode("size_buckets").alias("b")).select("fingerprint", "b.*")
    out = each.groupBy("fingerprint", "bucket").agg(*[median_long(F.col(c)).alias(c) for c in ("count", "p50_us", "p95_us", "max_us", "bytes_total")], median_double(F.col("mean_us")).alias("mean_us"))
    return out.withColumn("decade", scalars.label_index(F.col("bucket")))


def median_runs(runs: DataFrame) -> DataFrame:
    """One row for ``runs`` (pass and the columns of a run, without its classes): identity is the first pass's."""
    paced = F.bool_and(F.col("pacing").isNotNull())
    first = lambda c: F.min_by(c, "pass").alias(c)
    totals = [median_long(F.col(f"totals.{f}")).alias(f) for f in ("events", "sessions", "executed", "skipped", "errors", "not_run", "connect_failures", "filtered")]
    out = runs.groupBy().agg(
        F.count("*").alias("passes"),
        *[first(c) for c in ("tool", "tool_version", "capture_file", "capture_dialect", "latency_source", "target_url", "target_server_version", "flags", "target_settings")],
        F.min_by("started_at", "pass").alias("started_at"),
        F.max_by("ended_at", "pass").alias("ended_at"),
        median_double(F.col("wall_secs")).alias("wall_secs"),
        F.bool_or("aborted").alias("aborted"),
        *totals,
        median_double(F.col("totals.qps")).alias("qps"),
        median_long(F.col("saturation.samples")).alias("samples"),
        median_long(F.col("saturation.saturated_samples")).alias("saturated_samples"),
        median_double(F.col("saturation.saturated_pct")).alias("saturated_pct"),
        paced.alias("all_paced"),
        F.min_by("pacing.speed", "pass").alias("speed"),
        median_long(F.col("pacing.paced_events")).alias("paced_events"),
        median_long(F.col("pacing.max_lag_us")).alias("max_lag_us"),
        median_double(F.col("pacing.mean_lag_us")).alias("mean_lag_us"),
    )
    return out.where("passes > 0").select(
        *["tool", "tool_version", "capture_file", "capture_dialect", "latency_source", "target_url", "target_server_version", "started_at", "ended_at", "wall_secs", "aborted", "flags", "target_settings"],
        F.struct("passes", F.lit("median").alias("method")).alias("aggregation"),
        F.struct("events", "sessions", "executed", "skipped", "errors", "not_run", "connect_failures", "qps", "filtered").alias("totals"),
        F.struct("samples", "saturated_samples", "saturated_pct").alias("saturation"),
        F.when(F.col("all_paced"), F.struct("speed", "paced_events", "max_lag_us", "mean_lag_us")).alias("pacing"),
    )
