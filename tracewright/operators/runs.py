"""Run reports: aggregates of recorded or measured outcomes by query class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import hdr, scalars, sqltext
from tracewright.operators.checksums import class_checksums


def ranked(classes: DataFrame) -> DataFrame:
    """O1: the slowest classes first."""
    return classes.orderBy(F.desc("p95_us"), F.desc("count"), "fingerprint")


def top(classes: DataFrame, n: int = 10) -> DataFrame:
    """O9 over O1, of classes that were executed."""
    return ranked(classes.where("count > 0")).limit(n)


def recorded_classes(events: DataFrame) -> DataFrame:
    """A1 and A3: latencies that the capture recorded, by ``fingerprint_id``."""
    return hdr.hdr_stats(events, ["fingerprint_id"], hdr.micros(F.col("orig_query_time_s")), hdr.LATENCY_QUANTILES)


def recorded_totals(events: DataFrame) -> DataFrame:
    """A13 over a capture: (events, sessions, wall_secs, qps)."""
    out = events.agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"), ((F.max("ts_micros") - F.min("ts_micros")) / 1e6).alias("wall_secs"))
    return out.withColumn("wall_secs", F.coalesce("wall_secs", F.lit(0.0))).withColumn("qps", F.coalesce(F.try_divide("events", "wall_secs"), F.lit(0.0)))


def outcome_counts(log: DataFrame) -> DataFrame:
    """A2: (fingerprint_id, count, errors, skipped, not_run, first_error)."""
    n = lambda what: F.count_if(F.col("outcome") == what)
    return log.groupBy("fingerprint_id").agg(n("ok").alias("count"), n("error").alias("errors"), n("skipped").alias("skipped"), n("not_run").alias("not_run"), F.min_by("error", F.when(F.col("outcome") == "error", F.col("ordinal"))).alias("first_error"))


def result_sizes(log: DataFrame) -> DataFrame:
    """A4: sizes of results by class, of executed events."""
    ran = log.where("outcome = 'ok'")
    exact = ran.groupBy("fingerprint_id").agg(F.sum("result_bytes").alias("total"), F.min("result_bytes").alias("min"), F.max("result_bytes").alias("max"), (F.sum("result_bytes") / F.count("*")).alias("mean"))
    about = hdr.hdr_stats(ran, ["fingerprint_id"], F.col("result_bytes"), {"p50": 0.5, "p95": 0.95}, 2, "n", None, None)
    return exact.join(about.drop("n"), "fingerprint_id")


def size_decades(log: DataFrame) -> DataFrame:
    """A5: latencies by class and decade of result size, of executed events."""
    ran = log.where("outcome = 'ok'").withColumn("decade", scalars.size_index(F.col("result_bytes")))
    stats = hdr.hdr_stats(ran, ["fingerprint_id", "decade"], F.greatest(F.col("latency_us"), F.lit(1)), {"p50_us": 0.5, "p95_us": 0.95})
    totals = ran.groupBy("fingerprint_id", "decade").agg(F.sum("result_bytes").alias("bytes_total"))
    return stats.join(totals, ["fingerprint_id", "decade"]).withColumn("bucket", F.get(F.array(*map(F.lit, scalars.SIZE_LABELS)), F.col("decade")))


def decade_lists(decades: DataFrame) -> DataFrame:
    """(fingerprint_id, size_buckets) with the decades in order; a class has 7 at most."""
    row = F.struct("decade", "bucket", "count", "p50_us", "p95_us", "mean_us", "max_us", "bytes_total")
    listed = decades.groupBy("fingerprint_id").agg(F.array_sort(F.collect_list(row)).alias("x"))
    return listed.select("fingerprint_id", F.transform("x", lambda d: F.struct(*[d[c].alias(c) for c in ("bucket", "count", "p50_us", "p95_us", "mean_us", "max_us", "bytes_total")])).alias("size_buckets"))


def measured_classes(log: DataFrame, dim: DataFrame, checksum: bool = False) -> DataFrame:
    """One row for each class of a pass, with the columns of a fingerprint's report."""
    ran = log.where("outcome = 'ok'")
    latency = hdr.hdr_stats(ran, ["fingerprint_id"], F.greatest(F.col("latency_us"), F.lit(1)), hdr.LATENCY_QUANTILES, count="n").drop("n")
    sizes = result_sizes(log).select("fingerprint_id", F.struct("total", "min", "max", "mean", "p50", "p95").alias("result_bytes"))
    out = outcome_counts(log).join(latency, "fingerprint_id", "left").join(sizes, "fingerprint_id", "left").join(decade_lists(size_decades(log)), "fingerprint_id", "left")
    texts = dim.select(F.col("id").alias("fingerprint_id"), F.col("text").alias("fingerprint"))
    out = out.join(texts, "fingerprint_id", "left").withColumn("fingerprint", F.coalesce("fingerprint", F.concat(F.lit("<unknown fingerprint "), F.col("fingerprint_id"), F.lit(">"))))
    if checksum:
        sums = class_checksums(ran).join(texts, "fingerprint_id", "left")
        mark = sums.select("fingerprint_id", F.struct("events", "no_result", "rows_total", "digest", "columns", "shape_varied", F.coalesce(sqltext.is_nondeterministic(F.col("fingerprint")), F.lit(False)).alias("nondeterministic")).alias("checksum"))
        out = out.join(mark, "fingerprint_id", "left")
    else:
        out = out.withColumn("checksum", F.lit(None).cast("struct<events: long, no_result: long, rows_total: long, digest: string, columns: array<string>, shape_varied: boolean, nondeterministic: boolean>"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("p50_us", "p95_us", "p99_us", "max_us")}
    return out.withColumns(zero | {"mean_us": F.coalesce("mean_us", F.lit(0.0)), "size_buckets": F.coalesce("size_buckets", F.array())}).withColumnRenamed("fingerprint_id", "id")


def measured_totals(log: DataFrame) -> DataFrame:
    """A13 over a pass: events, sessions and outcomes."""
    n = lambda what: F.count_if(F.col("outcome") == what)
    return log.agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"), n("ok").alias("executed"), n("skipped").alias("skipped"), n("error").alias("errors"), n("not_run").alias("not_run"))


def lag_stats(log: DataFrame) -> DataFrame:
    """(paced_events, max_lag_us, mean_lag_us) over events that started."""
    lag = F.greatest(F.col("start_us") - F.col("due_us"), F.lit(0))
    out = log.where("start_us IS NOT NULL AND due_us IS NOT NULL").agg(F.count("*").alias("paced_events"), F.max(lag).alias("max_lag_us"), F.avg(lag).alias("mean_lag_us"))
    return out.select("paced_events", F.coalesce("max_lag_us", F.lit(0).cast("long")).alias("max_lag_us"), F.coalesce("mean_lag_us", F.lit(0.0)).alias("mean_lag_us"))


def saturation(intervals: DataFrame, cap: int, tick_us: int = 50_000) -> DataFrame:
    """(samples, saturated_samples, saturated_pct) of ticks at which ``cap`` sessions ran and others waited.

    ``intervals`` has due_us, start_us and end_us of each event. Each interval is laid out over its own ticks, and the ticks are counted.
    """
    span = intervals.agg(F.max("end_us").alias("last"))
    at = lambda a, b, what: intervals.where(F.col(b) > F.col(a)).select(F.explode(F.sequence(F.ceil(F.col(a) / tick_us).cast("long"), F.greatest(F.floor((F.col(b) - 1) / tick_us).cast("long"), F.ceil(F.col(a) / tick_us).cast("long")))).alias("tick"), F.col(a).alias("a"), F.col(b).alias("b"), F.lit(what).alias("what")).where((F.col("tick") * tick_us >= F.col("a")) & (F.col("tick") * tick_us < F.col("b")))
    ticks = at("start_us", "end_us", "runs").unionByName(at("due_us", "start_us", "waits")).groupBy("tick").agg(F.count_if(F.col("what") == "runs").alias("runs"), F.count_if(F.col("what") == "waits").alias("waits"))
    full = ticks.agg(F.count_if((F.col("runs") >= cap) & (F.col("waits") > 0)).alias("saturated_samples"))
    out = span.join(F.broadcast(full)).select((F.floor(F.coalesce("last", F.lit(0)) / tick_us) + F.when(F.col("last") > 0, 1).otherwise(0)).cast("long").alias("samples"), "saturated_samples")
    return out.withColumn("saturated_pct", F.when(F.col("samples") > 0, F.col("saturated_samples") / F.col("samples") * 100).otherwise(0.0))
