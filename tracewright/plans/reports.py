"""Run reports: recorded baselines, replays of one or more passes, and their files."""

from __future__ import annotations

import json
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright import __version__, schemas
from tracewright.functions.scalars import redact_url_text
from tracewright.operators import events as ev
from tracewright.operators import passes, runs
from tracewright.plans import replay as rp
from tracewright.sources.capture import Capture
from tracewright.storage import open_output

TOOL = "tracewright"
FLAGS = ("max_connections", "allow_writes", "read_only", "db_override", "speed", "checksum", "pool", "warmup", "filter_db", "filter_user", "time_window")


def rfc3339(us: int) -> str:
    t = datetime.fromtimestamp(us // 1_000_000, UTC).strftime("%Y-%m-%dT%H:%M:%S")
    part = f"{us % 1_000_000:06d}".rstrip("0")
    return f"{t}.{part}Z" if part else f"{t}Z"


def _flags(options: rp.Options) -> dict:
    f = options.filters
    values = (options.max_connections, options.allow_writes, options.read_only, options.db_override, options.speed_label, options.checksum, options.pool, options.warmup, f.db, f.user, options.window_text)
    return dict(zip(FLAGS, values, strict=True))


def _plain(row) -> dict:
    return {k: v for k, v in row.asDict(recursive=True).items() if v is not None}


def _classes(df: DataFrame) -> list[dict]:
    """The classes of a report, the slowest first: a row for each, so a table that the driver can hold."""
    out = [_plain(r) for r in runs.ranked(df).collect()]
    for c in out:
        if not c.get("size_buckets"):
            c.pop("size_buckets", None)
    return out


class NothingLeft(ValueError):
    """The filters leave no event."""


def baseline_report(capture: Capture, path: str, filters: ev.Filters | None = None, window_text: str | None = None) -> dict:
    """A report of the latencies that a capture recorded."""
    filters = filters or ev.Filters()
    kept = filters.apply(capture.events)
    counts = ev.filtered_totals(capture.events, filters).first()
    if not counts.events and counts.filtered:
        raise NothingLeft("no event passes the filters")
    stats = runs.recorded_classes(kept)
    named = ev.with_text(stats, capture.dim).withColumnRenamed("fingerprint_id", "id")
    blank = {"errors": F.lit(0), "skipped": F.lit(0), "not_run": F.lit(0)}
    total = runs.recorded_totals(kept).first()
    span = kept.agg(F.min("ts_micros").alias("a"), F.max("ts_micros").alias("b")).first()
    options = rp.Options(max_connections=0, filters=filters, window_text=window_text)
    return {
        "tool": TOOL,
        "tool_version": __version__,
        "capture_file": path,
        "capture_dialect": capture.summary["source_dialect"],
        "latency_source": schemas.RECORDED,
        "target_url": "",
        "target_server_version": "",
        "started_at": rfc3339(span.a or 0),
        "ended_at": rfc3339(span.b or 0),
        "wall_secs": total.wall_secs,
        "aborted": False,
        "flags": _flags(options),
        "totals": {"events": total.events, "sessions": total.sessions, "executed": total.events, "skipped": 0, "errors": 0, "not_run": 0, "connect_failures": 0, "qps": total.qps, "filtered": counts.filtered},
        "saturation": {"samples": 0, "saturated_samples": 0, "saturated_pct": 0.0},
        "target_settings": {},
        "fingerprints": _classes(named.withColumns(blank)),
    }


def pass_report(log: DataFrame, dim: DataFrame, options: rp.Options, identity: dict, started: float, ended: float, filtered: int) -> dict:
    """The report of one pass from its log."""
    done = log.where("ordinal IS NOT NULL")
    total = runs.measured_totals(done).first().asDict()
    span = log.agg(F.min("start_us").alias("a"), F.max(F.col("start_us") + F.coalesce("latency_us", F.lit(0))).alias("b"), F.count_if(F.col("outcome") == "connect_failure").alias("failed")).first()
    wall = (span.b - span.a) / 1e6 if span.a is not None else max(0.0, ended - started)
    ran = done.where("start_us IS NOT NULL").select(F.greatest(F.coalesce("due_us", "start_us"), F.lit(0)).alias("due_us"), F.greatest("start_us", F.lit(0)).alias("start_us"), (F.greatest("start_us", F.lit(0)) + F.coalesce("latency_us", F.lit(1))).alias("end_us"))
    busy = runs.saturation(ran, options.pool or options.max_connections).first()
    pacing = {"pacing": {"speed": options.speed} | runs.lag_stats(done).first().asDict()} if options.speed else {}
    aborted = rp._Abort(options.abort_uri)()
    return identity | {
        "started_at": rfc3339(round(started * 1e6)),
        "ended_at": rfc3339(round(ended * 1e6)),
        "wall_secs": wall,
        "aborted": aborted,
        "flags": _flags(options),
        "totals": total | {"connect_failures": span.failed, "qps": total["executed"] / wall if wall else 0.0, "filtered": filtered},
        "saturation": busy.asDict(),
        **pacing,
        "fingerprints": _classes(runs.measured_classes(done, dim, options.checksum)),
    }


def median_report(spark: SparkSession, reports: list[dict]) -> dict:
    """The report of several passes."""
    kinds = f"pass int, {schemas.RUN}"
    names = [f.name for f in spark.createDataFrame([], schemas.RUN).schema]
    rows = [json.dumps({"pass": i} | r) for i, r in enumerate(reports)]
    frame = spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", kinds).alias("r")).select("r.*")
    one = passes.median_runs(frame).first().asDict(recursive=True)
    each = frame.select("pass", F.explode("fingerprints").alias("f")).select("pass", "f.*").withColumn("size_buckets", F.coalesce("size_buckets", F.array().cast(f"array<{schemas.SIZE_BUCKET}>")))
    decades = passes.median_decades(each).groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.struct("decade", "bucket", "count", "p50_us", "p95_us", "mean_us", "max_us", "bytes_total"))).alias("x"))
    listed = decades.select("fingerprint", F.transform("x", lambda d: F.struct(*[d[c].alias(c) for c in ("bucket", "count", "p50_us", "p95_us", "mean_us", "max_us", "bytes_total")])).alias("size_buckets"))
    classes = _classes(passes.median_classes(each).join(listed, "fingerprint", "left"))
    return {k: v for k, v in ((k, one.get(k)) for k in names if k != "fingerprints") if v is not None} | {"fingerprints": classes}


def replay_report(capture: Capture, path: str, target: rp.Target, options: rp.Options, url: str = "") -> tuple[dict, list[dict]]:
    """Warm-up and measured passes; the report, the median's if there are several, and those of the passes."""
    spark = capture.events.sparkSession
    counts = ev.filtered_totals(capture.events, options.filters).first()
    if not counts.events and counts.filtered:
        raise NothingLeft("no event passes the filters")
    identity = {
        "tool": TOOL,
        "tool_version": __version__,
        "capture_file": path,
        "capture_dialect": capture.summary["source_dialect"],
        "latency_source": schemas.REPLAYED,
        "target_url": redact_url_text(url),
        "target_server_version": target.version(),
        "target_settings": target.settings(),
    }
    if options.warmup:
        rp.run_pass(capture.events, target, options, -1)
    made: list[dict] = []
    for i in range(options.repeat):
        began = time.time()
        log = rp.run_pass(capture.events, target, options, i)
        made.append(pass_report(log, capture.dim, options, identity, began, time.time(), counts.filtered))
        if made[-1]["aborted"]:
            break
    return (made[0] if len(made) == 1 else median_report(spark, made)), made


def write_report(report: dict, path: str) -> None:
    """K2."""
    with open_output(path) as f:
        f.write(json.dumps(report, indent=2, ensure_ascii=False).encode() + b"\n")


def pass_path(path: str, k: int) -> str:
    """K2: where the report of pass ``k``, from 1, goes beside the aggregated one."""
    return f"{path.removesuffix('.json')}.pass{k}.json"
