"""Capture files and run reports.

A capture file is zstd-compressed JSON lines: a header, events, and a summary with the texts of their classes. It is an interchange format; the
native store of events is Parquet (``operators.events.write_events``).
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright import __version__, schemas
from tracewright.operators import events as ev
from tracewright.storage import open_output

FORMAT_VERSION = 1


class CaptureError(ValueError):
    """A file is not a whole capture."""


@dataclass
class Capture:
    """``events`` in order of ``ordinal``, the ``dim`` of classes, and the summary."""

    events: DataFrame
    dim: DataFrame
    header: dict
    summary: dict


def records(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, raw, r): the parsed lines of a capture, blank ones left out; r is null where a line is not JSON."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("raw")).where(F.trim("raw") != "")
    return lines.withColumn("r", F.from_json("raw", schemas.RECORD, {"mode": "PERMISSIVE"}))


def read_capture(spark: SparkSession, path: str, materialize: bool = False) -> Capture:
    """Reads and checks a capture; one pass over the lines does the checks. A compressed file is one task, and so its lines are in order."""
    rows = records(spark, path)
    if materialize:
        rows = rows.cache()
    kind = F.col("r.type")
    bad = F.col("r").isNull() | ~F.coalesce(kind.isin("header", "event", "summary"), F.lit(False)) | ((kind == "event") & (F.col("r.query").isNull() | F.col("r.ts_micros").isNull() | F.col("r.session_id").isNull()))
    seen = rows.agg(
        F.min(F.when(bad, F.col("line_no"))).alias("bad"),
        F.min_by("r", F.when(kind == "header", F.col("line_no"))).alias("header"),
        F.max_by("r", F.when(kind == "summary", F.col("line_no"))).alias("summary"),
        F.count_if(kind == "event").alias("events"),
        F.min(F.when(kind == "event", F.col("line_no"))).alias("first_event"),
        F.min(F.when(kind == "header", F.col("line_no"))).alias("header_at"),
    ).first()
    if seen.bad is not None:
        raise CaptureError(f"{path}: line {rows.where(F.col('line_no') <= seen.bad).count()} is malformed")
    if seen.header is None or (seen.first_event is not None and seen.header_at > seen.first_event):
        raise CaptureError(f"{path}: no header")
    if seen.header.version != FORMAT_VERSION:
        raise CaptureError(f"{path}: version {seen.header.version} is not supported")
    if seen.summary is None:
        raise CaptureError(f"{path}: no summary; the capture may be cut short")
    if seen.summary.event_count != seen.events:
        raise CaptureError(f"{path}: {seen.events} events where the summary tells of {seen.summary.event_count}")
    found = rows.where("r.type = 'event'").select(F.col("line_no").alias("ordinal"), *[F.col(f"r.{c.split()[0]}") for c in schemas.EVENT.split(", ")])
    dim = rows.where("r.type = 'summary'").select(F.explode("r.fingerprints").alias("f")).select("f.id", "f.text")
    header = {k: seen.header[k] for k in ("version", "tool_version", "created_at")}
    summary = {k: seen.summary[k] for k in ("source_dialect", "event_count", "session_count", "admin_commands_ignored", "server_restarts_seen")}
    summary["pcap"] = seen.summary.pcap.asDict(True) if seen.summary.pcap else None
    return Capture(found, dim, header, summary)


def write_capture(events: DataFrame, path: str, source_dialect: str = "unknown", admin_commands: int = 0, restarts: int = 0, pcap: dict | None = None) -> dict:
    """K1: writes ``events`` (without ids) as a capture file at a path or URI, in order of ordinal, and returns the summary.

    Classes are numbered in the cluster; lines then stream through the driver, a partition at a time, as the format is one file.
    """
    named, classes = ev.classified(events)
    dim = [r.asDict() for r in classes.orderBy("id").collect()]
    counted = ev.capture_summary(events).first()
    summary = {"source_dialect": source_dialect, "event_count": counted.event_count, "session_count": counted.session_count, "admin_commands_ignored": admin_commands, "server_restarts_seen": restarts}
    if pcap:
        summary["pcap"] = pcap
    columns = [c.split()[0] for c in schemas.EVENT.split(", ")]
    lines = named.orderBy("ordinal").select(F.to_json(F.struct(F.lit("event").alias("type"), *columns)).alias("line"))
    with pa.CompressedOutputStream(open_output(path), "zstd") as out:
        say = lambda x: out.write(json.dumps(x, ensure_ascii=False).encode() + b"\n")
        say({"type": "header", "version": FORMAT_VERSION, "tool_version": __version__, "created_at": datetime.now(UTC).isoformat().replace("+00:00", "Z")})
        for row in lines.toLocalIterator(prefetchPartitions=True):
            out.write(row.line.encode() + b"\n")
        say({"type": "summary"} | summary | {"fingerprints": dim})
    return summary | {"fingerprints": dim}


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """A run report as one row; what older reports lack has its default."""
    run = spark.read.schema(schemas.RUN).option("multiLine", True).json(path)
    classes = F.transform("fingerprints", lambda f: f.withField("size_buckets", F.coalesce(f["size_buckets"], F.array().cast(f"array<{schemas.SIZE_BUCKET}>"))).withField("errors", F.coalesce(f["errors"], F.lit(0).cast("long"))))
    flags = F.col("flags")
    for f in ("allow_writes", "read_only", "checksum", "warmup"):
        flags = flags.withField(f, F.coalesce(F.col(f"flags.{f}"), F.lit(False)))
    return run.withColumns(
        {
            "latency_source": F.coalesce("latency_source", F.lit(schemas.REPLAYED)),
            "target_server_version": F.coalesce("target_server_version", F.lit("")),
            "aborted": F.coalesce("aborted", F.lit(False)),
            "flags": flags,
            "totals": F.col("totals").withField("filtered", F.coalesce("totals.filtered", F.lit(0).cast("long"))),
            "target_settings": F.coalesce("target_settings", F.create_map().cast("map<string,string>")),
            "fingerprints": F.coalesce(classes, F.array().cast(f"array<struct<{schemas.FINGERPRINT_REPORT}>>")),
        }
    )

