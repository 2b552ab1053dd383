"""The command line: capture, replay, baseline and compare."""

from __future__ import annotations

import argparse
import signal
import sys

from pyspark.sql import SparkSession

from tracewright.functions.scalars import redact_url_text
from tracewright.operators import events as ev
from tracewright.operators.compare import MIN_COUNT, THRESHOLD_PCT, Comparison
from tracewright.plans import render, replay, reports
from tracewright.sources import capture as cap
from tracewright.sources import slowlog


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("tracewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _positive(text: str) -> int:
    if (n := int(text)) < 1:
        raise argparse.ArgumentTypeError(f"{text} is not at least 1")
    return n


def _speed(text: str) -> float | None:
    try:
        return replay.parse_speed(text)
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from e


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewright", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("capture", help="a slow log or packet capture as a capture file")
    c.add_argument("--input", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--format", choices=("auto", "slowlog", "pcap"), default="auto")
    c.add_argument("--dialect")
    c.add_argument("--port", type=int, default=3306)
    for name in ("replay", "baseline"):
        r = sub.add_parser(name)
        r.add_argument("--capture", required=True)
        r.add_argument("--out", required=name == "baseline")
        r.add_argument("--filter-db")
        r.add_argument("--filter-user")
        r.add_argument("--time-window")
        r.add_argument("--top", type=int, default=10)
        if name == "replay":
            r.add_argument("--url", "--target", dest="target", required=True, help="mysql://user:password@host:port/db, duckdb:PATH, spark, or mock")
            cap_or_pool = r.add_mutually_exclusive_group()
            cap_or_pool.add_argument("--max-connections", type=_positive, default=50)
            cap_or_pool.add_argument("--pool", type=_positive)
            gate = r.add_mutually_exclusive_group()
            gate.add_argument("--allow-writes", action="store_true")
            gate.add_argument("--read-only", action="store_true", help="which is the default")
            r.add_argument("--spool-dir", help="taken and not needed: the spool is a shuffle, which lies in spark.local.dir")
            r.add_argument("--db-override")
            r.add_argument("--speed", type=_speed, default="max", help="max, or a positive factor of the recorded pace")
            r.add_argument("--checksum", action="store_true")
            r.add_argument("--warmup", action="store_true")
            r.add_argument("--repeat", type=_positive, default=1)
    d = sub.add_parser("compare")
    d.add_argument("baseline")
    d.add_argument("candidate")
    d.add_argument("--threshold-pct", type=float, default=THRESHOLD_PCT)
    d.add_argument("--min-count", type=int, default=MIN_COUNT)
    d.add_argument("--top", type=int, default=10)
    d.add_argument("--json")
    d.add_argument("--html")
    return p


def _filters(a) -> ev.Filters:
    return ev.Filters(a.filter_db, a.filter_user, ev.parse_window(a.time_window) if a.time_window else (None, None))


def _target(spark: SparkSession, text: str) -> replay.Target:
    kind, _, rest = text.partition(":")
    if kind == "spark":
        return replay.SparkSqlTarget(spark)
    if kind == "duckdb":
        return replay.DuckDbTarget(rest or ":memory:")
    if kind == "mock":
        return replay.MockTarget()
    if kind == "mysql":
        return replay.MySqlTarget.at(text)
    raise ValueError(f"no such target: {redact_url_text(text)}")


def _capture(spark: SparkSession, a) -> int:
    from tracewright.sources import pcap

    if a.format == "pcap" or (a.format == "auto" and pcap.looks_like_pcap(a.input)):
        found = pcap.read_capture_file(spark, a.input, a.port)
        made = cap.write_capture(found.events, a.out, a.dialect or "mysql-wire", pcap=found.counters)
        warnings = found.warnings
    else:
        rows = slowlog.read_slowlog(spark, a.input, a.dialect).cache()
        end = rows.where("kind = 'summary'").first()
        made = cap.write_capture(slowlog.events_of(rows), a.out, end.source_dialect, end.admin_commands_ignored, end.server_restarts_seen)
        warnings = []
    print(f"{made['event_count']} events, {made['session_count']} sessions, {len(made['fingerprints'])} classes, {made['source_dialect']}")
    for w in warnings:
        print(f"warning: {w}")
    return render.EXIT_OK


def _replay(spark: SparkSession, a) -> int:
    options = replay.Options(a.max_connections, a.allow_writes, a.db_override, a.speed, a.checksum, a.pool, a.warmup, a.repeat, _filters(a), a.time_window, replay.abort_file(spark), a.read_only)

    if warning := replay.descriptors_left(a.pool or a.max_connections):
        print(f"warning: {warning}", file=sys.stderr)

    def stop(*_):
        from pyarrow import fs

        signal.signal(signal.SIGINT, lambda *_: sys.exit(render.EXIT_ABORTED))  # a second signal does not wait
        files, path = fs.FileSystem.from_uri(options.abort_uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        files.open_output_stream(path).close()

    signal.signal(signal.SIGINT, stop)
    signal.signal(signal.SIGTERM, stop)
    report, each = reports.replay_report(cap.read_capture(spark, a.capture), a.capture, _target(spark, a.target), options, a.target)
    if a.out:
        reports.write_report(report, a.out)
    if a.out and len(each) > 1:
        for k, r in enumerate(each, 1):
            reports.write_report(r, reports.pass_path(a.out, k))
    print(render.run_table(report, a.top))
    return render.EXIT_ABORTED if report["aborted"] else render.EXIT_OK


def _baseline(spark: SparkSession, a) -> int:
    report = reports.baseline_report(cap.read_capture(spark, a.capture), a.capture, _filters(a), a.time_window)
    reports.write_report(report, a.out)
    print(render.run_table(report, a.top))
    return render.EXIT_OK


def _compare(spark: SparkSession, a) -> int:
    report = render.comparison_report(Comparison(cap.read_run(spark, a.baseline), cap.read_run(spark, a.candidate), a.threshold_pct, a.min_count))
    print(render.comparison_text(report, a.top))
    for path, text in ((a.json, render.to_json), (a.html, render.comparison_html)):
        if path:
            with open(path, "w", encoding="utf-8") as f:
                f.write(text(report))
    return report["exit_code"]


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    try:
        return {"capture": _capture, "replay": _replay, "baseline": _baseline, "compare": _compare}[a.command](_session(), a)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return render.EXIT_ERROR


if __name__ == "__main__":
    sys.exit(main())
