import json
import random

import pytest

from tracewright import __main__ as cli
from tracewright.operators import compare, passes, runs
from tracewright.operators import events as ev
from tracewright.plans import render, replay, reports
from tracewright.sources import capture as cap

EVENTS = "ordinal long, ts_micros long, session_id long, user string, db string, query string, orig_query_time_s double"


def capture(spark, tmp_path, queries, name="c"):
    """queries: (session, sql, db), one a millisecond."""
    rows = [(i, 1_700_000_000_000_000 + 1000 * i, s, "web", db, q, 0.001 * (i + 1)) for i, (s, q, db) in enumerate(queries)]
    path = str(tmp_path / f"{name}.jsonl.zst")
    cap.write_capture(spark.createDataFrame(rows, EVENTS), path, "mysql-8.0")
    return cap.read_capture(spark, path, materialize=True)


def outcomes(log):
    return {r.ordinal - min(x.ordinal for x in log if x.ordinal is not None): r.outcome for r in log if r.ordinal is not None}


QUERIES = [(1, "SELECT 1 /* mock: bytes=500 */", None), (2, "DROP TABLE t", None), (1, "SELECT 2 /* mock: bytes=5000 */", None), (3, "SELECT f() /* mock: fails */", None), (3, "SELECT 3", "shop"), (4, "SELECT g() /* mock: hangs up */", None), (4, "SELECT 4", None), (4, "INSERT INTO t VALUES (1)", None), (1, "USE other", None)]


def test_outcomes_of_a_replay(spark, tmp_path):
    c = capture(spark, tmp_path, QUERIES)
    log = replay.run_pass(c.events, replay.MockTarget(), replay.Options()).collect()
    assert outcomes(log) == {0: "ok", 1: "skipped", 2: "ok", 3: "error", 4: "ok", 5: "error", 6: "not_run", 7: "not_run", 8: "ok"}
    by = {r.ordinal: r for r in log}
    assert sorted(r.result_bytes for r in log if r.outcome == "ok") == [8, 9, 500, 5000]
    assert [r.error for r in log if r.outcome == "error" and "fatal" in r.error] == ["mock fatal error"]
    assert len(by) == 9


def test_writes_pool_and_override(spark, tmp_path):
    c = capture(spark, tmp_path, QUERIES)
    got = outcomes(replay.run_pass(c.events, replay.MockTarget(), replay.Options(allow_writes=True, pool=2)).collect())
    assert got == {0: "ok", 1: "ok", 2: "ok", 3: "error", 4: "ok", 5: "error", 6: "ok", 7: "ok", 8: "skipped"}
    got = outcomes(replay.run_pass(c.events, replay.MockTarget(), replay.Options(db_override="d")).collect())
    assert got[8] == "skipped" and got[0] == "ok"


def test_connection_refused_and_abort(spark, tmp_path):
    c = capture(spark, tmp_path, QUERIES)
    log = replay.run_pass(c.events, replay.MockTarget(connects=False), replay.Options()).collect()
    assert sum(r.outcome == "connect_failure" for r in log) == 3
    assert set(outcomes(log).values()) == {"skipped", "not_run"}
    (tmp_path / "stop").write_text("")
    options = replay.Options(abort_uri=f"file://{tmp_path}/stop")
    report, _ = reports.replay_report(c, "c", replay.MockTarget(), options)
    assert report["aborted"] and report["totals"]["executed"] == 0 and report["totals"]["not_run"] == 8


def test_many_sessions_in_order(spark, tmp_path):
    c = capture(spark, tmp_path, [(i % 500, f"SELECT {i}", None) for i in range(2000)])
    log = replay.run_pass(c.events, replay.MockTarget(), replay.Options(max_connections=16)).collect()
    assert len(log) == 2000 and {r.outcome for r in log} == {"ok"}
    last = {}
    for r in sorted(log, key=lambda r: r.start_us):
        assert r.ordinal > last.get(r.session_id, -1)
        last[r.session_id] = r.ordinal


def test_paced_replay(spark, tmp_path):
    c = capture(spark, tmp_path, [(i % 3, f"SELECT {i}", None) for i in range(30)])
    report, _ = reports.replay_report(c, "c", replay.MockTarget(), replay.Options(speed=0.1))
    assert report["pacing"]["paced_events"] == 30 and report["pacing"]["speed"] == 0.1
    assert 0.28 < report["wall_secs"] < 2


def test_passes_and_report(spark, tmp_path):
    c = capture(spark, tmp_path, QUERIES)
    report, each = reports.replay_report(c, "c", replay.MockTarget(), replay.Options(checksum=True, warmup=True, repeat=3))
    assert report["aggregation"] == {"passes": 3, "method": "median"} and len(each) == 3
    assert report["totals"] | {"qps": 0} == {"events": 9, "sessions": 4, "executed": 4, "skipped": 1, "errors": 2, "not_run": 2, "connect_failures": 0, "qps": 0, "filtered": 0}
    one = next(f for f in report["fingerprints"] if f["fingerprint"] == "select ?" and f["count"])
    assert one["count"] == 3 and one["result_bytes"]["total"] == 5508 and [b["bucket"] for b in one["size_buckets"]] == ["<1KB", "1KB-10KB"]
    assert one["checksum"]["events"] == 3 and one["checksum"]["columns"] == ["c"] and not one["checksum"]["nondeterministic"]
    assert {f["checksum"]["digest"] for r in each for f in r["fingerprints"] if f["id"] == one["id"]} == {one["checksum"]["digest"]}
    text = render.run_table(report)
    assert "3 passes" in text and "mock error" in text


def test_duckdb_and_spark_targets(spark, tmp_path):
    import duckdb

    path = str(tmp_path / "d.db")
    with duckdb.connect(path) as con:
        con.execute("CREATE TABLE t AS SELECT i, 'row ' || i AS s FROM range(100) r(i)")
    queries = [(1, "SELECT * FROM t ORDER BY i", None), (1, "SELECT * FROM t ORDER BY i DESC", None), (2, "SELECT * FROM missing", None), (2, "SELECT count(*) FROM t", None)]
    c = capture(spark, tmp_path, queries)
    log = {r.ordinal: r for r in replay.run_pass(c.events, replay.DuckDbTarget(path), replay.Options(checksum=True)).collect()}
    a, b, bad, n = (log[k] for k in sorted(log))
    assert a.digest == b.digest and a.digest_rows == 100 and a.columns == ["i", "s"] and bad.outcome == "error" and n.digest_rows == 1
    spark.range(100).selectExpr("id i", "concat('row ', id) s").createOrReplaceGlobalTempView("t")
    c2 = capture(spark, tmp_path, [(s, q.replace(" t", " global_temp.t"), db) for s, q, db in queries], "c2")
    log2 = {r.ordinal: r for r in replay.run_pass(c2.events, replay.SparkSqlTarget(spark), replay.Options(checksum=True)).collect()}
    assert [log2[k].outcome for k in sorted(log2)] == ["ok", "ok", "error", "ok"]
    assert len({log2[k].digest for k in sorted(log2)[:2]} | {a.digest}) == 1


def test_baseline_report_and_filters(spark, tmp_path):
    c = capture(spark, tmp_path, QUERIES)
    r = reports.baseline_report(c, "c.jsonl.zst")
    assert (r["totals"]["events"], r["wall_secs"], r["totals"]["qps"], r["latency_source"]) == (9, 0.008, 1125.0, "recorded-slow-log")
    assert r["started_at"] == "2023-11-14T22:13:20Z" and r["ended_at"] == "2023-11-14T22:13:20.008Z"
    assert r["fingerprints"][0]["p95_us"] == 9003 or r["fingerprints"][0]["p95_us"] >= 9000
    assert reports.baseline_report(c, "c", ev.Filters(db="shop"))["totals"]["filtered"] == 8
    with pytest.raises(reports.NothingLeft):
        reports.baseline_report(c, "c", ev.Filters(db="none"))


@pytest.mark.parametrize("text", ["5", "a..b", "..", "9..5", "2024-01-01T00:00:00..", "2024-01-02T00:00:00Z..2024-01-01T00:00:00Z"])
def test_bad_windows(text):
    with pytest.raises(ValueError):
        ev.parse_window(text)


def test_windows_and_speeds():
    assert ev.parse_window("2024-01-01T00:00:00.5+01:00..1704067200") == (1704063600500000, 1704067200000000)
    assert ev.parse_window("..7") == (None, 7_000_000)
    assert replay.parse_speed("max") is None and replay.parse_speed("MAX") is None and replay.parse_speed("2.5") == 2.5
    assert [replay.Options(speed=x).speed_label for x in (None, 2.0, 0.5, 1e6)] == ["max", "2", "0.5", "1000000"]
    for text in ("0", "-1", "2x", "inf", "nan", "fast", ""):
        with pytest.raises(ValueError):
            replay.parse_speed(text)


def test_pacing_model_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 3_000_000), rng.randint(0, 5), "u", None, "q", rng.random() / 2) for i in range(400)]
    got = {r.ordinal: r for r in ev.pacing_lag(spark.createDataFrame(rows, EVENTS), 2.0).collect()}
    base, free = min(r[1] for r in rows), {}
    for o, ts, s, *_, secs in rows:
        due = round((ts - base) / 2.0)
        start = max(due, free.get(s, 0))
        free[s] = start + max(1, round(secs * 1e6))
        assert abs(got[o].start_us - start) <= 1 * (o + 1) and got[o].lag_us == got[o].start_us - got[o].due_us


def test_saturation(spark):
    rows = [(0, 0, 200_000), (0, 0, 200_000), (0, 200_000, 400_000), (300_000, 400_000, 500_000)]
    got = runs.saturation(spark.createDataFrame(rows, "due_us long, start_us long, end_us long"), 2).first()
    assert (got.samples, got.saturated_samples) == (11, 4) and abs(got.saturated_pct - 400 / 11) < 1e-9


def fp(text, count, p95, errors=0, buckets=(), size=None, checksum=None):
    out = {"id": 0, "fingerprint": text, "count": count, "errors": errors, "skipped": 0, "not_run": 0, "p50_us": p95 // 2, "p95_us": p95, "p99_us": p95, "max_us": p95, "mean_us": p95 / 2}
    out["size_buckets"] = [{"bucket": b, "count": n, "p50_us": p, "p95_us": p, "mean_us": float(p), "max_us": p, "bytes_total": n} for b, n, p in buckets]
    if size:
        out["result_bytes"] = {"total": size * count, "min": size, "max": size, "mean": float(size), "p50": size, "p95": size}
    if checksum:
        out["checksum"] = {"events": checksum[1], "no_result": 0, "rows_total": checksum[2], "digest": checksum[0], "columns": ["a"], "shape_varied": False, "nondeterministic": checksum[3]}
    return out


def run(classes, **more):
    flags = {"max_connections": 50, "allow_writes": False, "read_only": False, "speed": "max", "checksum": True, "warmup": False}
    totals = {"events": 1, "sessions": 1, "executed": 100, "skipped": 0, "errors": 0, "not_run": 0, "connect_failures": 0, "qps": 50.0, "filtered": 0}
    return {"tool": "t", "tool_version": "1", "capture_file": "c", "capture_dialect": "mysql-8.0", "latency_source": "replayed", "target_url": "u", "target_server_version": "5.7.42", "started_at": "", "ended_at": "", "wall_secs": 2.0, "aborted": False, "flags": flags | more.pop("flags", {}), "totals": totals | more.pop("totals", {}), "saturation": {"samples": 0, "saturated_samples": 0, "saturated_pct": 0.0}, "target_settings": {"sql_mode": "a", "same": "x"}, "fingerprints": classes} | more


BASE = [fp("orders", 50, 10_000, size=100), fp("users", 50, 1000), fp("audit", 20, 500), fp("sessions", 30, 8000), fp("vars", 10, 1000, buckets=[("1KB-10KB", 5, 100), ("<1KB", 5, 900)], size=2000), fp("rare", 2, 10), fp("legacy", 9, 10), fp("zero", 10, 0), fp("same", 10, 70, checksum=("aa", 10, 5, False)), fp("diff", 10, 70, checksum=("bb", 10, 5, False)), fp("adv", 10, 70, checksum=("cc", 10, 5, True)), fp("pop", 10, 70, checksum=("dd", 9, 5, False))]
CAND = [fp("orders", 50, 30_000, size=150), fp("users", 50, 1300), fp("audit", 10, 1200, errors=3), fp("sessions", 30, 4000), fp("vars", 10, 1050, buckets=[("1KB-10KB", 5, 300), ("<1KB", 5, 910), (">=100MB", 9, 1)], size=2000), fp("rare", 2, 99), fp("new <x>", 4, 10), fp("zero", 10, 5), fp("same", 10, 70, checksum=("aa", 10, 5, False)), fp("diff", 10, 70, checksum=("b2", 10, 9, False)), fp("adv", 10, 70, checksum=("c2", 10, 5, False)), fp("pop", 10, 70, checksum=("d2", 10, 5, False))]


def test_comparison(spark, tmp_path, capsys):
    a, b = str(tmp_path / "a.json"), str(tmp_path / "b.json")
    reports.write_report(run(BASE), a)
    reports.write_report(run(CAND, target_server_version="5.5.5-10.11.2-MariaDB", capture_file="d", flags={"speed": "2", "pool": 4}, totals={"qps": 35.0}, target_settings={"sql_mode": "b", "same": "x", "only": "y"}), b)
    assert cli.main(["compare", a, b, "--json", str(tmp_path / "o.json"), "--html", str(tmp_path / "o.html")]) == 2
    r = json.loads((tmp_path / "o.json").read_text())
    names = lambda k: [x["fingerprint"] for x in r[k]]
    assert names("regressions") == ["zero", "orders", "audit", "users"]
    assert [round(x["p95"]["delta_pct"]) for x in r["regressions"][1:]] == [200, 140, 30]
    assert names("improvements") == ["sessions"] and names("low_sample") == ["rare"]
    assert sorted(names("stable")) == ["adv", "diff", "pop", "same", "vars"]
    assert [(x["fingerprint"], x["bucket"], x["p95"]["delta_pct"]) for x in r["size_regressions"]] == [("vars", "1KB-10KB", 200.0)] and r["size_buckets_checked"] == 2
    assert names("only_in_baseline") == ["legacy"] and names("only_in_candidate") == ["new <x>"]
    assert [s["name"] for s in r["settings_diff"]] == ["only", "sql_mode"] and [f["name"] for f in r["flag_diff"]] == ["speed", "pool"]
    assert (r["correctness"]["checked"], r["correctness"]["matched"]) == (4, 1)
    assert [x["fingerprint"] for x in r["correctness"]["mismatches"]] == ["diff"] and sorted(x["fingerprint"] for x in r["correctness"]["advisory"]) == ["adv", "pop"]
    assert r["count_mismatches"] == 1 and r["totals"]["qps_delta_pct"] == -30.0 and r["exit_code"] == 2
    w = r["comparability_warnings"]
    assert len(w) == 8 and w[0].startswith("capture files") and w[-1].startswith("RESULT MISMATCH")
    page = (tmp_path / "o.html").read_text()
    assert "new &lt;x&gt;" in page and "FAIL" in page and "http" not in page
    assert "orders" in capsys.readouterr().out
    assert cli.main(["compare", a, a]) == 0
    assert cli.main(["compare", a, b, "--threshold-pct", "1000", "--min-count", "60"]) == 2


def test_recorded_against_replayed(spark, tmp_path):
    a, b = str(tmp_path / "a.json"), str(tmp_path / "b.json")
    reports.write_report(run([fp("x", 10, 100)], latency_source="recorded-slow-log", target_settings={}, flags={"checksum": False, "max_connections": 0}), a)
    reports.write_report(run([fp("x", 10, 110, size=5)], flags={"checksum": False}), b)
    r = render.comparison_report(compare.Comparison(cap.read_run(spark, a), cap.read_run(spark, b)))
    assert [w.split(":")[0] for w in r["comparability_warnings"]] == ["MEASUREMENT PLANES"]
    assert "settings_note" in r and "size_note" in r and not r["flag_diff"] and r["exit_code"] == 0
    assert "correctness" not in r


def test_medians(spark):
    rows = [("a", v) for v in (3, 1, 8, 6)] + [("b", 5)]
    got = {r.k: r.m for r in spark.createDataFrame(rows, "k string, v long").groupBy("k").agg(passes.median_long(passes.F.col("v")).alias("m")).collect()}
    assert got == {"a": 4, "b": 5}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "s.log").write_text("# User@Host: u[u] @ h []  Id: 7\n# Query_time: 0.5  Lock_time: 0\nSET timestamp=1700000000;\nSELECT 1;\n# User@Host: u[u] @ h []  Id: 8\n# Query_time: 0.25\nSET timestamp=1700000001;\nDELETE FROM t;\n")
    c, b, r = (str(tmp_path / x) for x in ("c.jsonl.zst", "b.json", "r.json"))
    assert cli.main(["capture", "--input", str(tmp_path / "s.log"), "--out", c, "--format", "slowlog"]) == 0
    assert cli.main(["baseline", "--capture", c, "--out", b]) == 0
    assert cli.main(["replay", "--capture", c, "--out", r, "--url", "mock", "--repeat", "2"]) == 0
    assert cli.main(["replay", "--capture", c, "--url", "mock", "--speed", "max", "--read-only"]) == 0
    assert json.loads((tmp_path / "r.json").read_text())["flags"]["speed"] == "max"
    assert json.loads((tmp_path / "r.pass2.json").read_text())["totals"]["skipped"] == 1
    assert cli.main(["compare", b, r]) in (0, 2)
    assert cli.main(["baseline", "--capture", c, "--out", b, "--filter-db", "none"]) == 1
    assert "2 events, 2 sessions, 2 classes" in capsys.readouterr().out


class _Server:
    """As much of a MySQL connection as settings need."""

    variables = {"sql_mode": "STRICT", "tx_isolation": "READ-COMMITTED", "innodb_buffer_pool_size": 128}

    def cursor(self):
        return self

    def execute(self, sql):
        self.sql = sql

    def fetchall(self):
        name = self.sql.split("'")[1]
        return [(k, v) for k, v in self.variables.items() if k == name]

    def fetchone(self):
        return ("8.0.36",)

    def close(self):
        pass


def test_settings_of_a_mysql_server():
    target = replay.MySqlTarget(_Server)
    assert target.settings() == {"sql_mode": "STRICT", "innodb_buffer_pool_size": "128", "transaction_isolation": "READ-COMMITTED"}
    assert target.version() == "8.0.36"


def test_descriptors():
    assert replay.descriptors_left(1) is None
    assert "file descriptors" in replay.descriptors_left(1 << 60)


@pytest.mark.parametrize("bad", [["--allow-writes", "--read-only"], ["--pool", "2", "--max-connections", "3"], ["--speed", "0"], ["--repeat", "0"], ["--pool", "0"]])
def test_options_that_do_not_go_together(bad, capsys):
    with pytest.raises(SystemExit) as e:
        cli._parser().parse_args(["replay", "--capture", "c", "--url", "mock", *bad])
    assert e.value.code == 2


def test_a_url_is_needed_and_may_be_a_server(spark, monkeypatch):
    with pytest.raises(SystemExit):
        cli._parser().parse_args(["replay", "--capture", "c"])
    made = []

    class Driver(_Server):
        @staticmethod
        def connect(**settings):
            made.append(settings)
            return Driver()

        def autocommit(self, on):
            made.append(on)

    import sys

    monkeypatch.setitem(sys.modules, "pymysql", Driver)
    target = cli._target(spark, "mysql://root:p%40s:s@db.example:3307/shop")
    assert isinstance(target, replay.MySqlTarget) and target.version() == "8.0.36"
    assert made[:2] == [{"host": "db.example", "port": 3307, "user": "root", "password": "p@s:s", "database": "shop"}, True]
    assert target.fatal(Exception(2013, "lost")) and not target.fatal(Exception(1064, "syntax"))
    with pytest.raises(ValueError, match=r"\*\*\*"):
        cli._target(spark, "postgres://u:secret@h/d")


def test_reports_hold_no_password(spark, tmp_path):
    c = capture(spark, tmp_path, QUERIES)
    report, _ = reports.replay_report(c, "c", replay.MockTarget(), replay.Options(), "mysql://u:s3cret@h:1/d")
    assert report["target_url"] == "mysql://u:***@h:1/d" and "s3cret" not in json.dumps(report)


def test_writes_are_never_run_twice(spark, tmp_path):
    """A task whose partition has been started before fails, whichever attempt it is; another pass is another matter."""
    marks = f"file://{tmp_path}/marks"
    replay._once(marks, 0, 3)
    replay._once(marks, 0, 4)
    replay._once(marks, 1, 3)
    with pytest.raises(RuntimeError, match="not run again"):
        replay._once(marks, 0, 3)
    c = capture(spark, tmp_path, QUERIES)
    log = replay.run_pass(c.events, replay.MockTarget(), replay.Options(allow_writes=True, max_connections=2))
    assert log.count() == log.count() == 9  # the log is written: reading it runs nothing


class _Dying(replay.MockTarget):
    """Writes down each statement, and dies at the third."""

    def __init__(self, path):
        super().__init__()
        self.path = path

    def connect(self):
        outer = self

        class Conn(replay.Connection):
            def query(self, sql):
                with open(outer.path, "a+") as f:
                    f.write(sql + "\n")
                    f.seek(0)
                    if len(f.readlines()) == 3:
                        import os

                        os._exit(1)
                return 1

            def query_checksum(self, sql):
                return None

        return Conn()


def test_a_task_that_dies_does_not_repeat_its_writes(spark, tmp_path):
    path = str(tmp_path / "statements")
    c = capture(spark, tmp_path, [(1, f"INSERT INTO t VALUES ({i})", None) for i in range(6)])
    with pytest.raises(Exception, match=r"(?i)worker|not run again|crash"):
        replay.run_pass(c.events, _Dying(path), replay.Options(allow_writes=True, max_connections=1))
    assert len(open(path).read().splitlines()) == 3


def test_all_connections_are_used():
    assert [50 // 8 + (p < 50 % 8) for p in range(8)] == [7, 7, 6, 6, 6, 6, 6, 6]
