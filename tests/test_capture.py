import json

import pyarrow as pa
import pytest

from tracewright.sources import capture as C

EVENTS = "ordinal long, ts_micros long, session_id long, user string, db string, query string, orig_query_time_s double"
ROWS = [(i, 1_700_000_000_000_000 + i, i % 3, None if i % 2 else "web", "shop" if i % 4 else None, f"SELECT {i} FROM t{i % 2} WHERE x = 'é{i}'", 0.001 * i) for i in range(50)]


def zst(path, lines):
    with pa.CompressedOutputStream(pa.OSFile(str(path), "wb"), "zstd") as out:
        out.write("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines).encode())
    return str(path)


HEADER = {"type": "header", "version": 1, "tool_version": "x", "created_at": "now"}
EVENT = {"type": "event", "ts_micros": 5, "session_id": 1, "query": "SELECT 1", "orig_query_time_s": 0.5, "fingerprint_id": 0}
SUMMARY = {"type": "summary", "source_dialect": "mysql-8.0", "event_count": 1, "session_count": 1, "admin_commands_ignored": 0, "server_restarts_seen": 0, "fingerprints": [{"id": 0, "text": "select ?"}]}


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "c.jsonl.zst")
    made = C.write_capture(spark.createDataFrame(ROWS, EVENTS).repartition(4), path, "mysql-8.0", 2, 1)
    assert (made["event_count"], made["session_count"]) == (50, 3)
    assert made["fingerprints"] == [{"id": 0, "text": "select ? from t0 where x = ?"}, {"id": 1, "text": "select ? from t1 where x = ?"}]
    got = C.read_capture(spark, path, materialize=True)
    rows = got.events.orderBy("ordinal").collect()
    assert [(r.ts_micros, r.session_id, r.user, r.db, r.query, r.orig_query_time_s) for r in rows] == [r[1:] for r in ROWS]
    assert [r.fingerprint_id for r in rows] == [i % 2 for i in range(50)]
    assert got.summary["admin_commands_ignored"] == 2 and got.header["version"] == 1 and got.dim.count() == 2


def test_optional_columns_and_blank_lines(spark, tmp_path):
    got = C.read_capture(spark, zst(tmp_path / "a.jsonl.zst", [HEADER, "", EVENT, "  ", SUMMARY]))
    assert got.events.first().user is None and got.summary["pcap"] is None


@pytest.mark.parametrize("lines,word", [([HEADER | {"version": 9}, EVENT, SUMMARY], "version"), ([HEADER, "{not json", EVENT, SUMMARY], "line 2"), ([HEADER, {"type": "event"}, SUMMARY], "line 2"), ([EVENT, SUMMARY], "header"), ([HEADER, EVENT], "summary"), ([HEADER, EVENT, EVENT, SUMMARY], "2 events"), ([HEADER, {"type": "other"}, SUMMARY], "line 2")])
def test_broken_captures(spark, tmp_path, lines, word):
    with pytest.raises(C.CaptureError, match=word):
        C.read_capture(spark, zst(tmp_path / "b.jsonl.zst", lines))


def test_old_run_report(spark, tmp_path):
    run = {"tool": "t", "capture_file": "c", "capture_dialect": "d", "flags": {"max_connections": 5}, "totals": {"events": 1}, "fingerprints": [{"id": 0, "fingerprint": "select ?", "count": 1, "p95_us": 7, "mean_us": 7.0}]}
    (tmp_path / "r.json").write_text(json.dumps(run, indent=1))
    got = C.read_run(spark, str(tmp_path / "r.json")).first()
    assert (got.latency_source, got.totals.filtered, got.flags.checksum, got.aborted, got.target_settings) == ("replayed", 0, False, False, {})
    assert got.fingerprints[0].size_buckets == [] and got.fingerprints[0].checksum is None
