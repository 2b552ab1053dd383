"""Queries over what is made of the driver's tables first: packet captures, capture files, replays and run reports, each with its SQL.

``events`` is turned into the bytes of packets, into the lines of a capture, into statements that a target without a server answers as they
say, and into reports. What the engine reads back is held against SQL over ``events`` itself.
"""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright import queries as base
from tracewright.functions import scalars
from tracewright.operators import compare, passes
from tracewright.plans import render, replay, reports
from tracewright.queries import CAPTURE, CLASS, PAIR, capture, query
from tracewright.sources import capture as cap
from tracewright.sources import mysql_wire as wire
from tracewright.sources import pcap, slowlog
from tracewright.storage import shared_path

# --- packets --------------------------------------------------------------------------------------------------------------------------
# A user is a connection. By user_id % 10: 0 to 5 send texts, 6 executes a prepared statement, 7 is encrypted, 8 began before the capture, and
# 9 changes its database. Some requests come in two segments, the second first and the first again; some packets are cut or fragments.

PLAIN = wire.PROTOCOL_41 | wire.SECURE | wire.WITH_DB
PORT = 3306


def be(c: Column, n: int) -> Column:
    """``n`` bytes, the most significant first."""
    return F.unhex(F.lpad(F.hex(c.cast("long")), 2 * n, "0"))


def le(c: Column, n: int) -> Column:
    return F.concat(*[be(F.shiftright(c.cast("long"), 8 * k).bitwiseAND(F.lit(255).cast("long")), 1) for k in range(n)])


def text(*parts: Column) -> Column:
    return F.concat(*parts).cast("binary")


def message(number: int, payload: Column) -> Column:
    return F.concat(le(F.octet_length(payload), 3), F.lit(bytes([number])), payload)


def request(command: int, *payload: Column) -> Column:
    return message(0, F.concat(F.lit(bytes([command])), *payload))


def _messages(e: DataFrame) -> DataFrame:
    """(u, step, side, flags, ts, payload, cut) of each connection, in its order."""
    u, i = F.col("u"), F.col("i")
    greeting = message(0, F.concat(F.lit(b"\x0a8.0.36\0"), le(u % 300 + 1, 4), F.lit(b"x" * 8 + b"\0\xff\xff\x21\0\0\xff\xff")))
    flags = F.when(u % 10 == 7, PLAIN | wire.SSL).otherwise(PLAIN).cast("long")
    login = message(1, F.concat(le(flags, 4), le(F.lit(1 << 24), 4), F.lit(b"\x21" + b"\0" * 23), text(F.lit("u"), u % 5), F.lit(b"\0\x02abshop\0")))
    ok = lambda n: message(n, F.lit(b"\0\0\0\2\0\0\0"))
    prepare, prepared = request(wire.PREPARE, F.lit(b"SELECT v FROM t WHERE a = ? AND b = ?")), message(1, F.lit(b"\0\1\0\0\0\0\0\2\0\0\0\0"))
    empty = F.lit(b"")
    opening = [(wire.CLIENT, 2, empty), (wire.SERVER, 18, empty), (wire.SERVER, 16, greeting), (wire.CLIENT, 16, login), (wire.SERVER, 16, ok(2)), (wire.CLIENT, 16, F.when(u % 10 == 6, prepare).otherwise(empty)), (wire.SERVER, 16, F.when(u % 10 == 6, prepared).otherwise(empty))]
    users = e.groupBy("u").agg(F.min("ts").alias("ts")).where("u % 10 <> 8")
    steps = F.array(*[F.struct(F.lit(k - 100).cast("long").alias("step"), F.lit(s).alias("side"), F.lit(f).alias("flags"), p.alias("payload")) for k, (s, f, p) in enumerate(opening)])
    first = users.select("u", "ts", F.explode(steps).alias("x")).select("u", "x.step", "x.side", "x.flags", "ts", "x.payload", F.lit(0).alias("cut"), F.lit(0).cast("long").alias("i"))
    said = F.when(u % 10 == 9, request(wire.INIT_DB, text(F.col("e")))).when(
        u % 10 == 6, request(wire.EXECUTE, F.lit(b"\1\0\0\0\0\1\0\0\0\0\1\3\0\xfd\0"), le(i, 4), be(F.octet_length("e"), 1), text(F.col("e")))
    ).otherwise(request(wire.QUERY, text(F.lit("SELECT c"), i, F.lit(" FROM "), F.col("e"), F.lit(" WHERE k = '"), u, F.lit("'"))))
    order = W.partitionBy("u").orderBy("i")
    pair = F.array(
        F.struct((F.row_number().over(order) * 2).cast("long").alias("step"), F.lit(wire.CLIENT).alias("side"), said.alias("payload"), F.lit(0).alias("cut"), F.col("ts")),
        F.struct((F.row_number().over(order) * 2 + 1).cast("long").alias("step"), F.lit(wire.SERVER).alias("side"), ok(1).alias("payload"), F.when(i % 50 == 0, 9).otherwise(0).alias("cut"), (F.col("ts") + 1000 + i % 5000).alias("ts")),
    )
    asked = e.withColumn("x", pair).select("u", "i", F.explode("x").alias("x")).select("u", "x.step", "x.side", F.lit(16).alias("flags"), "x.ts", "x.payload", "x.cut", "i")
    return first.unionByName(asked)


def _records(spark: SparkSession, d: str) -> DataFrame:
    """(file, u, step, part, record): the records of four capture files."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("e"), F.col("event_id").alias("i"), F.col("user_id").alias("u"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    m = _messages(e)
    before = W.partitionBy("u", "side").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    m = m.withColumn("size", F.octet_length("payload")).withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    half = F.floor(F.col("size") / 2).cast("int")
    part = lambda start, data: F.struct(start.cast("long").alias("skip"), data.alias("data"))
    one, front, back = part(F.lit(0), F.col("payload")), part(F.lit(0), F.expr("substring(payload, 1, size div 2)")), part(half, F.expr("substring(payload, size div 2 + 1)"))
    parts = F.when((F.col("side") == wire.CLIENT) & (F.col("u") % 10 < 6) & (F.col("step") > 0) & (F.col("i") % 4 == 0), F.array(back, front, front)).otherwise(F.array(one))
    s = m.select("u", "step", "side", "flags", "ts", "cut", "at", F.posexplode(parts).alias("part", "x")).select("*", "x.skip", "x.data")
    client, ports = F.col("side") == wire.CLIENT, (be(F.col("u") % 40_000 + 20_000, 2), be(F.lit(PORT), 2))
    start = F.when(F.col("flags") == 2, 1000).when(F.col("flags") == 18, 9000).when(client, F.col("at") + F.col("skip") + 1001).otherwise(F.col("at") + F.col("skip") + 9001)
    tcp = F.concat(F.when(client, ports[0]).otherwise(ports[1]), F.when(client, ports[1]).otherwise(ports[0]), be(start, 4), F.lit(b"\0\0\0\0\x50"), be(F.col("flags"), 1), F.lit(b"\0\x64\0\0\0\0"), F.col("data"))
    here, there = F.concat(F.lit(b"\x0a\x01"), be(F.col("u") % 65_536, 2)), F.lit(b"\x0a\0\0\2")
    ends = F.concat(F.when(client, here).otherwise(there), F.when(client, there).otherwise(here))
    ip = F.concat(F.lit(b"\x45\0"), be(F.octet_length(tcp) + 20, 2), F.lit(b"\0\0\0\0\x40\6\0\0"), ends, tcp)
    segments = s.select("u", "step", "part", "ts", "cut", ip.alias("ip"))
    users = e.groupBy("u").agg(F.min("ts").alias("ts"))
    other = users.where("u % 10 < 3").select("u", F.lit(-200).cast("long").alias("step"), F.lit(0).alias("part"), "ts", F.lit(0).alias("cut"), F.concat(F.lit(b"\x45\0\0\x24\0\0\x20\0\x40\6\0\0"), here, there, F.lit(b"\0" * 16)).alias("ip"))
    web = users.where("u % 10 = 4").select("u", F.lit(-199).cast("long").alias("step"), F.lit(0).alias("part"), "ts", F.lit(0).alias("cut"), F.concat(F.lit(b"\x45\0\0\x2a\0\0\0\0\x40\6\0\0"), here, there, F.lit(b"\x1f\x90\0\x50" + b"\0" * 8 + b"\x50\x10\0\x64\0\0\0\0hi")).alias("ip"))
    frame = F.concat(F.lit(b"\0" * 12 + b"\x08\0"), F.col("ip"))
    record = F.concat(le(F.expr("ts div 1000000"), 4), le(F.expr("ts % 1000000"), 4), le(F.octet_length(frame), 4), le(F.octet_length(frame) + F.col("cut"), 4), frame)
    return segments.unionByName(other).unionByName(web).select(F.concat(F.lit("f"), F.col("u") % 4).alias("file"), "u", "step", "part", record.alias("record"))


def _parsed(records: pa.Table) -> pa.Table:
    """The packets of one file."""
    records = records.sort_by([("u", "ascending"), ("step", "ascending"), ("part", "ascending")])
    head = b"\xd4\xc3\xb2\xa1\2\0\4\0" + b"\0" * 8 + b"\xff\xff\0\0\1\0\0\0"
    rows = list(pcap.rows_of(io.BytesIO(head + b"".join(records.column("record").to_pylist())), PORT, records.column("file")[0].as_py()))
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in pcap.PACKET.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def packets(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).groupBy("file").applyInArrow(_parsed, pcap.PACKET)


READABLE = "user_id % 10 NOT IN (7, 8)"
SESSIONS = f"""conns AS (SELECT user_id, user_id % 300 + 1 AS thread, row_number() OVER (PARTITION BY user_id % 300 ORDER BY user_id % 4, user_id) AS nth FROM (SELECT DISTINCT user_id FROM events WHERE {READABLE})),
sessions AS (SELECT user_id, CASE WHEN nth = 1 THEN thread ELSE {pcap.SYNTHETIC} + (SELECT count(*) FROM conns o WHERE o.nth > 1 AND (o.user_id % 4, o.user_id) < (conns.user_id % 4, conns.user_id)) END AS session_id FROM conns)"""


@query(f"""WITH {SESSIONS}, said AS (SELECT *, CASE user_id % 10 WHEN 9 THEN 'USE `' || event_type || '`' WHEN 6 THEN 'SELECT v FROM t WHERE a = ' || event_id || ' AND b = ''' || event_type || '''' ELSE 'SELECT c' || event_id || ' FROM ' || event_type || ' WHERE k = ''' || user_id || '''' END AS query FROM events WHERE {READABLE})
SELECT row_number() OVER (ORDER BY user_id % 4, user_id, event_id) - 1 AS ordinal, epoch_us(ts) AS ts_micros, session_id, 'u' || user_id % 5 AS "user", CASE WHEN user_id % 10 = 9 THEN event_type ELSE 'shop' END AS db, query, (1000 + event_id % 5000) / 1e6::DOUBLE AS orig_query_time_s FROM said JOIN sessions USING (user_id)""")
def pcap_events(spark, d):
    """What clients said, out of the bytes of packets."""
    return pcap.events_of(pcap.decode(packets(spark, d)))


@query(f"""WITH u AS (SELECT DISTINCT user_id FROM events)
SELECT count(*) AS connections, count(*) FILTER (WHERE user_id % 10 NOT IN (7, 8)) AS connections_decoded, count(*) FILTER (WHERE user_id % 10 = 7) AS connections_tls_skipped, count(*) FILTER (WHERE user_id % 10 = 8) AS connections_midstream_skipped,
  count(*) FILTER (WHERE user_id % 10 < 3) AS ip_fragments_skipped, (SELECT count(*) FROM events WHERE event_id % 50 = 0) AS truncated_packets, (SELECT count(*) FROM events WHERE user_id % 10 = 6) AS statements_expanded, 0::BIGINT AS responses_missing,
  (SELECT sum(CASE WHEN user_id % 10 < 6 AND event_id % 4 = 0 THEN 4 ELSE 2 END)::BIGINT FROM events) + 7 * count(*) FILTER (WHERE user_id % 10 <> 8) AS packets FROM u""")
def pcap_counters(spark, d):
    """A15."""
    read = packets(spark, d)
    counted = pcap.counters(read, pcap.decode(read))
    names = ("connections", "connections_decoded", "connections_tls_skipped", "connections_midstream_skipped", "ip_fragments_skipped", "truncated_packets", "statements_expanded", "responses_missing", "packets")
    return spark.createDataFrame([tuple(counted[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), w AS (SELECT 0 AS place, count(*) FILTER (WHERE user_id % 10 = 7) || ' connections were encrypted and could not be read' AS warning FROM u
UNION ALL SELECT 1, count(*) FILTER (WHERE user_id % 10 = 8) || ' connections began before the capture, or are not MySQL' FROM u UNION ALL SELECT 2, (SELECT count(*) FROM events WHERE event_id % 50 = 0) || ' packets were cut short; capture whole packets'
UNION ALL SELECT 3, count(*) FILTER (WHERE user_id % 10 < 3) || ' IP fragments were left out' FROM u) SELECT * FROM w""")
def pcap_warnings(spark, d):
    """C13."""
    read = packets(spark, d)
    return spark.createDataFrame(list(enumerate(pcap.warnings(pcap.counters(read, pcap.decode(read))))), "place int, warning string")


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'mysql-8.0' WHEN 1 THEN 'mariadb' WHEN 2 THEN 'mysql-5.7' ELSE 'chosen' END AS source_dialect, 1::BIGINT AS restarts FROM nation")
def slowlog_dialects(spark, d):
    """The dialect that a log's banner tells of, unless one is given."""
    n = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey")

    def tell(batches):
        for b in batches:
            rows = []
            for k in b.column("n_nationkey").to_pylist():
                version = ("8.0.%d", "10.6.%d-MariaDB", "5.7.%d", "8.0.%d")[k % 4] % k
                lines = [f"/usr/sbin/mysqld, Version: {version} (Source). started with:", "Tcp port: 3306  Unix socket: /tmp/s", "Time                 Id Command    Argument", "# Query_time: 0.1", "SET timestamp=1700000000;", "SELECT 1;"]
                end = list(slowlog.parse_lines(lines, "chosen" if k % 4 == 3 else None))[-1]
                rows.append((k, end["source_dialect"], end["server_restarts_seen"]))
            keys, found, restarts = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(found), pa.array(restarts, pa.int64())], ["n_nationkey", "source_dialect", "restarts"])

    return n.select(F.col("n_nationkey").cast("long").alias("n_nationkey")).mapInArrow(tell, "n_nationkey long, source_dialect string, restarts long")


# --- capture files, replays ------------------------------------------------------------------------------------------------------------


def _stored(spark: SparkSession, d: str) -> cap.Capture:
    """The derived capture, written as a file and read again."""
    path = f"{shared_path(spark, 'capture')}.jsonl.zst"
    cap.write_capture(capture(spark, d), path, "mysql-8.0")
    return cap.read_capture(spark, path)


@query("""WITH {CAPTURE}, dim AS (SELECT row_number() OVER (ORDER BY min(ordinal)) - 1 AS id, fingerprint FROM cap GROUP BY fingerprint)
SELECT row_number() OVER (ORDER BY ordinal) - 1 AS place, ts_micros, session_id, "user", db, query, orig_query_time_s, id AS fingerprint_id, fingerprint FROM cap JOIN dim USING (fingerprint)""")
def capture_round_trip(spark, d):
    """A capture file holds what was written, in order, with ids of classes."""
    c = _stored(spark, d)
    named = c.events.join(c.dim.select(F.col("id").alias("fingerprint_id"), F.col("text").alias("fingerprint")), "fingerprint_id")
    return named.withColumn("place", F.row_number().over(W.orderBy("ordinal")) - 1).drop("ordinal")


def _told(spark: SparkSession, d: str) -> DataFrame:
    """Statements that say what becomes of them, by event_id."""
    c = capture(spark, d).select("ordinal", "ts_micros", "session_id", "user", F.lit(None).cast("string").alias("db"), "orig_query_time_s", F.lit(0).cast("long").alias("fingerprint_id"))
    i = F.col("ordinal")
    mark = F.when(i % 97 == 5, "hangs up").when(i % 11 == 0, "fails").when(i % 13 == 0, "no result").otherwise(F.concat(F.lit("bytes="), i % 5000, F.lit(", row=r"), i % 3))
    return c.withColumn("query", F.concat(F.when(i % 6 == 2, "DELETE FROM t WHERE i = ").when(i % 50 == 1, "USE db").otherwise("SELECT "), i, F.lit(" /* mock: "), mark, F.lit(" */")))


TOLD = """told AS (SELECT event_id AS ordinal, user_id AS session_id, event_id % 6 = 2 AS writes, event_id % 50 = 1 AND event_id % 6 <> 2 AS uses, event_id % 97 = 5 AS fatal, event_id % 97 <> 5 AND event_id % 11 = 0 AS fails,
  event_id % 97 <> 5 AND event_id % 11 <> 0 AND event_id % 13 = 0 AS blank FROM events)"""


@query(f"""WITH {TOLD}, lost AS (SELECT session_id, min(ordinal) AS lost FROM told WHERE fatal AND NOT writes GROUP BY session_id)
SELECT ordinal, CASE WHEN ordinal > lost THEN 'not_run' WHEN writes THEN 'skipped' WHEN fatal OR fails THEN 'error' ELSE 'ok' END AS outcome, CASE WHEN ordinal > lost OR writes THEN NULL WHEN fatal THEN 'mock fatal error' WHEN fails THEN 'mock error' END AS error FROM told LEFT JOIN lost USING (session_id)""")
def replay_outcomes(spark, d):
    """Sessions on connections of their own; a lost connection ends its session."""
    return replay.run_pass(_told(spark, d), replay.MockTarget(), replay.Options(max_connections=11)).select("ordinal", "outcome", "error")


@query(f"""WITH {TOLD} SELECT ordinal, CASE WHEN uses THEN 'skipped' WHEN fatal OR fails THEN 'error' ELSE 'ok' END AS outcome, CASE WHEN NOT uses AND NOT fatal AND NOT fails AND NOT blank THEN ordinal % 5000 END AS bytes FROM told""")
def replay_pooled(spark, d):
    """On a pool, with writes; a lost connection is replaced, and USE is not run."""
    log = replay.run_pass(_told(spark, d), replay.MockTarget(), replay.Options(pool=7, allow_writes=True))
    return log.select("ordinal", "outcome", F.when(F.col("ordinal") % 13 != 0, F.col("result_bytes")).alias("bytes"))


@query(f"""WITH {TOLD}, lost AS (SELECT session_id, min(ordinal) AS lost FROM told WHERE fatal GROUP BY session_id)
SELECT CASE WHEN writes THEN 'none' WHEN blank THEN 'none' ELSE 'r' || ordinal % 3 END AS result, count(*) AS events, CASE WHEN writes OR blank THEN 0 ELSE 1 END::BIGINT AS digests, sum(CASE WHEN writes OR blank THEN 0 ELSE 1 END)::BIGINT AS rows
FROM told LEFT JOIN lost USING (session_id) WHERE NOT fatal AND NOT fails AND (lost IS NULL OR ordinal < lost) GROUP BY ALL""")
def replay_checksums(spark, d):
    """Reads have a checksum, the same for the same rows; writes have none."""
    log = replay.run_pass(_told(spark, d), replay.MockTarget(), replay.Options(checksum=True, allow_writes=True)).where("outcome = 'ok'")
    i = F.col("ordinal")
    result = F.when((i % 6 == 2) | (i % 13 == 0), "none").otherwise(F.concat(F.lit("r"), i % 3))
    return log.groupBy(result.alias("result")).agg(F.count("*").alias("events"), F.count_distinct("digest").alias("digests"), F.coalesce(F.sum("digest_rows"), F.lit(0).cast("long")).alias("rows"))


# --- run reports -----------------------------------------------------------------------------------------------------------------------


def _read_back(spark: SparkSession, report: dict) -> DataFrame:
    path = f"{shared_path(spark, 'run')}.json"
    reports.write_report(report, path)
    return cap.read_run(spark, path)


@query("""WITH {CAPTURE}, t AS (SELECT * FROM cap WHERE "user" = 'u2')
SELECT 'recorded-slow-log' AS latency_source, count(*) AS events, count(DISTINCT session_id) AS sessions, (SELECT count(*) FROM cap) - count(*) AS filtered, (max(ts_micros) - min(ts_micros)) / 1e6::DOUBLE AS wall_secs, count(DISTINCT fingerprint) AS classes, 'u2' AS filter_user, false AS read_only FROM t""")
def run_report_round_trip(spark, d):
    """A report of recorded latencies, written and read again."""
    report = reports.baseline_report(_stored(spark, d), "c", base.events.Filters(user="u2"))
    return _read_back(spark, report).select("latency_source", "totals.events", "totals.sessions", "totals.filtered", "wall_secs", F.size("fingerprints").cast("long").alias("classes"), "flags.filter_user", "flags.read_only")


def _run(spark: SparkSession, d: str, side: str) -> dict:
    """A report of the derived classes of one side; a class's checksum is told by its name."""
    rows = []
    for r in base._classes(spark, d, side).collect():  # a row for each class
        row = reports._plain(r)
        digest = f"d{len(row['fingerprint'])}" + ("x" if side == "c" and row["fingerprint"].startswith("purchase") else "")
        row["checksum"] = {"events": row["count"], "no_result": 0, "rows_total": 1, "digest": digest, "columns": ["a"], "shape_varied": False, "nondeterministic": "odd" in row["fingerprint"]}
        rows.append(row)
    totals = {"events": sum(r["count"] + r["errors"] for r in rows), "sessions": 1, "executed": sum(r["count"] for r in rows), "skipped": 0, "errors": sum(r["errors"] for r in rows), "not_run": 0, "connect_failures": 0, "qps": 50.0 if side == "b" else 40.0, "filtered": 0}
    flags = {"max_connections": 50, "allow_writes": False, "read_only": False, "speed": "max" if side == "b" else "2", "checksum": True, "warmup": False} | ({"pool": 4} if side == "c" else {})
    return {"tool": "t", "tool_version": "1", "capture_file": "a", "capture_dialect": "mysql-8.0", "latency_source": "replayed", "target_url": "u", "target_server_version": "8.0.36", "started_at": "", "ended_at": "", "wall_secs": 2.0, "aborted": side == "c", "flags": flags, "totals": totals, "saturation": {"samples": 10, "saturated_samples": 4, "saturated_pct": 40.0}, "target_settings": {"sql_mode": side, "same": "x"}, "fingerprints": rows}


def _compared(spark: SparkSession, d: str) -> dict:
    b, c = (_read_back(spark, _run(spark, d, side)) for side in ("b", "c"))
    return render.comparison_report(compare.Comparison(b, c))


CHECKED = (
    base.DELTAS
    + ", k AS (SELECT fingerprint, NOT starts_with(fingerprint, 'purchase') AS same, contains(fingerprint, 'odd') AS nd, baseline_count AS be, candidate_count AS ce FROM v WHERE baseline_count > 0 AND candidate_count > 0), s AS (SELECT CASE WHEN same THEN 'matched' WHEN nd OR be <> ce THEN 'advisory' ELSE 'mismatch' END AS status FROM k)"
    + ", n AS (SELECT (SELECT count(*) FROM b WHERE fingerprint NOT IN (SELECT fingerprint FROM c)) AS ob, (SELECT count(*) FROM c WHERE fingerprint NOT IN (SELECT fingerprint FROM b)) AS oc, (SELECT count(*) FROM v WHERE count_mismatch) AS cm, (SELECT count(*) FROM s WHERE status = 'mismatch') AS mm)"
)


@query(CHECKED + """, w AS (SELECT 0 AS place, 'flag --speed differs: max and 2' AS warning UNION ALL SELECT 1, 'flag --pool differs: <none> and 4' UNION ALL SELECT 2, 'the candidate run was aborted; its numbers are partial' UNION ALL SELECT 3, 'settings differ: sql_mode'
UNION ALL SELECT 4, ob || ' classes are in the baseline only, ' || oc || ' in the candidate only' FROM n WHERE ob + oc > 0 UNION ALL SELECT 5, cm || ' classes were executed a different number of times' FROM n WHERE cm > 0 UNION ALL SELECT 6, 'RESULT MISMATCH: ' || mm || ' deterministic classes returned different data' FROM n WHERE mm > 0)
SELECT (row_number() OVER (ORDER BY place) - 1)::INT AS place, warning FROM w""")
def comparison_warnings(spark, d):
    """C5 to C7, C9 to C11, in their order, of reports that were written and read again."""
    return spark.createDataFrame(list(enumerate(_compared(spark, d)["comparability_warnings"])), "place int, warning string")


@query(CHECKED + """ SELECT (SELECT count(*) FROM v WHERE verdict = 'regressed') AS regressions, (SELECT count(*) FROM v WHERE verdict = 'improved') AS improvements, (SELECT count(*) FROM v WHERE verdict = 'stable') AS stable, (SELECT count(*) FROM v WHERE verdict = 'low_sample') AS low_sample,
  ob AS only_in_baseline, oc AS only_in_candidate, cm AS count_mismatches, mm AS mismatches, (SELECT count(*) FROM s WHERE status = 'advisory') AS advisory, -20.0::DOUBLE AS qps_delta_pct, 2::BIGINT AS exit_code, true AS in_text, true AS in_page FROM n""")
def comparison_documents(spark, d):
    """K3, K4, K6: the JSON read back, and what the text and the page say of it."""
    report = _compared(spark, d)
    path = f"{shared_path(spark, 'comparison')}.json"
    with cap.open_output(path) as f:
        f.write(render.to_json(report).encode())
    one = "struct<fingerprint: string>"
    kinds = ", ".join(f"{k} array<{one}>" for k in ("regressions", "improvements", "stable", "low_sample", "only_in_baseline", "only_in_candidate")) + f", correctness struct<mismatches: array<{one}>, advisory: array<{one}>>, totals struct<qps_delta_pct: double>, count_mismatches long, exit_code long"
    page, said = render.comparison_html(report), render.comparison_text(report, 1000)
    names = [r["fingerprint"] for k in ("regressions", "improvements") for r in report[k]]
    held = lambda where, shape: F.lit("FAIL" in where and all(shape(n) in where for n in names))
    n = lambda c: F.size(c).cast("long")
    j = spark.read.schema(kinds).option("multiLine", True).json(path)
    return j.select(
        *[n(k).alias(k) for k in ("regressions", "improvements", "stable", "low_sample", "only_in_baseline", "only_in_candidate")], "count_mismatches", n("correctness.mismatches").alias("mismatches"), n("correctness.advisory").alias("advisory"),
        "totals.qps_delta_pct", "exit_code", held(said, str).alias("in_text"), held(page, str).alias("in_page"),
    )


@query("SELECT n_nationkey, CASE WHEN n_nationkey * 4 >= 20 THEN 'all ' || CASE WHEN n_nationkey % 2 = 0 THEN 50 ELSE 8 END || ' connections were taken while sessions waited in ' || n_nationkey || ' of 25 samples (' || n_nationkey * 4 || '%): ' || CASE WHEN n_nationkey % 2 = 0 THEN '--max-connections' ELSE '--pool' END || ' may have limited this run, not the server' END AS warning FROM nation")
def saturation_warnings(spark, d):
    """C12."""
    rows = []
    for (k,) in spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long")).collect():  # 25 rows at every scale
        run = {"saturation": {"samples": 25, "saturated_samples": k, "saturated_pct": k * 4.0}, "flags": {"max_connections": 50, "pool": 8 if k % 2 else None}}
        rows.append((k, render.saturation_warning(run)))
    return spark.createDataFrame(rows, "n_nationkey long, warning string")


@query("""WITH p AS (SELECT event_id % 3 AS pass, event_type AS fingerprint, count(*) AS n FROM events GROUP BY ALL)
SELECT fingerprint, CASE WHEN fingerprint < 'e' THEN 'same' ELSE 'd0' END AS digest, fingerprint >= 'e' AS nondeterministic, list_sort(list(n))[2] AS count FROM p GROUP BY fingerprint""")
def pass_checksums(spark, d):
    """The first pass's checksum; one that varies between passes marks its class."""
    e = spark.read.parquet(f"{d}/events.parquet")
    each = e.groupBy((F.col("event_id") % 3).cast("int").alias("pass"), F.col("event_type").alias("fingerprint")).agg(F.count("*").alias("count"))
    digest = F.when(F.col("fingerprint") < "e", "same").otherwise(F.concat(F.lit("d"), F.col("pass")))
    zero = F.lit(0).cast("long")
    mark = F.struct(F.col("count").alias("events"), zero.alias("no_result"), zero.alias("rows_total"), digest.alias("digest"), F.array(F.lit("a")).alias("columns"), F.lit(False).alias("shape_varied"), F.lit(False).alias("nondeterministic"))
    sizes = F.lit(None).cast("struct<total: long, min: long, max: long, mean: double, p50: long, p95: long>")
    each = each.withColumns({c: zero for c in ("id", "errors", "skipped", "not_run", "p50_us", "p95_us", "p99_us", "max_us")} | {"mean_us": F.lit(0.0), "first_error": F.lit(None).cast("string"), "checksum": mark, "result_bytes": sizes})
    return passes.median_classes(each).select("fingerprint", "checksum.digest", "checksum.nondeterministic", "count")


RUNS = """runs AS (SELECT event_id % 4 AS pass, count(*) AS executed, count(*) FILTER (WHERE event_type = 'error') AS errors, max(value) AS wall_secs, sum(value) / count(*) AS qps, max(event_id) AS max_lag_us FROM events GROUP BY 1)"""


@query(f"""WITH {RUNS} SELECT 4::BIGINT AS passes, true AS aborted, {", ".join(f"(list_sort(list({c}))[2] + (list_sort(list({c}))[3] - list_sort(list({c}))[2]) // 2)::BIGINT AS {c}" for c in ("executed", "errors", "max_lag_us"))}, median(wall_secs) AS wall_secs, median(qps) AS qps, 'run 0' AS capture_file, 'end 3' AS ended_at FROM runs""")
def pass_runs(spark, d):
    """The run of several passes; it is aborted if one was, and paced if all were."""
    e = spark.read.parquet(f"{d}/events.parquet").groupBy((F.col("event_id") % 4).cast("int").alias("pass")).agg(F.count("*").alias("executed"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("value").alias("wall_secs"), (F.sum("value") / F.count("*")).alias("qps"), F.max("event_id").alias("max_lag_us"))
    zero, none = F.lit(0).cast("long"), F.lit("")
    totals = F.struct(*[F.col(c) if c in ("executed", "errors", "qps") else zero.alias(c) for c in ("events", "sessions", "executed", "skipped", "errors", "not_run", "connect_failures", "qps", "filtered")])
    frame = e.select(
        "pass", none.alias("tool"), none.alias("tool_version"), F.concat(F.lit("run "), F.col("pass")).alias("capture_file"), none.alias("capture_dialect"), none.alias("latency_source"), none.alias("target_url"), none.alias("target_server_version"),
        none.alias("started_at"), F.concat(F.lit("end "), F.col("pass")).alias("ended_at"), "wall_secs", (F.col("pass") == 2).alias("aborted"), F.struct(F.lit(1).alias("x")).alias("flags"), F.create_map(none, none).alias("target_settings"), totals.alias("totals"),
        F.struct(zero.alias("samples"), zero.alias("saturated_samples"), F.lit(0.0).alias("saturated_pct")).alias("saturation"), F.struct(F.lit(2.0).alias("speed"), zero.alias("paced_events"), F.col("max_lag_us"), F.lit(0.0).alias("mean_lag_us")).alias("pacing"),
    )
    return passes.median_runs(frame).select("aggregation.passes", "aborted", "totals.executed", "totals.errors", "pacing.max_lag_us", "wall_secs", "totals.qps", "capture_file", "ended_at")


# --- texts of errors, bytes ------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN strlen(text) <= 300 THEN text ELSE substr(text, 1, list_max(list_filter(range(0, 301), lambda k: strlen(substr(text, 1, k)) <= 300))) || '…' END AS text FROM documents")
def truncate_bytes(spark, d):
    """At most 300 bytes, cut between characters."""

    def cut(batches):
        for b in batches:
            yield b.set_column(1, "text", pa.array([scalars.truncate_bytes(t) for t in b.column("text").to_pylist()], pa.string()))

    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(cut, "doc_id long, text string")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '''' || o_orderstatus || o_orderkey || '''' ELSE 'X''FF' || hex(encode(o_orderstatus || o_orderkey)) || '''' END AS literal FROM orders")
def bytes_literal(spark, d):
    """Bytes that are UTF-8 as a text, others in hex."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    data = F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).cast("binary")
    return o.select("o_orderkey", scalars.bytes_literal(F.when(F.col("o_orderkey") % 2 == 0, data).otherwise(F.concat(F.lit(b"\xff"), data))).alias("literal"))
