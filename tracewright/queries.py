"""Queries of the workload operators over the driver's tables, each with SQL that another engine can check.

The tables hold no query log, so ``capture`` derives one from ``events``, by the same rules in both engines. Its statements come from
templates whose class is known, so the SQL spells out what fingerprinting has to find.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions import hdr, scalars, sqltext
from tracewright.operators import checksums, compare, events, passes, runs
from tracewright.sources import slowlog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: (statement, class, read, nondeterministic) by event_id % 6; e: event_type, i: event_id, u: user_id.
TEMPLATES = (
    ("'SELECT * FROM ' || e || ' WHERE id = ' || i || ' AND k IN (' || u || ', ' || i % 7 || ')'", "'select * from ' || e || ' where id = ? and k in (?+)'", True, False),
    ("'select `Name`  from ' || e || ' /* hint ' || i || ' */ where note = ''it''''s #' || i || ''' -- tail'", "'select `name` from ' || e || ' where note = ?'", True, False),
    ("'INSERT INTO ' || e || ' VALUES (' || i || ', ''x''), (-' || u || ', .5)'", "'insert into ' || e || ' values (?+)'", False, False),
    ("'SELECT ' || e || '1.c FROM ' || e || '1 LIMIT ' || i % 9", "'select ' || e || '1.c from ' || e || '1 limit ?'", True, True),
    ("'USE db' || i % 3 || ';'", "'use db' || i % 3", True, False),
    ("'UPDATE ' || e || ' SET v = -' || i || ' WHERE t < now(); SELECT 1;'", "'update ' || e || ' set v = ? where t < now(); select ?'", False, True),
)


def _case(at: int, engine: str) -> str:
    values = [t[at] if isinstance(t[at], str) else str(t[at]).upper() for t in TEMPLATES]
    out = "CASE i % 6 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"
    if engine == "spark":  # a quote in a literal is doubled in one engine, and has a backslash in the other
        out = re.sub(r"'((?:[^']|'')*)'", lambda m: "'" + m[1].replace("''", "\\'") + "'", out)
    return out


def capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived capture: ``schemas.ORDERED_EVENT`` without ids of classes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("*", F.col("event_type").alias("e"), F.col("event_id").alias("i"), F.col("user_id").alias("u"))
    return e.select(
        F.col("event_id").alias("ordinal"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_micros"),
        F.col("user_id").alias("session_id"),
        F.concat(F.lit("u"), F.col("user_id") % 5).alias("user"),
        F.when(F.col("event_type").isin("purchase", "signup"), "shop").alias("db"),
        F.expr(_case(0, "spark")).alias("query"),
        (F.col("value") / 1000).alias("orig_query_time_s"),
    )


CAPTURE = f"""cap AS (
  SELECT i AS ordinal, epoch_us(ts) AS ts_micros, u AS session_id, 'u' || u % 5 AS "user", CASE WHEN e IN ('purchase', 'signup') THEN 'shop' END AS db,
    {_case(0, "duckdb")} AS query, value / 1000 AS orig_query_time_s, {_case(1, "duckdb")} AS fingerprint, {_case(2, "duckdb")} AS reads, {_case(3, "duckdb")} AS volatile, i % 6 = 4 AS uses
  FROM (SELECT *, event_type AS e, event_id AS i, user_id AS u FROM events)
)"""
MICROS = "greatest(round(orig_query_time_s * 1e6)::BIGINT, 1)"


def cells_sql(source: str, keys: str, value: str, digits: int = 3) -> str:
    """Histogram cells with running counts: (keys, cell, n, upto, every)."""
    bits, most = hdr.BITS[digits], hdr.MOST[digits]
    return f"""(SELECT {keys}, cell, n, sum(n) OVER (PARTITION BY {keys} ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY {keys}) AS every, k FROM (
      SELECT {keys}, ((v >> k) + 1 << k) - 1 AS cell, any_value(k) AS k, count(*) AS n FROM (
        SELECT *, greatest(length(bin(v)) - {bits}, 0) AS k FROM (SELECT *, least({value}, {most}) AS v FROM {source})) GROUP BY {keys}, cell))"""


def quantile_sql(q: float, name: str) -> str:
    return f"min(CASE WHEN upto >= greatest(ceil({q}::DOUBLE * every), 1) THEN cell END)::BIGINT AS {name}"


STATS = ", ".join([quantile_sql(0.5, "p50_us"), quantile_sql(0.95, "p95_us"), quantile_sql(0.99, "p99_us"), "max(cell)::BIGINT AS max_us", "sum(n * (cell - (1 << k) + 1 + ((1 << k) >> 1)))::DOUBLE / sum(n) AS mean_us"])


def query(sql: str | None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.replace("{CAPTURE}", CAPTURE).replace("{MICROS}", MICROS).replace("{STATS}", STATS)
        return f

    return add


# --- text -------------------------------------------------------------------------------------------------------------------------


@query("WITH {CAPTURE} SELECT ordinal, fingerprint FROM cap")
def fingerprint_text(spark, d):
    return capture(spark, d).select("ordinal", sqltext.fingerprint(F.col("query")).alias("fingerprint"))


@query("WITH {CAPTURE} SELECT ordinal, CASE WHEN reads THEN 'read' ELSE 'write' END AS class, uses AS is_use, reads AS executes FROM cap")
def classify_text(spark, d):
    q = F.col("query")
    return capture(spark, d).select("ordinal", sqltext.classify(q).alias("class"), sqltext.is_use(q).alias("is_use"), sqltext.should_execute(q, False).alias("executes"))


@query("WITH {CAPTURE} SELECT DISTINCT fingerprint, volatile AS nondeterministic FROM cap")
def nondeterministic_text(spark, d):
    named = capture(spark, d).select(sqltext.fingerprint(F.col("query")).alias("fingerprint")).distinct()
    return named.select("fingerprint", sqltext.is_nondeterministic(F.col("fingerprint")).alias("nondeterministic"))


# --- filters, classes, sessions ------------------------------------------------------------------------------------------------------


@query("WITH {CAPTURE} SELECT ordinal, session_id, db FROM cap WHERE db = 'shop'")
def filter_db(spark, d):
    return events.Filters(db="shop").apply(capture(spark, d)).select("ordinal", "session_id", "db")


@query("""WITH {CAPTURE} SELECT ordinal, session_id, "user" FROM cap WHERE "user" = 'u3'""")
def filter_user(spark, d):
    return events.Filters(user="u3").apply(capture(spark, d)).select("ordinal", "session_id", "user")


@query("WITH {CAPTURE} SELECT ordinal, ts_micros FROM cap WHERE ts_micros >= 1704844800000000 AND ts_micros < 1705276800000000")
def time_window(spark, d):
    window = events.parse_window("2024-01-10T00:00:00Z..1705276800")
    return events.Filters(window=window).apply(capture(spark, d)).select("ordinal", "ts_micros")


@query("""WITH {CAPTURE}, m AS (SELECT coalesce(db = 'shop' AND "user" = 'u1' AND ts_micros >= 1704844800000000, false) AS m FROM cap) SELECT count(*) FILTER (WHERE m) AS events, count(*) FILTER (WHERE NOT m) AS filtered FROM m""")
def filtered_totals(spark, d):
    return events.filtered_totals(capture(spark, d), events.Filters("shop", "u1", events.parse_window("1704844800..")))


@query("WITH {CAPTURE} SELECT ordinal, session_id, reads AND NOT uses AS runs FROM cap WHERE session_id IN (SELECT session_id FROM cap WHERE reads AND NOT uses)")
def session_pruning(spark, d):
    return events.prune_sessions(capture(spark, d), skip_use=True).select("ordinal", "session_id", "runs")


@query("WITH {CAPTURE} SELECT row_number() OVER (ORDER BY min(ordinal)) - 1 AS id, fingerprint AS text FROM cap GROUP BY fingerprint")
def first_seen_ids(spark, d):
    return events.fingerprint_dim(events.with_fingerprint(capture(spark, d)))


@query("WITH {CAPTURE}, dim AS (SELECT row_number() OVER (ORDER BY min(ordinal)) - 1 AS id, fingerprint FROM cap GROUP BY fingerprint) SELECT ordinal, CASE WHEN id % 4 = 3 THEN '<unknown fingerprint ' || id || '>' ELSE fingerprint END AS fingerprint FROM cap JOIN dim USING (fingerprint)")
def dimension_lookup(spark, d):
    cap = events.with_fingerprint(capture(spark, d))
    dim = events.fingerprint_dim(cap)
    return events.with_text(events.with_fingerprint_id(capture(spark, d)), dim.where("id % 4 <> 3")).select("ordinal", "fingerprint")


@query("WITH {CAPTURE}, f AS (SELECT session_id, row_number() OVER (ORDER BY min(ordinal)) AS session_rank FROM cap GROUP BY session_id) SELECT ordinal, session_rank, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) AS in_session FROM cap JOIN f USING (session_id)")
def session_order(spark, d):
    return events.session_order(capture(spark, d)).select("ordinal", "session_rank", "in_session")


@query("WITH {CAPTURE} SELECT ordinal, round(greatest(ts_micros - (SELECT min(ts_micros) FROM cap), 0) / 8.0::DOUBLE)::BIGINT AS due_us FROM cap")
def due_offsets(spark, d):
    return events.due_offsets(capture(spark, d), 8.0).select("ordinal", "due_us")


@query("""WITH {CAPTURE}, p AS (SELECT *, round(greatest(ts_micros - (SELECT min(ts_micros) FROM cap), 0) / 100000.0::DOUBLE)::BIGINT AS due_us, {MICROS} AS latency_us FROM cap),
s AS (SELECT *, sum(latency_us) OVER (PARTITION BY session_id ORDER BY ordinal) AS total FROM p),
m AS (SELECT *, total - latency_us + max(due_us - total + latency_us) OVER (PARTITION BY session_id ORDER BY ordinal) AS start_us FROM s)
SELECT ordinal, due_us, start_us::BIGINT AS start_us, (start_us - due_us)::BIGINT AS lag_us FROM m""")
def pacing_lag_model(spark, d):
    return events.pacing_lag(capture(spark, d), 100000.0).select("ordinal", "due_us", "start_us", "lag_us")


@query("WITH {CAPTURE} SELECT count(*) AS event_count, count(DISTINCT session_id) AS session_count FROM cap")
def capture_summary(spark, d):
    return events.capture_summary(capture(spark, d))


# --- reports ------------------------------------------------------------------------------------------------------------------------

BASELINE = "WITH {CAPTURE} SELECT fingerprint, sum(n)::BIGINT AS count, {STATS} FROM " + cells_sql("cap", "fingerprint", MICROS) + " GROUP BY fingerprint"


def _recorded(spark, d):
    cap = events.with_fingerprint(capture(spark, d)).withColumnRenamed("fingerprint", "fingerprint_id")
    return runs.recorded_classes(cap).withColumnRenamed("fingerprint_id", "fingerprint")


@query(BASELINE)
def fp_baseline_report(spark, d):
    return _recorded(spark, d)


@query(BASELINE + " ORDER BY p95_us DESC, count DESC, fingerprint LIMIT 10")
def top_fingerprints(spark, d):
    return runs.top(_recorded(spark, d), 10)


@query("WITH {CAPTURE}, t AS (SELECT count(*) AS events, count(DISTINCT session_id) AS sessions, (max(ts_micros) - min(ts_micros)) / 1e6::DOUBLE AS wall_secs FROM cap) SELECT *, events / wall_secs AS qps FROM t")
def capture_totals(spark, d):
    return runs.recorded_totals(capture(spark, d))


SIZES = "(CASE event_id % 7 WHEN 0 THEN 500 WHEN 1 THEN 5000 WHEN 2 THEN 50000 WHEN 3 THEN 500000 WHEN 4 THEN 5000000 WHEN 5 THEN 50000000 ELSE 200000000 END + event_id)"
OUTCOME = "CASE WHEN event_id % 10 = 0 THEN 'error' WHEN event_id % 10 = 1 THEN 'skipped' WHEN event_id % 20 = 2 THEN 'not_run' ELSE 'ok' END"
LOG = f"""log AS (SELECT event_id % 3 AS pass, event_id AS ordinal, user_id AS session_id, event_type AS fingerprint_id, {OUTCOME} AS outcome, greatest(round(value * 1000)::BIGINT, 1) AS latency_us,
  ({SIZES})::BIGINT AS result_bytes, CASE WHEN event_id % 10 = 0 THEN 'failed ' || event_id END AS error, epoch_us(ts) // 1000 AS due_us, epoch_us(ts) // 1000 + event_id % 5000 AS start_us FROM events)"""


def exec_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived log of outcomes; classes are event types."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    due = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    return e.select(
        (F.col("event_id") % 3).cast("int").alias("pass"),
        F.col("event_id").alias("ordinal"),
        F.col("user_id").alias("session_id"),
        F.col("event_type").alias("fingerprint_id"),
        F.expr(OUTCOME).alias("outcome"),
        F.greatest(F.round(F.col("value") * 1000).cast("long"), F.lit(1).cast("long")).alias("latency_us"),
        F.expr(SIZES).cast("long").alias("result_bytes"),
        F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("failed "), F.col("event_id"))).alias("error"),
        due.alias("due_us"),
        (due + F.col("event_id") % 5000).alias("start_us"),
    )


@query(f"WITH {LOG} SELECT fingerprint_id, count(*) FILTER (WHERE outcome = 'ok') AS count, count(*) FILTER (WHERE outcome = 'error') AS errors, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'not_run') AS not_run, arg_min(error, ordinal) FILTER (WHERE outcome = 'error') AS first_error FROM log GROUP BY fingerprint_id")
def measured_outcomes(spark, d):
    return runs.outcome_counts(exec_log(spark, d))


@query(f"WITH {LOG} SELECT count(*) AS events, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE outcome = 'ok') AS executed, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'error') AS errors, count(*) FILTER (WHERE outcome = 'not_run') AS not_run FROM log")
def measured_totals(spark, d):
    return runs.measured_totals(exec_log(spark, d))


@query(f"WITH {LOG} SELECT count(*) AS paced_events, max(start_us - due_us) AS max_lag_us, avg(start_us - due_us) AS mean_lag_us FROM log")
def pacing_lag_stats(spark, d):
    return runs.lag_stats(exec_log(spark, d))


@query(f"""WITH {LOG}, ok AS (SELECT * FROM log WHERE outcome = 'ok'),
exact AS (SELECT fingerprint_id, sum(result_bytes)::BIGINT AS total, min(result_bytes) AS min, max(result_bytes) AS max, sum(result_bytes)::DOUBLE / count(*) AS mean FROM ok GROUP BY fingerprint_id),
about AS (SELECT fingerprint_id, {quantile_sql(0.5, "p50")}, {quantile_sql(0.95, "p95")} FROM {cells_sql("ok", "fingerprint_id", "result_bytes", 2)} GROUP BY fingerprint_id)
SELECT * FROM exact JOIN about USING (fingerprint_id)""")
def result_bytes_stats(spark, d):
    return runs.result_sizes(exec_log(spark, d))


DECADE = "CASE " + " ".join(f"WHEN result_bytes < {b} THEN {i}" for i, b in enumerate(scalars.SIZE_BOUNDS)) + " ELSE 6 END"
LABEL = "CASE " + " ".join(f"WHEN {{0}} < {b} THEN '{n}'" for b, n in zip(scalars.SIZE_BOUNDS, scalars.SIZE_LABELS, strict=False)) + " ELSE '>=100MB' END"


@query(f"SELECT doc_id, {LABEL.format('n_chars')} AS bucket FROM documents")
def size_decades(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", scalars.size_label(F.col("n_chars")).alias("bucket"))


DECADES = f"""ok AS (SELECT *, {DECADE} AS decade, {LABEL.format('result_bytes')} AS bucket FROM log WHERE outcome = 'ok'),
dec AS (SELECT pass, fingerprint_id, bucket, sum(n)::BIGINT AS count, {quantile_sql(0.5, "p50_us")}, {quantile_sql(0.95, "p95_us")}, max(cell)::BIGINT AS max_us, sum(n * (cell - (1 << k) + 1 + ((1 << k) >> 1)))::DOUBLE / sum(n) AS mean_us
  FROM {cells_sql("ok", "pass, fingerprint_id, bucket", "latency_us")} GROUP BY pass, fingerprint_id, bucket),
size AS (SELECT pass, fingerprint_id, bucket, sum(result_bytes)::BIGINT AS bytes_total FROM ok GROUP BY pass, fingerprint_id, bucket)"""


@query(f"WITH {LOG.replace('event_id % 3 AS pass', '0 AS pass')}, {DECADES} SELECT fingerprint_id, bucket, count, p50_us, p95_us, mean_us, max_us, bytes_total FROM dec JOIN size USING (pass, fingerprint_id, bucket)")
def decade_latency(spark, d):
    return runs.size_decades(exec_log(spark, d)).select("fingerprint_id", "bucket", "count", "p50_us", "p95_us", "mean_us", "max_us", "bytes_total")


def _passes(spark, d) -> DataFrame:
    """The three passes of the derived log, as reports of classes."""
    log = exec_log(spark, d)
    dim = log.select(F.col("fingerprint_id").alias("id"), F.col("fingerprint_id").alias("text")).distinct()
    out = None
    for p in range(3):
        one = runs.measured_classes(log.where(F.col("pass") == p), dim).withColumn("pass", F.lit(p))
        out = one if out is None else out.unionByName(one)
    return out


MEDIAN = "list_sort(list({0}))[(count(*) + 1) // 2] + (list_sort(list({0}))[count(*) // 2 + 1] - list_sort(list({0}))[(count(*) + 1) // 2]) // 2"


@query(f"""WITH {LOG}, ok AS (SELECT * FROM log WHERE outcome = 'ok'),
lat AS (SELECT pass, fingerprint_id, sum(n)::BIGINT AS count, {STATS} FROM {cells_sql("ok", "pass, fingerprint_id", "latency_us")} GROUP BY pass, fingerprint_id),
err AS (SELECT pass, fingerprint_id, count(*) FILTER (WHERE outcome = 'error') AS errors FROM log GROUP BY pass, fingerprint_id),
size AS (SELECT pass, fingerprint_id, sum(result_bytes)::BIGINT AS total, sum(result_bytes)::DOUBLE / count(*) AS mean FROM ok GROUP BY pass, fingerprint_id)
SELECT fingerprint_id AS fingerprint, {", ".join(f"({MEDIAN.format(c)})::BIGINT AS {c}" for c in ("count", "errors", "p50_us", "p95_us", "p99_us", "max_us"))}, median(mean_us) AS mean_us, ({MEDIAN.format("total")})::BIGINT AS bytes_total, median(mean) AS bytes_mean
FROM lat JOIN err USING (pass, fingerprint_id) JOIN size USING (pass, fingerprint_id) GROUP BY fingerprint_id""")
def pass_median(spark, d):
    return passes.median_classes(_passes(spark, d)).select("fingerprint", "count", "errors", "p50_us", "p95_us", "p99_us", "max_us", "mean_us", F.col("result_bytes.total").alias("bytes_total"), F.col("result_bytes.mean").alias("bytes_mean"))


@query(f"""WITH {LOG}, {DECADES}, every AS (SELECT * FROM dec JOIN size USING (pass, fingerprint_id, bucket))
SELECT fingerprint_id AS fingerprint, bucket, {", ".join(f"({MEDIAN.format(c)})::BIGINT AS {c}" for c in ("count", "p50_us", "p95_us", "max_us", "bytes_total"))}, median(mean_us) AS mean_us FROM every GROUP BY fingerprint_id, bucket""")
def pass_decade_median(spark, d):
    return passes.median_decades(_passes(spark, d)).drop("decade")


# --- checksums ------------------------------------------------------------------------------------------------------------------------

HASH = "('0x' || substr(md5({0}), 1, 15))::BIGINT"
NATION = "'i' || length(n_nationkey::VARCHAR) || ':' || n_nationkey || 'b' || length(n_name) || ':' || n_name || 'i' || length(n_regionkey::VARCHAR) || ':' || n_regionkey"


@query(f"WITH h AS (SELECT {HASH.format(NATION)} AS h FROM nation), s AS (SELECT count(*) AS rows, (sum(h::HUGEINT) % 18446744073709551616)::VARCHAR AS sum, bit_xor(h) AS xor FROM h) SELECT rows, sum, xor, {HASH.format('''rows || '|' || sum || '|' || xor || '|n_nationkey,n_name,n_regionkey' ''')} AS digest FROM s")
def result_checksum(spark, d):
    return checksums.result_checksum(spark.read.parquet(f"{d}/nation.parquet"), hashed=checksums.md5_hash).withColumn("sum", F.col("sum").cast("string"))


@query(f"""WITH r AS (SELECT o_orderpriority AS fingerprint_id, o_orderkey AS ordinal, CASE WHEN o_orderkey % 5 > 0 THEN {HASH.format("o_orderstatus || o_orderkey")} END AS digest, o_orderkey % 100 AS digest_rows FROM orders),
s AS (SELECT fingerprint_id, count(digest) AS events, count(*) - count(digest) AS no_result, sum(CASE WHEN digest IS NOT NULL THEN digest_rows END)::BIGINT AS rows_total, (sum(digest::HUGEINT) % 18446744073709551616)::VARCHAR AS sum, bit_xor(digest) AS xor FROM r GROUP BY fingerprint_id)
SELECT fingerprint_id, events, no_result, rows_total, lpad(format('{{:x}}', {HASH.format("events || '|' || no_result || '|' || sum || '|' || xor")}), 16, '0') AS digest, true AS shape_varied FROM s""")
def fp_checksum(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    digest = F.when(F.col("o_orderkey") % 5 > 0, checksums.md5_hash(F.concat("o_orderstatus", F.col("o_orderkey").cast("string")))).cast("decimal(20,0)")
    rows = o.select(F.col("o_orderpriority").alias("fingerprint_id"), F.col("o_orderkey").alias("ordinal"), digest.alias("digest"), (F.col("o_orderkey") % 100).alias("digest_rows"), F.array(F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b")).alias("columns"))
    return checksums.class_checksums(rows, checksums.md5_hash).drop("columns")


# --- comparisons ----------------------------------------------------------------------------------------------------------------------
# Classes are an event type and the parity of the event; the candidate is the baseline with latencies times a factor, without one class and with
# another. Signups of one size are fast in the baseline and three times as slow in the candidate, which their class's latencies do not show, and the
# candidate has more errors among them.

FACTOR = "CASE event_type WHEN 'click' THEN 3.0 WHEN 'purchase' THEN 0.5 WHEN 'view' THEN 1.05 ELSE 1.0 END"
CLASS = "event_type || CASE WHEN event_id % 2 = 0 THEN ' even' ELSE ' odd' END || CASE WHEN event_id % 997 = 3 THEN ' rare' ELSE '' END"
SIDE = """{name}_log AS (SELECT {cls} AS fingerprint, {outcome} AS outcome, greatest(round(value * ({factor}) * 1000)::BIGINT, 1) AS latency_us, ({sizes})::BIGINT AS result_bytes, event_id FROM events WHERE {where}),
{name}_ok AS (SELECT *, {label} AS bucket FROM {name}_log WHERE outcome = 'ok'),
{name} AS (SELECT fingerprint, count, errors, p50_us, p95_us, p99_us, max_us, mean_us, bytes_mean FROM
  (SELECT fingerprint, count(*) FILTER (WHERE outcome = 'ok') AS count, count(*) FILTER (WHERE outcome = 'error') AS errors FROM {name}_log GROUP BY fingerprint)
  LEFT JOIN (SELECT fingerprint, {stats} FROM {cells} GROUP BY fingerprint) USING (fingerprint)
  LEFT JOIN (SELECT fingerprint, sum(result_bytes)::DOUBLE / count(*) AS bytes_mean FROM {name}_ok GROUP BY fingerprint) USING (fingerprint)),
{name}_dec AS (SELECT fingerprint, bucket, sum(n)::BIGINT AS count, {p50}, {p95} FROM {dcells} GROUP BY fingerprint, bucket)"""


def _side_sql(name: str, factor: str, where: str) -> str:
    cls = CLASS if name == "b" else f"CASE WHEN event_type = 'error' THEN 'new ' ELSE '' END || {CLASS}"
    return SIDE.format(
        name=name, cls=cls, outcome=OUTCOME if name == "b" else MORE_ERRORS, factor=factor, sizes=SIZES, where=where, label=LABEL.format("result_bytes"), stats=STATS, p50=quantile_sql(0.5, "p50_us"), p95=quantile_sql(0.95, "p95_us"),
        cells=cells_sql(f"{name}_ok", "fingerprint", "latency_us"), dcells=cells_sql(f"{name}_ok", "fingerprint, bucket", "latency_us"),
    )


FAST_DECADE = "CASE WHEN event_type = 'signup' AND event_id % 7 = 3 THEN 0.1 ELSE 1.0 END"
SLOW_DECADE = f"{FACTOR} * CASE WHEN event_type = 'signup' AND event_id % 7 = 3 THEN 0.3 ELSE 1.0 END"
MORE_ERRORS = f"CASE WHEN event_type = 'signup' AND event_id % 10 = 3 THEN 'error' ELSE {OUTCOME} END"
PAIR = "WITH " + _side_sql("b", FAST_DECADE, "true") + ", " + _side_sql("c", SLOW_DECADE, "event_type <> 'view' OR event_id % 2 = 0")
PCT = "CASE WHEN {0} > 0 THEN ({1} - {0})::DOUBLE / {0} * 100 END"
DELTAS = (
    PAIR
    + ", d AS (SELECT fingerprint, b.count AS baseline_count, c.count AS candidate_count, b.count <> c.count AS count_mismatch, c.errors - b.errors AS error_delta, coalesce(b.p95_us, 0) AS b95, coalesce(c.p95_us, 0) AS c95, coalesce(b.p50_us, 0) AS b50, coalesce(c.p50_us, 0) AS c50, b.bytes_mean AS bb, c.bytes_mean AS cb FROM b JOIN c USING (fingerprint))"
    + f", p AS (SELECT *, {PCT.format('b95', 'c95')} AS p95_pct, {PCT.format('b50', 'c50')} AS p50_pct, {PCT.format('bb', 'cb')} AS bytes_pct FROM d)"
    + ", v AS (SELECT *, CASE WHEN least(baseline_count, candidate_count) < 5 THEN 'low_sample' WHEN p95_pct IS NULL AND c95 > 0 OR p95_pct >= 20 THEN 'regressed' WHEN p95_pct <= -20 THEN 'improved' ELSE 'stable' END AS verdict FROM p)"
    + ", dd AS (SELECT fingerprint, bucket, b_dec.count AS baseline_count, c_dec.count AS candidate_count, b_dec.p95_us AS b95, c_dec.p95_us AS c95, verdict, "
    + PCT.format("b_dec.p95_us", "c_dec.p95_us")
    + " AS p95_pct FROM b_dec JOIN c_dec USING (fingerprint, bucket) JOIN v USING (fingerprint) WHERE least(b_dec.count, c_dec.count) >= 5)"
)


def _classes(spark, d, side: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    e = e if side == "b" else e.where("event_type <> 'view' OR event_id % 2 = 0")
    cls = F.expr(CLASS) if side == "b" else F.concat(F.when(F.col("event_type") == "error", "new ").otherwise(""), F.expr(CLASS))
    factor = F.expr(FAST_DECADE if side == "b" else SLOW_DECADE).cast("double")
    log = e.select(
        F.col("event_id").alias("ordinal"),
        cls.alias("fingerprint_id"),
        F.expr(OUTCOME if side == "b" else MORE_ERRORS).alias("outcome"),
        F.greatest(F.round(F.col("value") * factor * 1000).cast("long"), F.lit(1).cast("long")).alias("latency_us"),
        F.expr(SIZES).cast("long").alias("result_bytes"),
        F.lit(None).cast("string").alias("error"),
    )
    dim = log.select(F.col("fingerprint_id").alias("id"), F.col("fingerprint_id").alias("text")).distinct()
    return runs.measured_classes(log, dim)


def _deltas(spark, d) -> DataFrame:
    return compare.deltas(_classes(spark, d, "b"), _classes(spark, d, "c"))


def _placed(df: DataFrame) -> DataFrame:
    """With ``place``, from 1, in the order that ``df`` has."""
    return df.withColumn("_at", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(W.orderBy("_at"))).drop("_at")


def _flat(df: DataFrame) -> DataFrame:
    return _placed(df).select("place", "fingerprint", "baseline_count", "candidate_count", "verdict", F.col("p95.delta_us").alias("p95_delta_us"), F.col("p95.delta_pct").alias("p95_pct"))


FLAT = "SELECT row_number() OVER (ORDER BY {order}) AS place, fingerprint, baseline_count, candidate_count, verdict, (c95 - b95)::DOUBLE AS p95_delta_us, p95_pct FROM v"


def _flat_sql(verdict: str, order: str) -> str:
    return f"{DELTAS} {FLAT.format(order=order)} WHERE verdict = '{verdict}'"


@query(DELTAS + " SELECT fingerprint, baseline_count, candidate_count, count_mismatch, error_delta, b50::DOUBLE AS p50_baseline, c50::DOUBLE AS p50_candidate, p50_pct, p95_pct, bytes_pct FROM v")
def compare_join(spark, d):
    return _deltas(spark, d).select("fingerprint", "baseline_count", "candidate_count", "count_mismatch", "error_delta", F.col("p50.baseline_us").alias("p50_baseline"), F.col("p50.candidate_us").alias("p50_candidate"), F.col("p50.delta_pct").alias("p50_pct"), F.col("p95.delta_pct").alias("p95_pct"), F.col("result_bytes.mean_delta_pct").alias("bytes_pct"))


@query(DELTAS + " SELECT fingerprint, verdict FROM v")
def verdict_classes(spark, d):
    return _deltas(spark, d).select("fingerprint", "verdict")


@query(_flat_sql("regressed", "p95_pct DESC NULLS FIRST, c95 - b95 DESC, fingerprint"))
def regressions_ranked(spark, d):
    return _flat(compare.regressions(_deltas(spark, d)))


@query(_flat_sql("improved", "p95_pct, c95 - b95, fingerprint"))
def improvements_ranked(spark, d):
    return _flat(compare.improvements(_deltas(spark, d)))


@query(_flat_sql("low_sample", "coalesce(p95_pct, 0) DESC, fingerprint"))
def low_sample_ranked(spark, d):
    return _flat(compare.low_sample(_deltas(spark, d)))


@query(_flat_sql("stable", "b95 DESC, baseline_count DESC, fingerprint"))
def stable_classes(spark, d):
    return _flat(compare.stable(_deltas(spark, d)))


@query(DELTAS + " SELECT fingerprint, error_delta FROM v WHERE error_delta <> 0")
def error_changes(spark, d):
    return compare.error_changes(_deltas(spark, d)).select("fingerprint", "error_delta")


@query(PAIR + " SELECT row_number() OVER (ORDER BY count DESC, fingerprint) AS place, fingerprint, count, errors FROM b WHERE fingerprint NOT IN (SELECT fingerprint FROM c)")
def only_in_baseline(spark, d):
    return _placed(compare.only_in(_classes(spark, d, "b"), _classes(spark, d, "c")))


@query(PAIR + " SELECT row_number() OVER (ORDER BY count DESC, fingerprint) AS place, fingerprint, count, errors FROM c WHERE fingerprint NOT IN (SELECT fingerprint FROM b)")
def only_in_candidate(spark, d):
    return _placed(compare.only_in(_classes(spark, d, "c"), _classes(spark, d, "b")))


@query(DELTAS + " SELECT row_number() OVER (ORDER BY p95_pct DESC NULLS FIRST, c95 - b95 DESC, fingerprint, bucket) AS place, fingerprint, bucket, baseline_count, candidate_count, p95_pct FROM dd WHERE verdict <> 'regressed' AND (p95_pct >= 20 OR p95_pct IS NULL AND c95 > 0)")
def size_regressions(spark, d):
    pairs = compare.decade_pairs(_deltas(spark, d))
    return _placed(compare.size_regressions(pairs)).select("place", "fingerprint", "bucket", "baseline_count", "candidate_count", F.col("p95.delta_pct").alias("p95_pct"))


@query(DELTAS + ", l AS (SELECT count(*) AS size_buckets_checked, count(*) FILTER (WHERE verdict <> 'regressed' AND (p95_pct >= 20 OR p95_pct IS NULL AND c95 > 0)) > 0 AS size_regressed FROM dd) SELECT count(*) FILTER (WHERE count_mismatch) AS count_mismatches, sum(error_delta)::BIGINT AS error_delta, bool_or(verdict = 'regressed') AS regressed, any_value(size_buckets_checked) AS size_buckets_checked, any_value(size_regressed) AS size_regressed, CASE WHEN bool_or(verdict = 'regressed') OR any_value(size_regressed) THEN 2 ELSE 0 END AS exit_code FROM v, l")
def gate_exit_code(spark, d):
    x = _deltas(spark, d)
    return compare.summary(x, compare.decade_pairs(x), compare.correctness(x)).select("count_mismatches", "error_delta", "regressed", "size_buckets_checked", "size_regressed", "exit_code")


@query("SELECT 0::BIGINT AS count_mismatches, 0::BIGINT AS error_delta, false AS regressed, false AS size_regressed, 0 AS exit_code")
def gate_equal_runs(spark, d):
    """A run against itself passes the gate."""
    one = _classes(spark, d, "b")
    x = compare.deltas(one, one)
    return compare.summary(x, compare.decade_pairs(x), compare.correctness(x)).select("count_mismatches", "error_delta", "regressed", "size_regressed", "exit_code")


@query("""WITH b AS (SELECT n_name AS name, 'v' || n_regionkey AS value FROM nation WHERE n_nationkey < 20), c AS (SELECT n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'changed' ELSE 'v' || n_regionkey END AS value FROM nation WHERE n_nationkey >= 5)
SELECT name, b.value AS baseline, c.value AS candidate FROM b FULL JOIN c USING (name) WHERE b.value IS DISTINCT FROM c.value""")
def settings_diff(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    value = F.concat(F.lit("v"), F.col("n_regionkey"))
    b = n.where("n_nationkey < 20").select(F.col("n_name").alias("name"), value.alias("value"))
    c = n.where("n_nationkey >= 5").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 == 0, "changed").otherwise(value).alias("value"))
    return compare.settings_diff(b, c)


def _run(spark, **changes) -> DataFrame:
    """One run report, of the flags and identity that comparability looks at."""
    flags = dict(max_connections=50, allow_writes=False, read_only=False, db_override=None, speed="max", checksum=False, pool=None, warmup=False, filter_db=None, filter_user=None, time_window=None) | changes.pop("flags", {})
    kinds = "capture_file string, capture_dialect string, target_server_version string, latency_source string, aborted boolean, flags struct<max_connections: long, allow_writes: boolean, read_only: boolean, db_override: string, speed: string, checksum: boolean, pool: long, warmup: boolean, filter_db: string, filter_user: string, time_window: string>"
    run = dict(capture_file="a", capture_dialect="mysql-8.0", target_server_version="8.0.33", latency_source="replayed", aborted=False) | changes
    return spark.createDataFrame([(*run.values(), tuple(flags.values()))], kinds)


@query("SELECT * FROM (VALUES ('speed', 'max', '1'), ('pool', '<none>', '8'), ('filter-db', '<none>', 'shop')) AS t(name, baseline, candidate)")
def flag_diff(spark, d):
    return compare.flag_diff(_run(spark), _run(spark, flags={"speed": "1", "pool": 8, "filter_db": "shop"}))


@query("SELECT * FROM (VALUES ('capture_file', false), ('capture_dialect', true), ('engine_family', true), ('measurement_planes', true), ('aborted', false), ('checksum_one_sided', true)) AS t(\"check\", fires)")
def comparability_checks(spark, d):
    return compare.checks_of_runs(_run(spark, latency_source="recorded-slow-log", flags={"checksum": True}), _run(spark, capture_dialect="mariadb", target_server_version="5.5.5-10.11-MariaDB"))


@query("""WITH x AS (SELECT c_custkey AS k, 'query ' || c_custkey AS fingerprint, 1 + c_custkey % 5 AS be, CASE WHEN c_custkey % 7 = 0 THEN 2 + c_custkey % 5 ELSE 1 + c_custkey % 5 END AS ce, 'd' || c_custkey % 3 AS bd, 'd' || CASE WHEN c_custkey % 4 = 0 THEN 9 ELSE c_custkey % 3 END AS cd, c_custkey % 6 = 0 AS nd, c_custkey % 50 AS br, c_custkey % 60 AS cr FROM customer)
SELECT fingerprint, bd AS baseline_digest, cd AS candidate_digest, br AS baseline_rows, cr AS candidate_rows, be AS baseline_events, ce AS candidate_events, false AS columns_differ, nd AS nondeterministic, be <> ce AS events_differ,
  CASE WHEN bd = cd THEN 'matched' WHEN nd OR be <> ce THEN 'advisory' ELSE 'mismatch' END AS status FROM x""")
def correctness_diff(spark, d):
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{d}/customer.parquet")
    mark = lambda events_, rows, digest, nd: F.struct(F.struct(events_.alias("events"), rows.alias("rows_total"), F.concat(F.lit("d"), digest).alias("digest"), F.array(F.lit("a")).alias("columns"), nd.alias("nondeterministic")).alias("checksum"))
    b = mark(1 + k % 5, k % 50, k % 3, k % 6 == 0)
    other = mark(F.when(k % 7 == 0, 2 + k % 5).otherwise(1 + k % 5), k % 60, F.when(k % 4 == 0, 9).otherwise(k % 3), F.lit(False))
    return compare.correctness(c.select(F.concat(F.lit("query "), k).alias("fingerprint"), b.alias("b"), other.alias("c")))


# --- sources ---------------------------------------------------------------------------------------------------------------------------
# Four slow logs are written out of the capture, line by line, and read by the parser: what comes back has to be what went in.


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_no, line) of slow logs that tell of the derived capture."""
    cap = capture(spark, sf_dir)
    seconds = F.concat((F.expr("ts_micros div 1000000")).cast("string"), F.lit("."), F.lpad(F.pmod("ts_micros", F.lit(1_000_000)).cast("string"), 6, "0"))
    lines = F.array(
        F.concat(F.lit("# User@Host: "), "user", F.lit("["), "user", F.lit("] @ app [10.0.0.1]  Id:   "), F.col("session_id").cast("string")),
        F.when(F.col("db").isNotNull(), F.concat(F.lit("# Thread_id: "), F.col("session_id").cast("string"), F.lit("  Schema: "), "db", F.lit("  QC_hit: No"))),
        F.concat(F.lit("# Query_time: "), F.col("orig_query_time_s").cast("string"), F.lit("  Lock_time: 0.000001 Rows_sent: 1  Rows_examined: 2")),
        F.concat(F.lit("SET timestamp="), seconds, F.lit(";")),
        F.concat("query", F.lit(";")),
    )
    return cap.select(F.concat(F.lit("log"), F.col("session_id") % 4).alias("file"), "ordinal", F.posexplode(F.filter(lines, lambda x: x.isNotNull()))).select("file", (F.col("ordinal") * 8 + F.col("pos")).alias("line_no"), F.col("col").alias("line"))


@query("""WITH {CAPTURE} SELECT 'log' || session_id % 4 AS file, row_number() OVER (PARTITION BY session_id % 4 ORDER BY ordinal) - 1 AS ordinal, ts_micros, session_id, "user", db, query, orig_query_time_s FROM cap""")
def slowlog_scan(spark, d):
    slowlog.register(spark)
    log_lines(spark, d).createOrReplaceTempView("slowlog_lines")
    rows = spark.sql("SELECT * FROM slowlog_parse(TABLE(SELECT * FROM slowlog_lines) PARTITION BY file ORDER BY line_no)")
    return rows.where("kind = 'event'").select("file", "ordinal", "ts_micros", "session_id", "user", "db", "query", "orig_query_time_s")


@query("""WITH {CAPTURE} SELECT ordinal, ts_micros AS stamp, session_id AS thread, "user", db AS schema FROM cap""")
def header_fields(spark, d):
    """X18, X20 and X21 as columns over the lines of those logs."""
    lines = log_lines(spark, d).select(F.expr("line_no div 8").alias("ordinal"), "line")
    host = F.when(F.col("line").startswith("# User@Host: "), F.expr("substring(line, 14)"))
    return lines.groupBy("ordinal").agg(
        F.max(F.when(F.col("line").startswith("SET timestamp="), scalars.set_timestamp_micros(F.col("line")))).alias("stamp"),
        F.max(scalars.header_thread(host)).alias("thread"),
        F.max(scalars.header_user(host)).alias("user"),
        F.max(F.when(F.col("line").startswith("# Thread_id: "), scalars.header_value(F.col("line"), "Schema"))).alias("schema"),
    )


@query("SELECT event_id, CASE event_id % 3 WHEN 2 THEN -1 ELSE epoch_us(date_trunc('second', ts)) END AS micros, CASE event_id % 4 WHEN 0 THEN 'db' || event_id WHEN 1 THEN 'my`' || event_id END AS db FROM events")
def log_times_and_databases(spark, d):
    """X17 and X19 over both forms of each, and over what has neither."""
    e = spark.read.parquet(f"{d}/events.parquet")
    form = lambda p: F.date_format(F.col("ts").cast("timestamp"), p)
    i = F.col("event_id")
    when = F.when(i % 3 == 0, form("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i % 3 == 1, form("yyMMdd HH:mm:ss")).otherwise("no time")
    use = F.when(i % 4 == 0, F.concat(F.lit("use db"), i, F.lit(";"))).when(i % 4 == 1, F.concat(F.lit("USE `my``"), i, F.lit("`;"))).when(i % 4 == 2, "use two words;").otherwise("SELECT 1")
    return e.select("event_id", F.coalesce(scalars.time_micros(when), F.lit(-1).cast("long")).alias("micros"), scalars.use_target(use).alias("db"))


@query("""WITH i AS (SELECT event_id * 10000 AS due_us, event_id * 10000 + event_id % 7 * 15000 AS start_us, event_id * 10000 + event_id % 7 * 15000 + greatest(round(value * 1000)::BIGINT, 1) AS end_us FROM events),
r AS (SELECT tick, count(*) AS runs FROM (SELECT unnest(generate_series(start_us // 50000, end_us // 50000)) AS tick, start_us, end_us FROM i) WHERE tick * 50000 >= start_us AND tick * 50000 < end_us GROUP BY tick),
w AS (SELECT DISTINCT tick FROM (SELECT unnest(generate_series(due_us // 50000, start_us // 50000)) AS tick, due_us, start_us FROM i) WHERE tick * 50000 >= due_us AND tick * 50000 < start_us)
SELECT max(end_us) // 50000 + 1 AS samples, (SELECT count(*) FROM r JOIN w USING (tick) WHERE runs >= 20) AS saturated_samples, (SELECT count(*) FROM r JOIN w USING (tick) WHERE runs >= 20) / (max(end_us) // 50000 + 1)::DOUBLE * 100 AS saturated_pct FROM i""")
def saturation(spark, d):
    i = F.col("event_id")
    e = spark.read.parquet(f"{d}/events.parquet").select((i * 10000).alias("due_us"), (i * 10000 + i % 7 * 15000).alias("start_us"), F.greatest(F.round(F.col("value") * 1000).cast("long"), F.lit(1).cast("long")).alias("latency"))
    return runs.saturation(e.withColumn("end_us", F.col("start_us") + F.col("latency")), 20)


# --- scalar functions -----------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, strlen(c_name) + 8 + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 8 END + 4 AS bytes FROM customer")
def value_bytes(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    cells = [scalars.value_bytes(F.col("c_name"), "string"), scalars.value_bytes(F.col("c_acctbal"), "double"), scalars.value_bytes(F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")), "bigint"), scalars.value_bytes(F.col("c_acctbal").cast("float"), "float")]
    return c.select("c_custkey", sum(cells[1:], cells[0]).alias("bytes"))


@query("""SELECT o_orderkey, CASE WHEN b < 1024 THEN b || 'B' WHEN b < 1048576 THEN printf('%.1fKB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN printf('%.1fMB', b / 1048576.0::DOUBLE) ELSE printf('%.1fGB', b / 1073741824.0::DOUBLE) END AS size FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 17 + 3 AS b FROM orders)""")
def fmt_bytes(spark, d):
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", scalars.fmt_bytes(k * k * 17 + 3).alias("size"))


@query("""SELECT event_id, printf('%.3f', (event_id * 7)::DOUBLE / 1000) AS ms, CASE WHEN event_id % 4 = 0 THEN 'n/a' ELSE printf('%+.1f%%', (event_id - 5000)::DOUBLE / 4) END AS pct FROM events""")
def fmt_ms_pct(spark, d):
    i = F.col("event_id")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", scalars.fmt_ms(i * 7).alias("ms"), scalars.fmt_pct(F.when(i % 4 != 0, (i - 5000).cast("double") / 4)).alias("pct"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS text FROM documents")
def truncate_text(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", scalars.truncate_chars(F.col("text"), 80).alias("text"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'mysql://u' || c_custkey || ':***@h:3306/d' WHEN 1 THEN 'mysql://u@h/' || c_custkey ELSE 'plain ' || c_name END AS url FROM customer")
def redact_url(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    url = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'mysql://u' || c_custkey || ':p@ss' || c_custkey || '@h:3306/d' WHEN 1 THEN 'mysql://u@h/' || c_custkey ELSE 'plain ' || c_name END")
    return c.select("c_custkey", scalars.redact_url(url).alias("url"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM pages")
def escape_html(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", scalars.escape_html(F.col("html")).alias("html"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN us = 0 THEN '' ELSE '.' || rtrim(lpad(us::VARCHAR, 6, '0'), '0') END || 'Z' AS at FROM (SELECT *, epoch_us(ts) % 1000000 AS us FROM events)")
def rfc3339_text(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", scalars.rfc3339(F.unix_micros(F.col("ts").cast("timestamp"))).alias("at"))


@query("SELECT doc_id, '''' || replace(replace(replace(text, '\\', '\\\\'), '''', ''''''), chr(10), '\\n') || '''' AS literal FROM documents")
def string_literal(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", scalars.string_literal(F.col("text")).alias("literal"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'MariaDB' ELSE 'MySQL' END AS family, CASE n_nationkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN '10.' || n_nationkey || '-MariaDB' ELSE '5.5.5-8.0.' || n_nationkey END AS shown FROM nation")
def server_versions(spark, d):
    v = F.expr("CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN '5.5.5-10.' || n_nationkey || '-MariaDB' ELSE '5.5.5-8.0.' || n_nationkey END")
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", scalars.server_family(v).alias("family"), scalars.display_version(v, F.lit("replayed")).alias("shown"))


# --- the shapes of a mixed workload ------------------------------------------------------------------------------------------------------


@query("SELECT * FROM customer WHERE c_custkey = 77")
def pk_lookup(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").where("c_custkey = 77")


@query("SELECT count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders WHERE o_orderdate >= DATE '1995-03-01' AND o_orderdate < DATE '1995-04-01'")
def date_lookup(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").where("o_orderdate >= timestamp_ntz'1995-03-01 00:00:00' AND o_orderdate < timestamp_ntz'1995-04-01 00:00:00'")
    return o.agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("SELECT o_custkey, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey ORDER BY round(sum(l_extendedprice), 2) DESC, o_custkey LIMIT 20")
def join_group_by(spark, d):
    o, li = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "lineitem"))
    total = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.count("*").alias("n"))
    return total.orderBy(F.desc("total"), "o_custkey").limit(20)


@query("SELECT doc_id, text FROM documents WHERE doc_id = 42")
def text_point_fetch(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").where("doc_id = 42").select("doc_id", "text")


@query("SELECT doc_id, text FROM documents WHERE doc_id IN (3, 14, 15, 92)")
def text_in_fetch(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").where("doc_id IN (3, 14, 15, 92)").select("doc_id", "text")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the slowest classes of the capture."""
    return top_fingerprints(spark, sf_dir)
