import os

import duckdb
import pytest

import __spark_entry__
from tracewright import queries
from tracewright.functions import hdr
from tracewright.operators import events as ev
from tracewright.operators import runs
from tracewright.streaming import tail

SHOWN = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    rows = sorted([SHOWN(r[c]) for c in order] for r in got.collect())
    assert rows == sorted([SHOWN(r[columns.index(c)]) for c in order] for r in want.fetchall())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 10 and df.columns[0] == "fingerprint"


def test_ranked_queries_have_rows(spark, sf_dir):
    for name in ("regressions_ranked", "size_regressions", "error_changes", "only_in_baseline", "only_in_candidate"):
        assert queries.QUERIES[name](spark, sf_dir).count() > 0, name


def test_every_query_has_a_name_of_its_own():
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(queries.ORACLES) == set(queries.QUERIES)


def test_scans_are_pruned(spark, sf_dir):
    plan = queries.time_window(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema")[1]
    plan = queries.text_point_fetch(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,42)" in plan


def test_event_store_and_stream(spark, sf_dir, tmp_path):
    cap = ev.with_fingerprint_id(queries.capture(spark, sf_dir))
    ev.write_events(cap, str(tmp_path / "events"))
    stream = tail.windowed_cells(tail.event_stream(spark, str(tmp_path / "events")), "1 day", "1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    cells = spark.table("cells")
    assert cells.agg({"n": "sum"}).first()[0] == cap.count()
    report = tail.quantiles(cells)
    day = ev.with_fingerprint(cap).withColumn("fingerprint_id", hdr.F.struct(hdr.F.window(hdr.F.timestamp_micros("ts_micros"), "1 day").alias("window"), "fingerprint"))
    want = {tuple(r.fingerprint_id): (r["count"], r.p50_us, r.p95_us, r.p99_us, r.max_us) for r in runs.recorded_classes(day).collect()}
    assert {(r.window, r.fingerprint): (r["count"], r.p50_us, r.p95_us, r.p99_us, r.max_us) for r in report.collect()} == want
