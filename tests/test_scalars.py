import random

from pyspark.sql import functions as F

from tracewright.functions import hdr
from tracewright.functions import scalars as X


def values(spark, f, rows, kind="string"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}").select("i", f(F.col("x")).alias("y"))
    return [r.y for r in sorted(frame.collect(), key=lambda r: r.i)]


def test_size_decades(spark):
    sizes = [0, 1023, 1024, 10 * 1024 - 1, 10 * 1024, 102_400, 1 << 20, 10 << 20, (100 << 20) - 1, 100 << 20, 1 << 40]
    assert values(spark, X.size_label, sizes, "long") == ["<1KB", "<1KB", "1KB-10KB", "1KB-10KB", "10KB-100KB", "100KB-1MB", "1MB-10MB", "10MB-100MB", "10MB-100MB", ">=100MB", ">=100MB"]
    assert values(spark, X.label_index, ["<1KB", ">=100MB", "odd"]) == [0, 6, 7]


def test_formats(spark):
    assert values(spark, X.fmt_bytes, [0.0, 512.0, 1536.0, 1048576.0 * 12.3, 5e9], "double") == ["0B", "512B", "1.5KB", "12.3MB", "4.7GB"]
    assert values(spark, X.fmt_ms, [1500, 0], "long") == ["1.500", "0.000"]
    assert values(spark, X.fmt_pct, [12.34, -5.0, None], "double") == ["+12.3%", "-5.0%", "n/a"]
    assert values(spark, lambda c: X.truncate_chars(c, 3), ["abc", "abcd", "éèêë"]) == ["abc", "abc…", "éèê…"]
    assert values(spark, X.escape_html, ["<a href=\"x\">&'"]) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#39;"]
    assert values(spark, X.rfc3339, [1693569602500000, 1693569602000000], "long") == ["2023-09-01T12:00:02.5Z", "2023-09-01T12:00:02Z"]
    assert X.truncate_bytes("é" * 200) == "é" * 150 + "…" and X.truncate_bytes("x" * 300) == "x" * 300


def test_percent_rounds_ties_to_even(spark):
    rng = random.Random(3)
    x = [0.25, 0.75, -0.25, -0.75, 1.25, 0.15, 0.05, 0.35, -0.45, 1.005, -0.04, 0.0, 2.0**52 + 1, 1e17] + [i / 20 for i in range(-400, 400)] + [rng.uniform(-1e4, 1e4) for _ in range(200)]
    assert values(spark, X.fmt_pct, x, "double") == [f"{v:+.1f}%" for v in x]


def test_urls(spark):
    want = {"mysql://u:secret@h:3306/db": "mysql://u:***@h:3306/db", "mysql://u:p@x:y@h/d": "mysql://u:***@h/d", "mysql://u@h/d": "mysql://u@h/d", "no url": "no url", "mysql://h:3306/a@b": "mysql://h:3306/a@b", "m://u:p#x@h": "m://u:p#x@h"}
    assert dict(zip(want, values(spark, X.redact_url, list(want)), strict=True)) == want


def test_log_parts(spark):
    assert values(spark, X.time_micros, ["2023-09-01T15:00:02.500000+03:00", "230901 12:00:02", "230901  9:00:02", "junk", "2023-13-01T00:00:00Z", "231301 12:00:00"]) == [1693569602500000, 1693569602000000, 1693558802000000, None, None, None]
    assert values(spark, X.set_timestamp_micros, ["SET timestamp=1693569602;", "set TIMESTAMP=1.5;", "SET timestamp=x;"]) == [1693569602000000, 1500000, None]
    assert values(spark, X.use_target, ["use shop;", "USE `my``db`;", "use two words;", "use ``;", "select 1"]) == ["shop", "my`db", None, None, None]
    assert values(spark, lambda c: X.header_value(c, "Schema"), ["# Thread_id: 5 Schema: db  QC_hit: No", "# Schema:  Last_errno: 0", "# Query_time: 1"]) == ["db", None, None]
    assert values(spark, X.header_user, ["app[app] @ app01 [10.0.0.5]  Id:    11", "[root] @ localhost []", "x @ y", "@ h"]) == ["app", "root", "x", None]
    assert values(spark, X.header_thread, ["app[app] @ h []  Id:    11", "a @ b"]) == [11, None]


def test_versions(spark):
    assert values(spark, X.server_family, ["", "8.0.33", "5.5.5-10.11.2-MariaDB", None]) == [None, "MySQL", "MariaDB", None]
    assert values(spark, lambda c: X.display_version(c, F.lit("replayed")), ["5.5.5-10.11.2-MariaDB", "5.5.5-5.6", ""]) == ["10.11.2-MariaDB", "5.5.5-5.6", "unknown"]


def test_values(spark):
    frame = spark.sql("SELECT 'é' a, X'0102' b, 5 c, cast(1 as float) d, 1.5d e, timestamp'2020-01-01 00:00:00' f, cast(null as string) g, cast(12.50 as decimal(6,2)) h, interval '200:00:00' hour to second i, -interval '01:00:00' hour to second j")
    assert list(frame.select(*[X.value_bytes(frame[c], t).alias(c) for c, t in frame.dtypes]).first()) == [2, 2, 8, 4, 8, 26, 0, 5, 16, 16]
    assert values(spark, X.string_literal, ["a'b\\c\nd"]) == ["'a''b\\\\c\\nd'"]
    assert values(spark, X.bytes_literal, [bytearray(b"ab"), bytearray(b"\xff\x00")], "binary") == ["'ab'", "X'FF00'"]


def slow(values, q, bits):
    def high(v):
        k = max(0, v.bit_length() - bits)
        return (((v >> k) + 1) << k) - 1

    def mid(v):
        k = max(0, v.bit_length() - bits)
        return ((v >> k) << k) + ((1 << k) >> 1)

    v = sorted(values)
    n = len(v)
    import math

    return {f"q{x}": high(v[max(1, math.ceil(x * n)) - 1]) for x in q} | {"n": n, "most": high(v[-1]), "mean": sum(map(mid, v)) / n}


def test_histogram_quantiles(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([rng.randint(0, 3000), rng.randint(1, 10**9), 2047, 2048])) for k in "abc" for _ in range(rng.randint(1, 300))] + [("d", 0), ("e", 1 << 50)]
    for digits, bits in ((3, 11), (2, 8)):
        got = hdr.hdr_stats(spark.createDataFrame(rows, "k string, v long"), ["k"], F.col("v"), {"q0.5": 0.5, "q0.95": 0.95, "q0.99": 0.99}, digits, "n", "most", "mean").collect()
        assert len(got) == 5
        for r in got:
            own = [min(v, hdr.MOST[digits]) for k, v in rows if k == r.k]
            assert r.asDict() == {"k": r.k} | slow(own, (0.5, 0.95, 0.99), bits)
