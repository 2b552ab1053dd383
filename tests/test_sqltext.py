import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.functions import sqltext as S

FINGERPRINTS = {
    # numbers, signs, and what only looks like a number
    "select price*1.25 from Goods": "select price*? from goods",
    "FETCH 7 rows": "fetch ? rows",
    "mask & 0XfF": "mask & ?",
    "set z=-3e+7": "set z=?",
    "between .25 and 9.": "between ? and ?",
    "col9x + v2.w3": "col9x + v2.w3",
    "7-2": "?-?",
    "f(-1, +2, - 3)": "f(?, ?, ?)",
    "1..2": "??",
    "p.7 = 3q": "p.? = ?q",
    # quotes
    "insert `My Col` select `X`.`y``z`": "insert `my col` select `x`.`y``z`",
    "v = 'two ''quotes'' -- not a comment'": "v = ?",
    r'v = "back\\slash \" and # hash"': "v = ?",
    "say 'line one\nline two'": "say ?",
    "tail 'never closed": "tail ?",
    "-'txt'": "-?",
    # lists
    "k in (9)": "k in (?+)",
    "k IN ( 'a','b' , 3.5 )": "k in (?+)",
    "k in(4,5) or m in (select n from o where p in (6, 7))": "k in (?+) or m in (select n from o where p in (?+))",
    "margin (1, 2)": "margin (?, ?)",
    "replace r VALUES (1,2),(3,4) , (5,6)": "replace r values (?+)",
    "replace r values (now(), 8)": "replace r values (now(), ?)",
    # white space, comments, ends
    "\n\tA\r\n  B ": "a b",
    "A/* x */B": "a b",
    "A -- rest 5\nB # 6\nC": "a b c",
    "a--b": "a--b",
    "Done ; ; \n;": "done",
    "/**/ x /* y": "x",
    "Ünï 5": "Ünï ?",
    " ": "",
}
READS = [
    "select 7", "\n\tSELECT x FROM y", "/* why */ select a", "# note\nselect a", "((select 3))", "show tables", "HELP 'x'", "explain delete from z", "DESCRIBE z", "desc z y",
    "explain analyze select b from c", "EXPLAIN ANALYZE format=json select b from c", "explain analyze with r as (select 2) select * from r", "explain analyze table c", "select 'x into outfile y'", "select p into @q from r", "use warehouse",
    "set names latin1", "SET @n := 5", "set session sort_buffer_size = 9", "select 4 ;", "select \"a;b\"", "with r as (select 2), s as (select 3) select * from r, s", "select /* delete from z */ 5", "/*! select 6 */", "select /*!80000 straight_join */ 6", "select 8; # that is all", "explain", "set",
]
WRITES = [
    "delete from z", "Replace into z values (3)", "truncate z", "create table z (y int)", "call p(4)", "start transaction", "rollback", "set global read_only = 1", "SET PERSIST_ONLY x = 2", "set password for u = 'p'", "set default role r to u", "select 5; delete from z",
    "with r as (select 2) delete from z where y in (select * from r)", "explain analyze insert into z values (1)", "explain analyze format=tree update z set y = 1", "explain analyze with r as (select 1) update z set y = 2", "select y from z into outfile '/a'", "select y into dumpfile '/b' from z", "with r as (select 1) select * from r into outfile '/c'",
    "do sleep(3)", " ", "/*!50000 drop table z */", "select 3 /*!; drop table z */", "explain analyze", "with r as (select 4)", "\"select 1\"", "lock tables z read",
]
VOLATILE = ["select a, now ( )", "select current_date", "where x < rand()", "select unix_timestamp( )", "select @@hostname", "select uuid()", "select * from performance_schema.threads", "select q from r limit ?, ?", "select 3sysdate()", "select localtime from u"]
STABLE = ["select q from r where s = ?", "select q from r order by s limit ?", "select unix_timestamp(s) from r", "select `rand`(), s from r", "select nowadays from r", "select uuid_col from r", "select x from versions", "select '@@x'", "select `limit` from r"]


def native(spark, f, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", f(F.col("s")).alias("x"))
    return [r.x for r in sorted(frame.collect(), key=lambda r: r.i)]


def test_fingerprints(spark):
    assert {q: S.fingerprint_text(q) for q in FINGERPRINTS} == FINGERPRINTS
    assert dict(zip(FINGERPRINTS, native(spark, S.fingerprint, list(FINGERPRINTS)), strict=True)) == FINGERPRINTS


def test_classes(spark):
    want = {q: "read" for q in READS} | {q: "write" for q in WRITES}
    assert {q: S.classify_text(q) for q in want} == want
    assert dict(zip(want, native(spark, S.classify, list(want)), strict=True)) == want


def test_use_and_gate(spark):
    want = {"use stock": True, "USE `a b` ;": True, "-- c\n use stock": True, "select 'use stock'": False, "users": False, "(use stock": True, "": False, "é use x": True}
    assert {q: S.is_use_text(q) for q in want} == want
    assert dict(zip(want, native(spark, S.is_use, list(want)), strict=True)) == want
    assert S.should_execute_text("truncate z", True) and not S.should_execute_text("truncate z", False)


def test_nondeterminism(spark):
    want = {q: True for q in VOLATILE} | {q: False for q in STABLE}
    assert {q: S.is_nondeterministic_text(q) for q in want} == want
    assert dict(zip(want, native(spark, S.is_nondeterministic, list(want)), strict=True)) == want


PIECES = st.sampled_from(["select", " ", "1", "-", "+", ".", "e5", "0x1F", "'", '"', "`", "\\", "--", "#", "\n", "/*", "*/", "/*!50", ";", "(", ")", ",", "IN", "values", "?", "é", "$", "_a", "@@", "into", "outfile", "with", "update", "explain", "analyze", "limit", "order", "now", "unix_timestamp", "set", "global", "=", "\x0b", " ", "𝒳"])


@pytest.mark.parametrize("name", ["fingerprint", "classify", "is_use", "is_nondeterministic"])
def test_column_form_equals_python_form(spark, name):
    found = set()

    @settings(max_examples=600, deadline=None, database=None)
    @given(st.lists(PIECES, max_size=14).map("".join))
    def gather(text):
        found.add(text)

    gather()
    texts = sorted(found)
    python, column = getattr(S, f"{name}_text"), getattr(S, name)
    got = native(spark, column, texts)
    assert [(t, g) for t, g in zip(texts, got, strict=True) if g != python(t)] == []


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=12).map("".join))
def test_fingerprint_ignores_case_and_outer_space(text):
    assert S.fingerprint_text(f"  \n{text.upper() if text.isascii() else text}\t ") == S.fingerprint_text(f"{text}" if not text.isascii() else text.upper()) or "'" in text or '"' in text or "`" in text or "--" in text or "#" in text or "/*" in text


def test_long_literal(spark):
    text = "select '" + "a''b\\' " * 200_000 + "' from t where x in (" + ", ".join(["1"] * 50_000) + ")"
    assert native(spark, S.fingerprint, [text]) == ["select ? from t where x in (?+)"] == [S.fingerprint_text(text)]


def test_registered_functions(spark):
    S.register(spark)
    row = spark.sql("select sql_fingerprint('SELECT 1') f, sql_classify('drop table x') c, sql_is_use('use x') u, is_nondeterministic('select now()') n").first()
    assert tuple(row) == ("select ?", "write", True, True)
