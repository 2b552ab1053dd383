import hashlib
import random

import pytest

from tracewright.llm import substring

SCHEMA = "doc_id long, text string, print string, sha int"


def brute(rows):
    first, out = {}, []
    docs = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    for d, words in docs:
        for i in range(len(words) - 49):
            key = tuple(words[i : i + 50])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    for d, words in docs:
        gone = [False] * len(words)
        for i in range(len(words) - 49):
            if d is not None and first[tuple(words[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((d, len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def result(frame, **k):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(frame, **k).collect()), key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("batches", [1, 3])
def test_against_brute_force(spark, batches):
    rng = random.Random(5)
    words = [f"w{i}é" for i in range(400)] + ["A", "a"]
    passages = [[rng.choice(words) for _ in range(rng.choice([49, 50, 51, 80, 200]))] for _ in range(8)]
    rows = []
    for _ in range(150):
        text = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            cut = rng.choice([0, 0, 0, 5, 30])
            text += [rng.choice(words) for _ in range(rng.randint(0, 30))] + p[cut:]
        rows.append((rng.randrange(10**6), rng.choice([" ", "\n\t"]).join(text), "x", 1))
    rows += [(rng.randrange(10**6), rows[3][1], "x", 1) for _ in range(10)]
    got = result(spark.createDataFrame(rows, SCHEMA), batches=batches)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 1000


def test_edge_cases(spark):
    same = " ".join(f"x{i}" for i in range(60))
    rows = [(1, None, "", 0), (2, "", "", 0), (3, " \n", "", 0), (4, same, "", 0), (5, same, "", 0), (5, same, "", 0), (None, same, "", 0), (6, same[:-4], "", 0), (7, "z " * 200_000, "", 0), (8, "z " * 50, "", 0), (9, "y", "", 0), (9, same + " more", "", 1)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert result(spark.createDataFrame(rows, SCHEMA).limit(0)) == []


def test_long_words_and_segments():
    rng = random.Random(2)
    text = b" ".join(bytes(rng.choice(b"abcdef") for _ in range(rng.randint(1, 9))) for _ in range(3000)) + b" " + b"q" * 5000 + b" end"
    whole = substring.word_hashes(text)
    old, substring.SEGMENT = substring.SEGMENT, 100
    try:
        assert (substring.word_hashes(text) == whole).all()
    finally:
        substring.SEGMENT = old
    assert len(set(whole.tolist())) == len(set(text.split()))


def pairs(spark, rows):
    return spark.createDataFrame(rows, "print long, doc_id long")


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_index_over_batches(spark):
    index = substring.FingerprintIndex(spark, fan=2)
    assert rows_of(index.ingest(pairs(spark, [(1, 10), (2, 10), (3, 11), (3, 12)]))) == [(3, 11), (3, 12)]
    assert rows_of(index.ingest(pairs(spark, [(1, 5), (4, 20), (2, 10)]))) == [(1, 5), (1, 10)]
    assert index.runs == ["run-000000", "run-000001"]
    assert rows_of(index.ingest(pairs(spark, [(4, 30), (5, 30), (1, 40), (3, 9)]))) == [(1, 40), (3, 9), (4, 20), (4, 30)]
    assert index.runs == ["run-000003"]  # three runs have become one
    assert rows_of(index.history()) == [(1, 5, True), (2, 10, False), (3, 9, True), (4, 20, True), (5, 30, False)]
    index.vacuum()
    assert rows_of(index.history().select("print")) == [(1,), (2,), (3,), (4,), (5,)]
    assert rows_of(index.ingest(pairs(spark, [(5, 31), (5, 32)]))) == [(5, 30), (5, 31), (5, 32)]


def test_index_is_opened_again(spark):
    first = substring.FingerprintIndex(spark)
    first.ingest(pairs(spark, [(1, 10), (2, 10)]))
    spark.conf.set("spark.sql.shuffle.partitions", "5")  # another session may have its own number
    try:
        again = substring.FingerprintIndex(spark, first.path)
        assert (again.buckets, again.runs, again.version) == (first.buckets, first.runs, first.version) == (8, ["run-000000"], 1)
        assert rows_of(again.ingest(pairs(spark, [(2, 11), (3, 11)]))) == [(2, 10), (2, 11)]
        assert substring.FingerprintIndex(spark, first.path).runs == ["run-000000", "run-000001"]
        assert spark.conf.get("spark.sql.shuffle.partitions") == "5"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tracewright_")]


def test_runs_are_joined_as_they_lie(spark):
    """Neither a shuffle nor a sort stands above a run in a merge join, and none above runs that are merged but that of the batch."""
    index = substring.FingerprintIndex(spark, fan=5)
    for k in range(2):
        index.ingest(pairs(spark, [(i, k) for i in range(100)]))
    with index._settings():
        own = pairs(spark, [(1, 2)]).groupBy("print").agg({"doc_id": "min"})
        plan = own.join(index.run(index.runs[0]).hint("merge"), "print", "left")._jdf.queryExecution().executedPlan().toString()
        merged = index.history()._jdf.queryExecution().executedPlan().toString()
    right = plan[plan.index("SortMergeJoin") :].split("FileScan")[0].splitlines()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    assert not any("Sort " in x or "Exchange" in x for x in right[-3:])
    assert "Exchange" not in merged


def test_what_is_removed_is_compared_word_by_word():
    words = [b"w%d" % i for i in range(120)]
    blocks = lambda x: {(7, k): [x[k * 64 : (k + 1) * 64]] for k in range(2)}
    whole = [(0, 71, 7, 0)]  # as if all windows had the hash of the source's
    assert substring.covered(words, whole, blocks(words)).all()
    other = [*words[:60], b"x", *words[61:]]
    assert substring.covered(words, whole, blocks(other)).tolist() == [True] * 60 + [False] + [True] * 59
    assert not substring.covered(words, whole, blocks(words[1:])).any()
    assert not substring.covered(words, whole, {}).any()
    assert substring.covered(words, whole, {(7, 0): [other[:64], words[:64]], (7, 1): [words[64:]]}).all()


def test_one_doc_id_with_several_texts(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(2, f"a {passage} b", "", 0), (2, f"{passage} c", "", 0), (1, f"x y {passage}", "", 0), (3, f"{passage} d", "", 0), (2, "short", "", 0)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_incremental_batches_against_one(spark):
    """An index that stays: what a later batch shares with an earlier one is found without the earlier one's rows."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(9)}" if rng.random() < 0.2 else f"p{i}" for i in range(rng.randint(40, 120))) for _ in range(40)]
    rows = [(i, t, "", 0) for i, t in enumerate(texts)]
    index = substring.FingerprintIndex(spark)
    assert result(spark.createDataFrame(rows, SCHEMA), index=index, batches=5) == brute(rows)
    assert len(index.runs) <= index.fan and index.history().count() > 0


def test_repeated_rows_that_lose_a_part(spark):
    """Rows of one document, as they are or with other white space, are cut alike and stay as many as they were."""
    passage, own = " ".join(f"p{i}" for i in range(60)), " ".join(f"o{i}" for i in range(20))
    rows = [(1, passage, "", 0)] + [(2, f"{own} {passage}", "", 0)] * 3 + [(2, f"{own}\n{passage}", "", 0), (3, f"{own} {passage}", "", 0), (None, f"{own} {passage}", "", 0)]
    got = result(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows)
    assert [r[2] for r in got] == [0, 0, 60, 60, 60, 60, 80]
