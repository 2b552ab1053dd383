import math
import random

import numpy as np

from tracewright.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, ids string, leaf int"


def brute(rows, every=50, k=5):
    good = {(d, tuple(v)) for d, v, *_ in rows if d is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    good = sorted(((d, np.array(v, np.float32).astype(float)) for d, v in good), key=lambda x: x[0])
    out = {}
    for q in {d for d, _ in good if d % every == 0}:
        near = {}
        for v in (v for d, v in good if d == q):
            for d, w in good:
                if d != q and len(v) == len(w):
                    near[d] = max(near.get(d, -9.0), round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12))
        if near:
            out[q] = [(d, c) for c, d in sorted((-c, d) for d, c in near.items())[:k]]
            out[q] = [(d, -c) for d, c in out[q]]
    return out


def result(frame, **k):
    out = {}
    for r in sorted(ann.neighbours(frame, **k).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 12)))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({d for d, _ in got.get(q, [])} & {d for d, _ in w}) for q, w in want.items()) / max(1, sum(map(len, want.values())))


def test_few_rows_are_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], 0, "", 0) for i in range(30)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert result(frame, every=5) == {q: [(d, round(c, 12)) for d, c in w] for q, w in brute(rows, every=5).items()}


def test_copies_ties_and_odd_rows(spark):
    rng = random.Random(2)
    same, other = [1.0, 2.0, -1.0, 0.5], [1.0, 2.0, -1.0, 0.25]
    rows = [(i, same, 0, "", 0) for i in range(0, 400, 2)] + [(i, other if i % 3 else [rng.gauss(0, 1) for _ in range(4)], 0, "", 0) for i in range(1, 400, 2)]
    rows += [(500, None, 0, "", 0), (550, [], 0, "", 0), (600, [0.0] * 4, 0, "", 0), (650, [1.0, None, 1.0, 1.0], 0, "", 0), (700, [1.0, float("nan"), 0.0, 0.0], 0, "", 0), (750, [float("inf"), 0.0, 0.0, 0.0], 0, "", 0), (None, same, 0, "", 0), (800, [1.0, 2.0], 0, "", 0), (2, same, 1, "", 0)]
    want = brute(rows)
    got = result(spark.createDataFrame(rows, SCHEMA))
    assert {q: [d for d, _ in w] for q, w in got.items()} == {q: [d for d, _ in w] for q, w in want.items()}
    assert [d for d, _ in got[0]] == [2, 4, 6, 8, 10] and [d for d, _ in got[100]] == [0, 2, 4, 6, 8]


def test_lengths_large_numbers_and_several_vectors(spark):
    """Each length has its own neighbours, squares do not overflow, and a vec_id with two vectors has one list."""
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4 if i % 3 else 6)], 0, "", 0) for i in range(200)]
    rows += [(50, [rng.gauss(0, 1) for _ in range(4)], 0, "", 0), (100, [rng.gauss(0, 1) for _ in range(6)], 0, "", 0)]
    got, want = result(spark.createDataFrame(rows, SCHEMA)), brute(rows)
    assert {q: [d for d, _ in w] for q, w in got.items()} == {q: [d for d, _ in w] for q, w in want.items()}
    wide = spark.createDataFrame([(d, [x * 1e200 if d % 2 else x * 1e-200 for x in v]) for d, v, *_ in rows if len(v) == 4 and d != 50], "vec_id long, embedding array<double>")
    plain = [r for r in rows if len(r[1]) == 4 and r[0] != 50]
    scaled = {q: [d for d, _ in w] for q, w in result(wide).items()}
    assert scaled == {q: [d for d, _ in w] for q, w in result(spark.createDataFrame([(r[0], [float(x) for x in r[1]]) for r in plain], "vec_id long, embedding array<double>")).items()}


def test_fewer_candidates_than_wanted_and_empty(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0], 0, "", 0), (50, [0.0, 1.0], 0, "", 0), (7, [1.0, 1.0], 0, "", 0)], SCHEMA)
    assert {q: [d for d, _ in w] for q, w in result(frame).items()} == {0: [7, 50], 50: [7, 0]}
    assert result(frame.limit(0)) == {}
    assert result(frame.limit(1)) == {}


def test_recall_over_many_leaves(spark, sf_dir, monkeypatch):
    frame = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in frame.collect()])
    monkeypatch.setattr(ann, "BLOCK", 64)
    got = result(frame)
    assert set(got) == set(want) and all(len(w) == 5 for w in got.values())
    assert recall(got, want) >= 0.95
    index = ann.Index(ann.usable(frame))
    assert len(index.tree.leaves) > 20
    few = index.search(index.rows.where("vec_id % 50 = 0").selectExpr("vec_id query_id", "embedding"), visits=1)
    assert few.count() == 5 * len(want)
