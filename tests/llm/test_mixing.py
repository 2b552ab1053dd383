import hashlib
import math
import random
import re
from collections import defaultdict

from tracewright.llm import mixing

SCHEMA = "doc_id long, text string, source string, name string, block int, h string"


def brute(rows, weights=None, block_chars=1 << 16, resolution=1000):
    by = defaultdict(list)
    for d, t, s, *_ in rows:
        by[s].append((hashlib.md5((("" if d is None else str(d)) + "|" + hashlib.md5((t or "").encode()).hexdigest()).encode()).hexdigest(), d is not None, d, len(t or ""), s))
    order = sorted(by, key=lambda s: "n" if s is None else "s" + s)
    chars = {s: sum(x[3] for x in by[s]) for s in by}
    r = {s: math.isqrt(chars[s]) if weights is None else int(weights.get(s, 0) * 10**9 / sum(weights.values())) for s in by}
    q, total = max(resolution, 16 * len(by)), max(1, sum(r.values()))
    n = {s: max(1, r[s] * q // total) for s in by}
    left = q - sum(n.values())
    for s in sorted(by, key=lambda s: (-(r[s] * q % total), order.index(s)))[: max(0, left)]:
        n[s] += 1
    for s in sorted(by, key=lambda s: (-n[s], order.index(s)))[: max(0, -left)]:
        n[s] -= 1
    assert sum(n.values()) == q
    done, slot = dict.fromkeys(by, 0), {}
    for t in range(q):
        _, _, s = min((-(-(done[s] + 1) * q // n[s]), order.index(s), s) for s in by if done[s] < n[s] and done[s] * q // n[s] <= t)
        slot[s, done[s]] = t
        done[s] += 1
        for x in by:
            assert abs(done[x] - n[x] * (t + 1) / q) < 1
    out = []
    for s in by:
        start = 0
        for _, _, d, size, _ in sorted(by[s]):
            b = start // block_chars
            j, k = b % n[s], b // n[s]
            out.append((d, s, b, k * q + j * q // n[s], k * q - (-(j + 1) * q // n[s]), k * q + slot[s, j], start))
            start += size
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def case():
    rng = random.Random(6)
    return [(i, "x" * rng.randint(0, 900), rng.choice(["a"] * 6 + ["b", "b", "c", "Ü", None]), "n", 0, "h") for i in range(700)]


def test_against_brute_force(spark):
    frame = spark.createDataFrame(case(), SCHEMA)
    for k in ({"block_chars": 1000, "resolution": 50}, {"block_chars": 300, "resolution": 97, "weights": {"a": 0.2, "b": 0.5, None: 0.3}}, {"block_chars": 700, "resolution": 10}):
        got = [tuple(r) for r in mixing.schedule(frame, **k).collect()]
        assert sorted(got, key=key) == sorted(brute(case(), **k), key=key)
        assert all(r[3] <= r[5] < r[4] for r in got)


def test_pieces_do_not_change_the_schedule(spark, monkeypatch):
    frame = spark.createDataFrame(case(), SCHEMA)
    want = sorted((tuple(r) for r in mixing.schedule(frame, block_chars=500).collect()), key=key)
    monkeypatch.setattr(mixing, "PIECE_ROWS", 0.01)
    assert sorted((tuple(r) for r in mixing.schedule(frame, block_chars=500).collect()), key=key) == want


def test_edge_cases(spark):
    rows = [(1, None, None, "", 0, ""), (2, "", "a", "", 0, ""), (None, "abc", "a", "", 0, ""), (3, "x" * 1_000_000, "a", "", 0, ""), (4, "y", "a", "", 0, ""), (4, "y", "a", "", 0, ""), (5, "z", "", "", 0, "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in mixing.schedule(frame).collect()), key=key) == sorted(brute(rows), key=key)
    assert sorted(map(str, mixing.mixed(frame).collect())) == sorted(map(str, frame.collect()))
    assert mixing.mixed(frame).columns == frame.columns
    assert mixing.schedule(frame.limit(0)).count() == 0 and mixing.mixed(frame.limit(0)).count() == 0


def test_written_order_is_the_mix(spark, tmp_path):
    frame = spark.createDataFrame(case(), SCHEMA)
    slots = {r.doc_id: (r.slot, r.start) for r in mixing.schedule(frame, block_chars=1000, resolution=50).collect()}
    mixing.mixed(frame, block_chars=1000, resolution=50).write.parquet(str(tmp_path / "mix"))
    order = []
    for f in sorted((tmp_path / "mix").glob("part-*")):
        order += [slots[r.doc_id][0] for r in spark.read.parquet(str(f)).coalesce(1).collect()]
    assert order == sorted(order) and len(order) == 700


def test_plan_has_no_python(spark, sf_dir):
    for df in (mixing.op5_pfair_mixing(spark, sf_dir), mixing.mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))):
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", df._jdf.queryExecution().executedPlan().toString())


def test_sources_of_a_tail_keep_their_documents(spark):
    """Shares that are raised to one slot never lose it to the rounding of the others."""
    empty = [(i, "x" * 1000, "a", "", 0, "") for i in range(1000)] + [(2000, "", "b", "", 0, ""), (2001, None, "c", "", 0, "")]
    tail = [(i, "x" * 100_000, "hot", "", 0, "") for i in range(100)] + [(1000 + i, "y" * 5, f"s{i:02}", "", 0, "") for i in range(50)]
    mixed = [(i, "x" * 10_000, "hot", "", 0, "") for i in range(100)] + [(200 + i, "x" * 20, f"m{i}", "", 0, "") for i in range(3)] + [(300 + i, "y", f"s{i:02}", "", 0, "") for i in range(30)]
    for rows in (empty, tail, mixed):
        frame = spark.createDataFrame(rows, SCHEMA)
        got = mixing.schedule(frame).collect()
        assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
        assert all(r.release <= r.slot < r.deadline for r in got)
        assert mixing.mixed(frame).count() == mixing.slotted(frame).count() == len(rows)


def test_shares_fill_the_period(spark):
    """Every source has a slot at least and the slots of a period are given out whole; rounds take from all shares above one."""
    sizes = {"a": 10**6, "b": 9 * 10**4, "c": 4 * 10**4} | {f"t{i:02}": 0 for i in range(40)}
    totals = spark.createDataFrame(list(sizes.items()), "name string, chars long")
    for weights in (None, {"a": 0.98, "b": 0.01, "c": 0.01}):
        named = totals if weights is None else totals.selectExpr("concat('s', name) AS name", "chars")
        slots = mixing.period(named, weights, 100).collect()
        assert len(slots) == slots[0].q == 16 * 43 and len({r.slot for r in slots}) == len(slots)
        n = {r.name: r.n for r in slots}
        assert len(n) == 43 and sum(n.values()) == 16 * 43 and min(n.values()) == 1
