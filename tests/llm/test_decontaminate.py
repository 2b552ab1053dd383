import random
import re

import pytest

from tracewright.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string, item_id string, w int, h string", "item_id long, text string, doc_id string, shingle string"


def words(text):
    return [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]


def grams(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items):
    have, need = {}, {}
    for d, t, *_ in docs:
        if d is not None:
            for k in range(1, 6):
                have.setdefault(d, {}).setdefault(k, set()).update(grams(words(t), k))
    for i, t, *_ in items:
        w = words(t)
        if i is not None and w:
            need.setdefault(i, set()).update((min(5, len(w)), g) for g in grams(w, min(5, len(w))))
    out = {}
    for d, sets in have.items():
        for i, n in need.items():
            shared = sum(g in sets[k] for k, g in n)
            if shared >= 0.8 * len(n) - 1e-9:
                out[d, i] = (len(n), shared)
    return out


def result(spark, docs, items):
    rows = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert all(abs(r.containment - r.n_shared / r.n_item) < 1e-12 for r in rows)
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
    return {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in rows}


def case():
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(60)] + ["Été", "x"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 20, 70, 300])))) for i in range(40)]
    docs = []
    for d in range(120):
        text = [rng.choice(pool) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            w = items[rng.randrange(40)][1].split()
            cut = rng.choice([0, 0, len(w) // 12, len(w) // 5, len(w) // 3])
            w = w[cut:]
            if len(w) > 20 and rng.random() < 0.4:
                w[rng.randrange(len(w))] = "CHANGED"
            text += w + [rng.choice(pool)]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(text).upper() if d % 3 else " ".join(text), "c", 1, "h"))
    return docs, [(*i, "c", "s") for i in items]


@pytest.mark.parametrize("most", [10**6, 10])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    docs, items = case()
    want = brute(docs, items)
    assert len(want) > 150 and any(s < n for n, s in want.values())
    assert result(spark, docs, items) == want


def test_edge_cases(spark):
    items = [(1, None, "", ""), (2, "", "", ""), (3, "!!", "", ""), (4, "One two", "", ""), (5, "a b c d e f", "", ""), (5, "a b c d e f", "", ""), (None, "a b", "", ""), (6, "alone", "", "")]
    docs = [(1, None, "", 0, ""), (2, "", "", 0, ""), (3, " ", "", 0, ""), (4, "zero one-two three", "", 0, ""), (5, "x " * 200_000 + "A b C d e f", "", 0, ""), (None, "one two", "", 0, ""), (6, "alone", "", 0, ""), (6, "alone", "", 0, ""), (7, "a b c d", "", 0, "")]
    want = brute(docs, items)
    assert set(want) == {(4, 4), (5, 5), (6, 6)}
    assert result(spark, docs, items) == want
    frame, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    kept = decontaminate.clean(frame, marks)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 3), (False, 7)]  # a row without doc_id is judged by its text
    assert decontaminate.contaminated(frame.limit(0), marks).count() == 0
    assert decontaminate.contaminated(frame, marks.limit(0)).count() == 0
    assert decontaminate.clean(frame, marks.limit(0)).count() == len(docs)


def test_plan_has_no_python(spark, sf_dir):
    plan = decontaminate.op1_decontamination(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)
