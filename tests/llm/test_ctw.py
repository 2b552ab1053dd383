import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from tracewright.llm import ctw

SCHEMA = "doc_id long, text string, chunk string, bucket int"


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0


def decisions(text, depth):
    """((bits so far, context nearest first), bit) for each binary decision of a text."""
    data = b"\x00" * depth + ctw.spelled(text.encode() if text is not None else None)[1]
    for i in range(depth, len(data)):
        context = tuple(data[i - j] for j in range(1, depth + 1))
        for k in range(8):
            yield ((k, data[i] >> (8 - k)), context), data[i] >> (7 - k) & 1


def brute(rows, depth):
    count = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    words = Counter()
    for d, t, *_ in rows:
        if held(d):
            continue
        words.update((t or "").lower().split() + [None])
        for (bits, context), bit in decisions(t, depth):
            for n in range(depth + 1):
                count[bits, context[:n]][bit] += 1
                if n < depth:
                    children[bits, context[:n]].add((bits, context[: n + 1]))

    def kt(node):
        a, b = count[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    weighted = {}
    share = {}
    for node in sorted(count, key=lambda n: -len(n[1])):
        if len(node[1]) == depth:
            weighted[node] = kt(node)
        else:
            rest = sum(weighted[c] for c in children[node])
            share[node] = 1 / (1 + math.exp(min(700, rest - kt(node))))
            weighted[node] = math.log(0.5) + np.logaddexp(kt(node), rest)

    def one(bits, context):
        p = None
        for n in range(depth, -1, -1):
            node = bits, context[:n]
            if node in weighted:
                own = (count[node][1] + 0.5) / (sum(count[node]) + 1)
                p = own if p is None else share[node] * own + (1 - share[node]) * p
        return 0.5 if p is None else p

    n_all, v = sum(words.values()), len(words)
    out = []
    for d, t, *_ in rows:
        tokens = (t or "").lower().split() + [None]
        base = sum(math.log10((words[w] + 0.1) / (n_all + 0.1 * (v + 1))) for w in tokens)
        score = sum(math.log10(p if bit else 1 - p) for (bits, context), bit in decisions(t, depth) for p in [one(bits, context)])
        out.append((d, held(d), len(tokens), sum(words[w] > 0 for w in tokens), n_all, base, score))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) and abs(a[6] - b[6]) < 1e-5 * max(1, abs(b[6])), (a, b)


def result(frame, **k):
    return sorted((tuple(r) for r in ctw.ctw_scores(frame, **k).collect()), key=lambda r: (r[0] is not None, r))


def test_against_brute_force(spark):
    rng = random.Random(7)
    words = ["the", "The", "thing", "ring", "été", "x" * 12, "a.", "b-b"]
    rows = [(d, rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randint(0, 25))), "c", 1) for d in range(60)]
    rows += [(100, None, None, None), (101, "", "", 0), (None, "ring the thing", "", 0), (3, rows[3][1], "", 0), (3, rows[3][1], "", 0)]
    want = brute(rows, 3)
    close(result(spark.createDataFrame(rows, SCHEMA), depth=3, chunk_bytes=700), want)
    close(result(spark.createDataFrame(rows, SCHEMA), depth=3), want)


def test_no_training_text_and_empty_table(spark):
    held_out = [d for d in range(200) if held(d)][:4]
    rows = [(d, "ab c", "", 0) for d in held_out]
    got = result(spark.createDataFrame(rows, SCHEMA))
    assert all(r[4] == 0 and abs(r[6] - 5 * 8 * math.log10(0.5)) < 1e-4 and r[3] == 0 for r in got)
    assert result(spark.createDataFrame(rows, SCHEMA).limit(0)) == []


def test_probabilities_of_a_context_add_up_to_one():
    keys, counts = np.unique(ctw.grams([b"abracadabra" * 3 + b"\xff", b"banana\xff"], 4), return_counts=True)
    trees = ctw.Trees(keys, counts, 4)
    for key in keys.tolist()[::5] + [0x7A7A7A7A00]:
        every = (np.uint64(key) & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** trees.log10(every)).sum() - 1) < 1e-9


def test_very_long_text(spark):
    rows = [(1, "word " * 300_000, "", 0), (2, "word", "", 0)]
    got = result(spark.createDataFrame(rows, SCHEMA), chunk_bytes=100_000)
    assert [r[2] for r in got] == [300_001, 2]
    assert got[0][6] > -2000


def test_better_than_the_base_on_held_out_texts(spark, sf_dir):
    rows = [r for r in ctw.op6_ctw_scores(spark, sf_dir.replace("sf0.001", "sf0.01")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
