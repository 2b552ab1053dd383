import random

import xxhash
from pyspark.sql import functions as F

from tracewright.llm import simhash
from tracewright.llm.graph import connected_components

SCHEMA = "doc_id long, text string, print string, extra int"


def fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split(" ")
    words = [w for part in words for w in part.replace("\t", "\n").replace("\r", "\n").replace("\x0b", "\n").replace("\x0c", "\n").split("\n") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """doc_id -> smallest doc_id reachable, by comparing all pairs."""
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in prints}


def check(spark, rows):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = {r[0]: fingerprint(r[1]) for r in rows}
    parts = components(prints)
    assert got == {d: (f"{prints[d]:016x}", parts[d]) for d in prints}


def test_masks_cover_every_pair_of_bits():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i in range(64) for j in range(64))


def test_against_all_pairs(spark):
    rng = random.Random(1)
    words = [f"Wörd{i}" for i in range(300)]
    rows = []
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 60, 400]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            if len(copy) > 50:
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows) * 3 % 1000, rng.choice([" ", "\n", "\t"]).join(copy), "x", k))
    check(spark, rows)


def test_edge_cases(spark):
    check(spark, [(1, None, None, None), (2, "", "a", 1), (3, " \n\t", "b", 2), (4, "A b", "c", 3), (5, "a B", "c", 3), (6, " ", "d", 4), (7, "w " * 100_000, "e", 5)])


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "one two three four", "x", 1)] * 3 + [(2, "one two three four", "x", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert [r.component_id for r in simhash.near_duplicates(frame).collect()] == [1] * 4
    assert [r.doc_id for r in simhash.keep_one(frame).collect()] == [1]
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_rows_that_share_a_doc_id(spark):
    """Different texts under one doc_id, or none, are judged each for itself, and the result is the same in every run."""
    a, b, c = ("one two three four five", "a wholly different text it is", "and here a third one")
    rows = [(5, a, "x", 1), (5, b, "x", 1), (5, b, "y", 2), (6, b, "x", 1), (None, c, "x", 1), (None, c, "z", 1), (None, "and a fourth text of its own", "x", 1), (7, a.upper(), "x", 1)]
    kept = [sorted(map(str, simhash.keep_one(spark.createDataFrame(rows[k:] + rows[:k], SCHEMA)).collect())) for k in (0, 3)]
    assert kept[0] == kept[1]
    assert sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()) == sorted([(5, a), (5, b), (0, c), (0, "and a fourth text of its own")])


def test_links_of_one_large_bucket(spark):
    """All fingerprints within two bits of one value meet in one component."""
    prints = [0] + [1 << i for i in range(63)] + [(1 << i) | (1 << j) for i in range(0, 60, 7) for j in range(i + 1, 62, 11)]
    frame = spark.createDataFrame([(p,) for p in prints], "print long")
    parts = connected_components(simhash.links(frame))
    assert parts.select("component").distinct().count() == 1
    assert parts.count() == len(set(prints))


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)}


def jaccard_pairs(rows):
    """Pairs of rows whose 5-word shingles have a similarity of 0.8, by comparing all."""
    sets = {}
    for d, text, *_ in rows:
        w = (text or "").lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


def test_keep_one_drops_near_copies(spark):
    """Texts of similarity 0.8 and more are copies, however many bits their fingerprints differ in; less similar ones stay."""
    rng = random.Random(8)
    words = [f"word{i}" for i in range(3000)]
    rows = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([30, 100, 400]))]
        for changed in (0, 1, 2, 4, 20):
            copy = list(base)
            for at in rng.sample(range(len(copy)), changed * len(copy) // 250 + (changed > 0)):
                copy[at] = "changed"
            rows.append((len(rows), " ".join(copy), "x", 0))
    prints = {r[0]: fingerprint(r[1]) for r in rows}
    pairs = jaccard_pairs(rows)
    assert sum((prints[a] ^ prints[b]).bit_count() > 2 for a, b in pairs) > 50
    root = dict(components(prints))
    for _ in range(9):
        for a, b in pairs | {(c, d) for d, c in root.items()}:
            low = min(root[a], root[b])
            root = {d: low if c in (root[a], root[b]) else c for d, c in root.items()}
    kept = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA), similar=True).collect())
    assert kept == sorted(d for d, c in root.items() if c == d)


def test_near_copies_in_a_large_group(spark):
    """A group of many copies, each with a change of its own, becomes one; texts that only share a passage stay apart."""
    base = [f"b{i}" for i in range(300)]
    rows = [(i, " ".join([*base[: i % 290], f"own{i}", *base[i % 290 + 1 :]]), "x", 0) for i in range(500)]
    rows += [(1000 + i, " ".join([*base[:60], *(f"u{i}x{j}" for j in range(60))]), "x", 0) for i in range(40)]
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA), similar=True).collect()) == [0, *range(1000, 1040)]
