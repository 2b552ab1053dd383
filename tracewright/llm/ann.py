"""Operator 8: approximate nearest neighbours with a hierarchical k-means tree.

Equal vectors are one entry, which keeps the smallest ids that a result can name; a group of copies, of any size, costs one entry.
A tree of k-means splits is fitted at the driver on a bounded sample of FIT entries, and every entry goes to the leaf that it
descends to. A query walks the tree best bin first: a priority queue holds the nodes met so far by the cosine to their centres, the best is
opened, and leaves are visited in the order in which they come up.

How many leaves are visited is calibrated: for CALIBRATE of the queries the true neighbours over all entries are found by comparing
with every entry, and visits are widened until the leaves visited hold TARGET of them. A query goes on beyond that until its leaves
hold enough rows for a full result.

Leaves are searched in blocks: entries and queries of a leaf are dealt to as many salts as keep a block at BLOCK rows a side, so a
leaf that holds a large part of the data is shared by many tasks. Cosines are in double precision on the original vectors.

Cases: vectors that are null, empty, zero or have null or non-finite components, and rows without vec_id, take no part. Vectors of different
lengths have no cosine; each length is indexed by itself. Rows with the same vec_id are never each other's neighbours; a query_id with
several vectors gets the best over all of them. Vectors of any length are compared whole. With fewer
candidates than wanted all are returned. Ties go to the smaller vec_id. Repeated rows count once. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.common import materialize, table, tuned

FIT, BRANCH, LEAF, ROUNDS, SEED = 20_000, 12, 16, 8, 1
CALIBRATE, TARGET, BLOCK = 100, 0.98, 2048


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), 5e-324)  # else squares of very large and small numbers overflow or vanish
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class Tree:
    """Nodes of a k-means tree over unit vectors: ``children`` has the nodes below each, none below a leaf."""

    def __init__(self, sample: np.ndarray):
        self.centres, self.children = [np.zeros(sample.shape[1])], [[]]
        rng = np.random.default_rng(SEED)
        open_ = [(0, sample)]
        while open_:
            node, rows = open_.pop()
            if len(rows) <= LEAF * 2:
                continue
            k = min(BRANCH, len(rows) // LEAF)
            part = self._split(rows, k, rng)
            for j in np.unique(part):
                own = rows[part == j]
                if len(own) == len(rows):
                    break
                self.centres.append(_units(own.mean(axis=0, keepdims=True))[0])
                self.children.append([])
                self.children[node].append(len(self.centres) - 1)
                open_.append((len(self.centres) - 1, own))
        self.centres = np.array(self.centres)
        self.leaves = [i for i, c in enumerate(self.children) if not c]

    @staticmethod
    def _split(rows: np.ndarray, k: int, rng) -> np.ndarray:
        centres = rows[rng.choice(len(rows), k, replace=False)]
        for _ in range(ROUNDS):
            part = (rows @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, part, rows)
            alive = np.bincount(part, minlength=k) > 0
            centres[alive] = _units(sums[alive])
        return (rows @ centres.T).argmax(axis=1)

    def leaf_of(self, units: np.ndarray) -> np.ndarray:
        """The leaf that each row descends to."""
        out = np.zeros(len(units), np.int64)
        open_ = [(0, np.arange(len(units)))]
        while open_:
            node, rows = open_.pop()
            below = self.children[node]
            if not below:
                out[rows] = node
            elif len(rows):
                best = (units[rows] @ self.centres[below].T).argmax(axis=1)
                open_ += [(child, rows[best == j]) for j, child in enumerate(below)]
        return out

    def visits(self, unit: np.ndarray):
        """Leaves, the most promising first."""
        near = self.centres @ unit
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if not below:
                yield node
            for child in below:
                heapq.heappush(queue, (-near[child], child))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", odd) & F.exists("embedding", lambda x: x != 0))


def _assign(sent):
    def assign(batches):
        for batch in batches:
            leaf = sent.value.leaf_of(_units(_matrix(batch.column("embedding")))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.record_batch([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    return assign


def _walk(sent, visits: int, sizes: dict[int, int], wanted: int):
    """The leaves that each query visits."""

    def walk(batches):
        for batch in batches:
            rid, leaf = [], []
            for r, unit in zip(batch.column("rid").to_pylist(), _units(_matrix(batch.column("embedding"))) if batch.num_rows else [], strict=True):
                seen = rows = 0
                for node in sent.value.visits(unit):
                    if seen >= visits and rows >= wanted:
                        break
                    seen += 1
                    if node in sizes:
                        rows += sizes[node]
                        rid.append(r)
                        leaf.append(node)
            yield pa.record_batch([pa.array(rid, pa.int64()), pa.array(leaf, pa.int64())], ["rid", "leaf"])

    return walk


def _nearest(cosines: np.ndarray, ids: list[list[int]], wanted: int) -> list[tuple[float, int]]:
    """The ``wanted`` best (cosine, id), ties to the smaller id; every entry has its smallest ids, which suffice."""
    best = np.arange(len(cosines))
    if len(cosines) > wanted:
        best = np.flatnonzero(cosines >= np.partition(cosines, len(cosines) - wanted)[len(cosines) - wanted])
    return sorted(((-cosines[i], v) for i in best.tolist() for v in ids[i]))[:wanted]


def _block(wanted: int):
    def search(entries: pa.Table, queries: pa.Table) -> pa.Table:
        rid, ids, cosines = [], [], []
        if entries.num_rows and queries.num_rows:
            units = _units(_matrix(entries.column("embedding").combine_chunks()))
            own = entries.column("ids").to_pylist()
            near = _units(_matrix(queries.column("embedding").combine_chunks())) @ units.T
            for r, row in zip(queries.column("rid").to_pylist(), near, strict=True):
                for c, v in _nearest(row, own, wanted):
                    rid.append(r)
                    ids.append(v)
                    cosines.append(min(1.0, max(-1.0, -c)))
        return pa.table([pa.array(rid, pa.int64()), pa.array(ids, pa.int64()), pa.array(cosines, pa.float64())], ["rid", "vec_id", "score"])

    return search


def _compare(sent, wanted: int):
    """The best of a batch for each of the queries sent."""

    def compare(batches):
        rids, units = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            near = units @ _units(_matrix(batch.column("embedding"))).T
            leaf, own = batch.column("leaf").to_pylist(), batch.column("ids").to_pylist()
            at = {v: i for i, x in enumerate(own) for v in x}
            rows = [(r, v, -c, leaf[at[v]]) for r, row in zip(rids, near, strict=True) for c, v in _nearest(row, own, wanted)]
            yield pa.record_batch([pa.array(x) for x in zip(*rows, strict=True)], ["rid", "vec_id", "score", "leaf"])

    return compare


class Index:
    """All rows of (vec_id, embedding), which are usable and of one length, under the leaves of a tree."""

    def __init__(self, vectors: DataFrame, k: int = 5, fit: int = FIT):
        self.spark, self.k, self.wanted = tuned(vectors.sparkSession), k, k + 1
        self.rows = vectors
        first = W.partitionBy("embedding").orderBy("vec_id")
        ranked = self.rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= self.wanted)
        entries = ranked.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("rid", F.monotonically_increasing_id())
        entries = materialize(entries.select("rid", "ids", "embedding"), "entries")
        sample = entries.orderBy(F.xxhash64("embedding"), "rid").limit(fit).select("embedding").toArrow().column(0).combine_chunks()
        self.tree = Tree(_units(_matrix(sample))) if len(sample) else None
        if self.tree is None:
            return
        self.sent = self.spark.sparkContext.broadcast(self.tree)
        self.entries = materialize(entries.mapInArrow(_assign(self.sent), f"rid long, ids array<long>, embedding {entries.schema['embedding'].dataType.simpleString()}, leaf long"), "leaves")
        # One row for each leaf of the tree, which has at most 2 * fit / LEAF of them.
        counts = self.entries.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("rows")).collect()
        self.count, self.size = {r.leaf: r.n for r in counts}, {r.leaf: r.rows for r in counts}

    def truth(self, queries: DataFrame) -> dict[int, list[tuple[int, float, int]]]:
        """rid -> (vec_id, cosine, leaf) of the nearest rows, its own among them, by comparison with all entries. ``queries`` are few."""
        got = queries.select("rid", "embedding").toArrow()
        sent = self.spark.sparkContext.broadcast((got.column(0).to_pylist(), _units(_matrix(got.column(1).combine_chunks()))))
        near = self.entries.select("ids", "embedding", "leaf").mapInArrow(_compare(sent, self.wanted), "rid long, vec_id long, score double, leaf long")
        order = W.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
        out: dict[int, list] = {}
        for r in near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.wanted).orderBy("rid", "rank").collect():
            out.setdefault(r.rid, []).append((r.vec_id, r.score, r.leaf))
        return out

    def calibrate(self, queries: DataFrame, target: float = TARGET) -> int:
        """The number of leaves to visit."""
        some = queries.select("rid", "embedding").distinct().orderBy(F.xxhash64("embedding"), "rid").limit(CALIBRATE)
        units = {r.rid: _units(np.array([r.embedding], np.float64))[0] for r in some.collect()}
        needed = []
        for rid, near in self.truth(some).items():
            place = {leaf: i + 1 for i, leaf in enumerate(self.tree.visits(units[rid]))}
            needed += [place[leaf] for _, _, leaf in near[1:]]  # the nearest is the query itself, which its own leaf has
        needed.sort()
        return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)] if needed else 1

    def search(self, queries: DataFrame, visits: int | None = None) -> DataFrame:
        """(query_id, vec_id, score), k rows for each of ``queries`` (query_id, embedding), whose vectors are among the index's."""
        asked = materialize(queries.join(self.entries.select("rid", "embedding"), "embedding").select("query_id", "rid", "embedding"), "asked")
        distinct = asked.dropDuplicates(["rid"]).select("rid", "embedding")
        self.visits = visits or self.calibrate(distinct)
        walked = materialize(distinct.mapInArrow(_walk(self.sent, self.visits, self.size, self.wanted), "rid long, leaf long"), "walked")
        asks = {r.leaf: r.n for r in walked.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
        salts = [(leaf, -(-self.count[leaf] // BLOCK), -(-n // BLOCK)) for leaf, n in asks.items()]
        salted = F.broadcast(self.spark.createDataFrame(salts, "leaf long, sides int, asks int"))  # a row for each leaf at most
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = self.entries.join(salted, "leaf").select("leaf", F.pmod(F.xxhash64("rid"), "sides").cast("int").alias("a"), spread("asks").alias("b"), "ids", "embedding")
        right = walked.join(distinct, "rid").join(salted, "leaf").select("leaf", spread("sides").alias("a"), F.pmod(F.xxhash64("rid"), "asks").cast("int").alias("b"), "rid", "embedding")
        found = left.groupBy("leaf", "a", "b").cogroup(right.groupBy("leaf", "a", "b")).applyInArrow(_block(self.wanted), "rid long, vec_id long, score double")
        order = W.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
        best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= self.wanted).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))
        others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, self.k)
        return asked.select("query_id", "rid").join(best, "rid").select("query_id", F.explode(others).alias("x")).select("query_id", "x.vec_id", "x.score")


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The ``k`` nearest other rows of each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = materialize(usable(vectors), "vectors")
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    lengths = sorted(r.n for r in rows.select(F.size("embedding").alias("n")).distinct().collect())  # of an embedding there is one
    for n in lengths:
        index = Index(rows.where(F.size("embedding") == n) if len(lengths) > 1 else rows, k)
        found = found.unionByName(index.search(index.rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").distinct()))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_kmeans_tree_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
