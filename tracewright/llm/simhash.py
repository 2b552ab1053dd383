"""Operator 2: near-duplicates by SimHash with covering locality-sensitive hashing.

Fingerprints within ``RADIUS`` = 2 bits are linked. A covering family of 2^(RADIUS+1)-1 = 7 bit masks guarantees that every
such pair agrees on all the bits of some mask: bit i carries a vector of GF(2)^3, mask v keeps the bits whose vector has
an odd inner product with v, and two differing bits leave a v that is orthogonal to both. Distinct fingerprints
that fall into a common bucket of some table are candidates.

Inside the buckets no pairs are formed. A candidate sends itself and its one-bit neighbours over the bits that are free in
its tables; two fingerprints differ in at most 2 bits exactly if such keys meet. A bucket of n fingerprints so costs at
most 65 n rows, however large it is, and no link is lost.

Cases: null and empty texts, and texts of white space, have fingerprint zero and are linked like any other. Texts of fewer than three
words are one shingle. Repeated rows keep their row each and share a component. An empty table gives an empty result. A null
doc_id takes part, but is never a component_id unless it is alone. Texts of any length are read whole, BLOCK shingles at a time. Columns other than
doc_id and text are ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import minhash
from tracewright.llm.common import LOWER, materialize, table, tuned
from tracewright.llm.graph import connected_components

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 2
#: Shingles that are held at once.
BLOCK = 1 << 15


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """Masks such that any two words within ``radius`` differing bits agree on all the bits of one mask at least."""
    span = (1 << (radius + 1)) - 1
    vectors = [i % span + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vectors[i] & v).bit_count() % 2) for v in range(1, span + 1)]


def simhash(text: bytes | None) -> int:
    """The fingerprint of a text, unsigned."""
    import xxhash

    words = (text or b"").translate(LOWER).split()  # bytes.split knows just 20 and 09-0D as white space
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(at, min(n, at + BLOCK))], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for batch in batches:
        prints = np.array([simhash(x) for x in batch.column("text").to_pylist()], np.uint64)
        yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(prints.view(np.int64))], ["doc_id", "key", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, print): key tells texts apart, print has the fingerprint's 64 bits as a signed long."""
    tuned(docs.sparkSession)
    return docs.select("doc_id", minhash.key().alias("key"), F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, print long")


def _signed(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        prints = np.array([simhash(x) for x in texts], np.uint64)
        sets = [minhash.shingles(x) for x in texts]
        bands = pa.array([minhash.bands(x).view(np.int64) for x in sets], pa.list_(pa.int64()))
        yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(prints.view(np.int64)), pa.array([len(x) for x in sets], pa.int64()), bands], ["doc_id", "key", "print", "n", "bands"])


def signed(docs: DataFrame) -> DataFrame:
    """``fingerprints`` with what ``minhash.copies`` needs: (doc_id, key, print, n, bands)."""
    tuned(docs.sparkSession)
    return docs.select("doc_id", minhash.key().alias("key"), F.col("text").cast("binary").alias("text")).mapInArrow(_signed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, print long, n long, bands array<long>")


def links(prints: DataFrame) -> DataFrame:
    """(src, dst) over distinct fingerprints ``print``: a sparse set of links that joins what lies within RADIUS bits."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [signed(m) for m in covering_masks()]
    full = (1 << BITS) - 1
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("print").bitwiseAND(F.lit(m)).alias("bucket"), F.lit(signed(full ^ (m % (1 << 64)))).alias("free")) for i, m in enumerate(masks)])
    placed = prints.select("print", F.explode(tables).alias("x")).select("print", "x.*")
    shared = placed.groupBy("t", "bucket").agg(F.count("*").alias("n")).where("n > 1").select("t", "bucket")
    candidates = placed.join(shared.hint("merge"), ["t", "bucket"]).groupBy("print").agg(F.bit_or("free").alias("free"))
    one = [signed(1 << i) for i in range(BITS)]
    flips = F.filter(F.array(F.lit(0).cast("long"), *[F.lit(b).cast("long") for b in one]), lambda b: b.bitwiseAND(F.col("free")) == b)
    keys = candidates.select("print", F.explode(flips).alias("b")).select(F.col("print").bitwiseXOR(F.col("b")).alias("key"), "print")
    met = keys.groupBy("key").agg(F.min("print").alias("first"), F.max("print").alias("last")).where("first < last").select("key", "first")
    return keys.join(met.hint("merge"), "key").where("print <> first").select(F.col("print").alias("src"), F.col("first").alias("dst")).distinct()


def _rooted(docs: DataFrame, similar: bool) -> tuple[DataFrame, DataFrame]:
    """The prints of ``docs``, and (print, first, best, root) of each distinct one: its smallest doc_id, the row that stands for it, and its component."""
    prints = materialize(signed(docs) if similar else fingerprints(docs), "simhash")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best")
    firsts = prints.groupBy("print").agg(F.min("doc_id").alias("first"), best)
    linked = links(firsts.select("print"))
    parts = connected_components(linked.unionByName(minhash.copies(docs, prints, RADIUS)) if similar else linked)
    return prints, firsts.join(parts.withColumnRenamed("node", "print").hint("merge"), "print", "left").withColumn("root", F.coalesce("component", "print"))


def near_duplicates(docs: DataFrame, similar: bool = False) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``; if ``similar``, near copies by ``minhash`` are linked as well."""
    prints, rooted = _rooted(docs, similar)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = rooted.select("print", "root").join(least.hint("merge"), "root").select("print", "component_id")
    return prints.join(of_print.hint("merge"), "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, similar: bool = False) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, as ``near_duplicates`` links them: that of the smallest doc_id.

    Rows that share a doc_id and differ in text are judged as the different texts they are, and so are rows without doc_id, which come after all
    others. Of rows with the same doc_id and text that of the smallest hash of all columns stays, so the result is the same in every run.
    """
    stays = _rooted(docs, similar)[1].groupBy("root").agg(F.min("best").alias("x")).select(*_identity("x.doc_id", F.col("x.key")))
    hashable = [c.name for c in docs.schema if "map<" not in c.dataType.simpleString()]
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(*hashable).alias("hash"), *_identity("doc_id", minhash.key()))
    kept = rows.join(stays.hint("merge"), ["id", "none", "key"], "left_semi").groupBy("id", "none", "key").agg(F.min_by("row", "hash").alias("row"))
    return kept.select("row.*")


def _identity(doc_id: str, key: Column) -> list[Column]:
    """What tells rows apart by doc_id and text, without nulls, so that rows can be joined by it."""
    return [F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(doc_id).isNull().alias("none"), key.alias("key")]


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
