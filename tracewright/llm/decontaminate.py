"""Operator 1: benchmark decontamination by size-partitioned MinHash containment search.

Texts are lower-cased and read as runs of letters and digits. An item's shingles are its distinct runs of SHINGLE words; an item of
fewer words is one shorter shingle. A document is contaminated by an item if it has at least CONTAINMENT of the item's shingles.

Items are partitioned by the size of their shingle sets, in powers of two. The MinHash sketch of an item is its k smallest shingle
hashes, where k is set by its partition such that a document with CONTAINMENT of the shingles of any item there cannot miss all k: sketches are
short for short items, and the search loses no pair. A document's shingle hashes are looked up in the sketches, whole texts however long
they are. Pairs that meet are verified by counting the item's shingles, as text, in the document.

All of it is DataFrame operations. The table of sketches and that of the items' shingles are broadcast up to BROADCAST_BYTES, which are
measured first; larger ones are joined by shuffles, with the same result.

Cases: null and empty texts, and those without letters and digits, neither contaminate nor are contaminated. Documents shorter than an item's
shingles cannot contain it. Texts of any length are read whole. Rows with the same doc_id count as one document, rows with the same item_id as one item. Rows without doc_id are not reported, but ``clean``
judges them like all others. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import materialize, table

SHINGLE, CONTAINMENT = 5, 0.8
#: Bytes of values; a table of this size takes some 100 MB as a hash table.
BROADCAST_BYTES = 32 << 20


def words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _starts(n: Column, k: int) -> Column:
    """The places at which runs of ``k`` among ``n`` words start."""
    return F.when(n >= k, F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _hashes(w: str, k: int) -> Column:
    """The hash of each run of ``k`` of the word hashes ``w``."""
    return F.transform(_starts(F.size(w), k), lambda i: F.xxhash64(F.lit(k), *[F.get(F.col(w), i + j) for j in range(k)]))


def _shingles(w: str, k: int) -> Column:
    return F.transform(_starts(F.size(w), k), lambda i: F.array_join(F.slice(F.col(w), i + 1, F.lit(k)), " "))


def _checked(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join: broadcast if its values have BROADCAST_BYTES at most."""
    sizes = [F.coalesce(F.octet_length(F.col(f.name).cast("binary") if f.dataType.typeName() in ("string", "binary") else F.lit("12345678")), F.lit(0)) for f in df.schema]
    size = df.agg(F.sum(sum(sizes[1:], sizes[0])).alias("bytes")).first().bytes or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def sketches(items: DataFrame, containment: float = CONTAINMENT) -> tuple[DataFrame, DataFrame, list[int]]:
    """(print, item_id, needed, n_item), (shingle, item_id, n_item, needed) of the items, and the lengths of their shingles."""
    tokens = items.where("item_id IS NOT NULL").select("item_id", words("text").alias("w")).where("size(w) > 0").select("item_id", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"))
    lengths = sorted(r.k for r in tokens.select("k").distinct().collect())  # SHINGLE values at most
    each = None
    for k in lengths:
        part = tokens.where(F.col("k") == k).select("item_id", F.lit(k).alias("k"), F.explode(F.arrays_zip(_shingles("w", k).alias("shingle"), _hashes("h", k).alias("print"))).alias("x")).select("item_id", "x.*")
        each = part if each is None else each.unionByName(part)
    if each is None:
        each = tokens.select("item_id", F.lit("").alias("shingle"), F.lit(0).cast("long").alias("print")).limit(0)
    each = materialize(each.distinct(), "items")
    sizes = each.groupBy("item_id").agg(F.countDistinct("shingle").cast("long").alias("n_item"), F.array_sort(F.collect_set("print")).alias("prints"))
    sizes = sizes.withColumn("needed", F.ceil(F.col("n_item") * F.lit(containment) - F.lit(1e-9)).cast("long"))
    # The partition of an item: its sizes run from a power of two to just below the next.
    top = F.pow(F.lit(2), F.floor(F.log2("n_item")) + 1).cast("long") - 1
    k = F.least(F.size("prints").cast("long"), top - F.ceil(top * F.lit(containment) - F.lit(1e-9)).cast("long") + 1)
    found = sizes.select("item_id", "needed", "n_item", F.explode(F.slice("prints", F.lit(1), k.cast("int"))).alias("print"))
    return found, each.select("shingle", "item_id").distinct().join(sizes.select("item_id", "n_item", "needed"), "item_id"), lengths


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for every pair with at least ``containment``."""
    found, shingles, lengths = sketches(items, containment)
    tokens = docs.where("doc_id IS NOT NULL").select("doc_id", words("text").alias("w"))
    hashed = tokens.select("doc_id", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    prints = [_hashes("h", k) for k in lengths]
    looked_up = hashed.select("doc_id", F.explode(prints[0] if len(prints) == 1 else F.concat(*prints) if prints else F.array().cast("array<bigint>")).alias("print"))
    candidates = materialize(looked_up.join(_checked(found.select("print", "item_id")), "print").groupBy("doc_id").agg(F.collect_set("item_id").alias("items")), "candidates")
    texts = tokens.join(candidates, "doc_id")
    runs = [_shingles("w", k) for k in lengths]
    each = texts.select("doc_id", "items", F.explode(F.array_distinct(F.concat(*runs) if runs else F.array().cast("array<string>"))).alias("shingle"))
    # Only the items that a document's sketch has found are counted in it.
    wanted = _checked(shingles.withColumnRenamed("shingle", "of_item"))
    met = each.join(wanted, (F.col("shingle") == F.col("of_item")) & F.array_contains("items", F.col("item_id"))).groupBy("doc_id", "item_id", "n_item", "needed").agg(F.countDistinct("shingle").alias("n_shared"))
    return met.where("n_shared >= needed").select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` without the contaminated documents. Each row is judged by its own text, whether it has a doc_id or shares it."""
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.hex(F.xxhash64(F.col("text"))), F.lit("")))
    found = materialize(contaminated(docs.select(own.alias("doc_id"), "text"), items, containment).select("doc_id").distinct(), "contaminated")
    rows = docs.select(F.struct(*docs.columns).alias("row"), own.alias("doc_id"))
    return rows.join(found, "doc_id", "left_anti").select("row.*")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH words AS (
    SELECT 'd' AS side, doc_id AS id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL
    UNION ALL
    SELECT 'i', item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') FROM benchmark WHERE item_id IS NOT NULL
), items AS (
    SELECT DISTINCT id AS item_id, least(len(w), 5) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS shingle
    FROM words WHERE side = 'i' AND len(w) > 0
), docs AS (
    SELECT DISTINCT id AS doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS shingle
    FROM words, (SELECT DISTINCT k FROM items) WHERE side = 'd' AND len(w) >= k
), sizes AS (
    SELECT item_id, count(DISTINCT shingle) AS n_item FROM items GROUP BY item_id
)
SELECT doc_id, item_id, n_item, count(DISTINCT shingle) AS n_shared, count(DISTINCT shingle) / n_item AS containment
FROM docs JOIN items USING (k, shingle) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_item
HAVING count(DISTINCT shingle) >= ceil(n_item * 0.8::DOUBLE - 1e-9)
"""
