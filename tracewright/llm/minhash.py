"""Near copies of whole texts: pairs whose sets of 5-word shingles have a Jaccard similarity of SIMILARITY or more.

Candidates come from MinHash: BANDS bands of ROWS minima each. A pair of similarity s meets in some band with probability
1 - (1 - s^ROWS)^BANDS, which is above 0.999998 for s = 0.8. Pairs that meet are verified on their whole sets of shingles, as 64-bit hashes.

In a bucket, texts are put in order by the size of their sets, and each is compared with the NEAR texts before it and with the bucket's first.
Of up to NEAR + 1 texts these are all the pairs; in larger buckets rows grow with the number of texts and not with its square, and it is the
chains over the bands that join a group.

Words are lower-cased as by ``simhash``. A text of fewer than SHINGLE words is one shingle; null texts and those of white space have none and no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.common import LOWER, materialize
from tracewright.llm.decontaminate import _checked
from tracewright.llm.substring import GRAM_BASE, _mixed, rolling, word_hashes

SHINGLE, SIMILARITY, BANDS, ROWS, NEAR = 5, 0.8, 25, 4, 4
#: Shingles that are held at once, for all minima.
BLOCK = 1 << 12
#: Odd multipliers, one for each minimum: fixed values.
FACTORS = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct shingles of a text, hashed."""
    words = word_hashes((text or b"").translate(LOWER))
    return np.unique(rolling(words, min(SHINGLE, len(words)), GRAM_BASE)) if len(words) else words


def bands(of: np.ndarray) -> np.ndarray:
    """One key for each band, from hashed shingles."""
    if not len(of):
        return of
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(of), BLOCK):
        least = np.minimum(least, (of[at : at + BLOCK, None] * FACTORS).min(axis=0))
    return _mixed((_mixed(least) * FACTORS).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64))


def _sets(batches):
    for batch in batches:
        rows = [shingles(x).view(np.int64) for x in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("key"), pa.array(rows, pa.list_(pa.int64()))], ["key", "shingles"])


def key(text: str = "text") -> Column:
    """Tells texts apart."""
    return F.xxhash64(F.col(text).cast("binary"))


def copies(docs: DataFrame, signed: DataFrame, radius: int) -> DataFrame:
    """(src, dst) over the column ``print`` of ``signed``: the prints of near copies that differ in more than ``radius`` bits.

    ``signed`` has print, key, n and bands for the texts of ``docs``.
    """
    placed = signed.where("n > 0").dropDuplicates(["key"]).select("key", "print", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = placed.groupBy("band", "bucket").agg(F.count("*").alias("of")).where("of > 1").select("band", "bucket")
    bucket = W.partitionBy("band", "bucket").orderBy("n", "key")
    one = F.struct("key", "print", "n")
    others = F.array(F.first(one).over(bucket), *[F.lag(one, i).over(bucket) for i in range(1, NEAR + 1)])
    met = placed.join(shared.hint("merge"), ["band", "bucket"]).withColumn("other", others).select("key", "print", "n", F.explode("other").alias("o"))
    # A pair whose sizes differ too much cannot be alike, and pairs within the radius are linked already.
    met = met.where((F.col("o.key") != F.col("key")) & (F.col("o.n") >= F.col("n") * F.lit(SIMILARITY) - 1e-9) & (F.bit_count(F.col("o.print").bitwiseXOR(F.col("print"))) > radius))
    pairs = materialize(met.select("key", "print", "n", F.col("o.key").alias("key2"), F.col("o.print").alias("print2"), F.col("o.n").alias("n2")).dropDuplicates(["key", "key2"]), "pairs")
    wanted = pairs.select("key").unionByName(pairs.select(F.col("key2").alias("key"))).distinct()
    texts = docs.select(key().alias("key"), F.col("text").cast("binary").alias("text")).join(_checked(wanted), "key", "left_semi").dropDuplicates(["key"])
    sets = materialize(texts.mapInArrow(_sets, "key long, shingles array<long>"), "shingles")
    both = pairs.join(sets.hint("merge"), "key").join(sets.select(F.col("key").alias("key2"), F.col("shingles").alias("shingles2")).hint("merge"), "key2")
    common = both.withColumn("common", F.size(F.array_intersect("shingles", "shingles2")))
    return common.where(F.col("common") >= (F.col("n") + F.col("n2") - F.col("common")) * F.lit(SIMILARITY) - 1e-9).select(F.col("print").alias("src"), F.col("print2").alias("dst")).distinct()
