"""Order-insensitive checksums of result sets and of query classes.

A row's hash tells its cells and their types; a result's digest tells the multiset of its rows and its columns; a class's digest tells the
multiset of its results. Sums wrap at 2^64 and are taken as decimals, as an overflow of longs is an error. All combine in any
order, so they are partial aggregates. Digests can be compared within this engine only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WRAP = "18446744073709551616"


def wrapping_sum(c: Column) -> Column:
    """A sum modulo 2^64; hashes are taken as they are, so negative ones wrap too."""
    wrap = F.lit(WRAP).cast("decimal(20,0)")
    return F.pmod(F.sum(c.cast("decimal(20,0)")).cast("decimal(38,0)"), wrap)


def _signed(c: Column) -> Column:
    """An unsigned number of 64 bits as the long of the same bits."""
    return F.when(c >= F.lit("9223372036854775808").cast("decimal(20,0)"), c - F.lit(WRAP).cast("decimal(20,0)")).otherwise(c).cast("long")


def md5_hash(text: Column) -> Column:
    """60 bits of the MD5 of a text, which other engines can compute too."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def row_hash(columns: list[tuple[str, str]], hashed: Callable[[Column], Column] = F.xxhash64) -> Column:
    """The hash of a row from (name, type): each cell's type tag and text; null has a tag of its own."""

    def cell(name: str, kind: str) -> Column:
        tag = "i" if kind in ("tinyint", "smallint", "int", "bigint") else "f" if kind in ("float", "double") else "b"
        text = F.col(name).cast("double").cast("string") if tag == "f" else F.base64(F.col(name)) if kind == "binary" else F.col(name).cast("string")
        return F.coalesce(F.concat(F.lit(tag), F.char_length(text).cast("string"), F.lit(":"), text), F.lit("n"))

    return hashed(F.concat(*[cell(*c) for c in columns]) if columns else F.lit(""))


def result_checksum(df: DataFrame, keys: list[str] | None = None, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(rows, sum, xor, digest) of ``df``, for each of ``keys`` if there are any."""
    keys = keys or []
    columns = [(n, t) for n, t in df.dtypes if n not in keys]
    hashes = df.select(*keys, row_hash(columns, hashed).alias("h"))
    out = hashes.groupBy(*keys).agg(F.count("*").alias("rows"), F.coalesce(wrapping_sum(F.col("h")), F.lit(0).cast("decimal(38,0)")).alias("sum"), F.coalesce(F.bit_xor("h"), F.lit(0).cast("long")).alias("xor"))
    names = ",".join(n for n, _ in columns)
    return out.withColumn("digest", hashed(F.concat_ws("|", F.col("rows").cast("string"), F.col("sum").cast("string"), F.col("xor").cast("string"), F.lit(names))))


def class_checksums(outcomes: DataFrame, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row for each ``fingerprint_id`` of executed, checksummed outcomes.

    ``outcomes`` has fingerprint_id, ordinal, digest (null: no result set), digest_rows and columns.
    """
    has = F.col("digest").isNotNull()
    out = outcomes.groupBy("fingerprint_id").agg(
        F.count_if(has).alias("events"),
        F.count_if(~has).alias("no_result"),
        F.coalesce(F.sum(F.when(has, F.col("digest_rows"))), F.lit(0).cast("long")).alias("rows_total"),
        F.coalesce(wrapping_sum(F.col("digest")), F.lit(0).cast("decimal(38,0)")).alias("sum"),
        F.coalesce(F.bit_xor(_signed(F.col("digest"))), F.lit(0).cast("long")).alias("xor"),
        F.min_by(F.col("columns"), F.when(has, F.col("ordinal"))).alias("columns"),
        (F.count_distinct(F.when(has, F.to_json("columns"))) > 1).alias("shape_varied"),
    )
    number = hashed(F.concat_ws("|", F.col("events").cast("string"), F.col("no_result").cast("string"), F.col("sum").cast("string"), F.col("xor").cast("string")))
    return out.select("fingerprint_id", "events", "no_result", "rows_total", F.lower(F.lpad(F.hex(number), 16, "0")).alias("digest"), F.coalesce("columns", F.array().cast("array<string>")).alias("columns"), "shape_varied")
