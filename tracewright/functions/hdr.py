"""Quantiles of a high-dynamic-range histogram, as aggregations.

A histogram of 3 significant digits counts values below 2048 singly and above in cells of 2^k values, k being the bits beyond 11; with 2 digits
it is 256 and 8. A quantile is the largest value of the first cell by which ceil(q n) values have come. Quantizing first makes the
rows that are ordered as few as the histogram has cells, whatever the number of values: partial aggregation does the counting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of a cell's leading part, and the largest value held, by significant digits: latencies in microseconds, sizes in bytes.
BITS, MOST = {3: 11, 2: 8}, {3: (1 << 32) - 1, 2: (1 << 43) - 1}


def _excess(v: Column, digits: int) -> Column:
    return F.greatest(F.length(F.bin(v)) - BITS[digits], F.lit(0))


def clamped(v: Column, digits: int) -> Column:
    return F.least(v.cast("long"), F.lit(MOST[digits]))


def highest(v: Column, digits: int = 3) -> Column:
    """The largest value of the cell of ``v``."""
    k = _excess(v, digits)
    width = F.pow(F.lit(2), k).cast("long")
    return (F.floor(v / width).cast("long") + 1) * width - 1


def middle(high: Column, digits: int = 3) -> Column:
    """The middle of the cell whose largest value is ``high``."""
    width = F.pow(F.lit(2), _excess(high, digits)).cast("long")
    return high - width + 1 + F.floor(width / 2).cast("long")


def micros(seconds: Column) -> Column:
    """Recorded seconds as whole microseconds, one at least."""
    return F.greatest(F.round(seconds * 1e6).cast("long"), F.lit(1).cast("long"))


def hdr_stats(df: DataFrame, keys: list[str], value: Column, quantiles: dict[str, float], digits: int = 3, count: str = "count", most: str | None = "max_us", mean: str | None = "mean_us") -> DataFrame:
    """One row for each of ``keys``: the number of values, quantiles by name, and the largest value and the mean as the histogram has them."""
    cells = df.select(*keys, highest(clamped(value, digits), digits).alias("_cell")).groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    upto = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
    ranked = cells.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(W.partitionBy(*keys)))
    out = [F.sum("_n").alias(count)]
    for name, q in quantiles.items():
        wanted = F.greatest(F.ceil(F.lit(float(q)) * F.col("_all")), F.lit(1))
        out.append(F.min(F.when(F.col("_upto") >= wanted, F.col("_cell"))).alias(name))
    if most:
        out.append(F.max("_cell").alias(most))
    if mean:
        out.append((F.sum(F.col("_n") * middle(F.col("_cell"), digits)) / F.sum("_n")).alias(mean))
    return ranked.groupBy(*keys).agg(*out)


LATENCY_QUANTILES = {"p50_us": 0.5, "p95_us": 0.95, "p99_us": 0.99}
