"""Connected components over an edge table, without collecting edges or components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tracewright.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst); component is the smallest node reachable.

    Alternates the large-star and small-star steps, which turn a component into a star around its smallest node in
    a number of rounds that grows with the logarithm of its size. Each round is written to the shared folder, so
    lineage stays short and a lost executor costs one round at most. It goes on until a round changes nothing. Minima are combined before the
    shuffle; the joins that hand them back are merge joins with one row for each node on one side, so nothing is broadcast. A round is
    one job: what tells whether it changed anything is counted while its links are written.
    """
    now = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    seen = None
    while True:
        back = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = now.unionByName(back).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Links to larger nodes are those turned round, and the smaller node is the one that can be a centre.
        large = back.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        counted = Observation()
        now = materialize(small.where("u <> v").distinct().observe(counted, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
        state = counted.get
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
