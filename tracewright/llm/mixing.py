"""Operator 5: mixing sources to target weights by Pfair scheduling.

A source's documents, in an order by hash, are cut into blocks of BLOCK_CHARS characters. With n of every Q slots as its weight, block j of a source
(from 0) is released at slot floor(j Q / n) and due by slot ceil((j + 1) Q / n). Slots are given to the released block with the earliest
deadline, so after any number of slots a source has had less than one block more or less than its weight asks for, as long as it has blocks.

The weights alone decide the schedule, and it repeats after Q slots: one period is worked out, a table of Q rows, and each block finds its
slot in it by its number. No row waits for another, and no rows but those of the schedule are in one place. A source's documents are
put in order by pieces, by leading hex digits of the hash, whose characters are added up first, so a source with a large part of all rows is
spread over many tasks.

Every document gets a slot, exactly one; none is dropped or repeated. A source that has run out leaves its slots empty, and the others go
on in their proportions. A document longer than a block sits at its first block.

Without given weights a source weighs the square root of its characters. Given weights are shares; a source that is not named has the least
share there is, one slot in Q. Q is RESOLUTION, and 16 times the number of sources if that is more.

Cases: a null source is a source. Null and empty texts have no characters and share the slot of what follows. The order is by a hash of doc_id
and text, so rows that share a doc_id, or have none, are spread like others as long as their texts differ. Texts of any length stay whole. Repeated rows each have their place. An empty table gives an empty result. Other columns are kept
by ``mixed`` and ignored by ``schedule``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.common import table

BLOCK_CHARS, RESOLUTION = 1 << 16, 1000
#: Rows of a source that are put in order together, about.
PIECE_ROWS = 5000

#: One period: at each slot the released job with the earliest deadline, ties to the source that sorts first.
PERIOD = """
aggregate(
  sequence(0, q - 1),
  named_struct('done', transform(ns, x -> 0L), 'picks', cast(array() as array<int>)),
  (state, t) -> transform(
    array(array_min(transform(sequence(0, size(ns) - 1), i ->
      if(state.done[i] < ns[i] AND (state.done[i] * q) div ns[i] <= t, named_struct('due', ((state.done[i] + 1) * q + ns[i] - 1) div ns[i], 'i', i), null))).i),
    p -> named_struct('done', transform(state.done, (d, i) -> if(i = p, d + 1L, d)), 'picks', concat(state.picks, array(p))))[0],
  state -> state.picks)
"""

#: Rounds in which every share above one can give a slot, as far as ``over`` slots go; the last round, in part, goes by ``down``.
ROUNDS = "aggregate(sequence(0L, over), 0L, (k, j) -> if(aggregate(of, 0L, (a, x) -> a + least(x.n - 1, j)) <= over, j, k))"
REST = "over - aggregate(of, 0L, (a, x) -> a + least(x.n - 1, rounds))"
GIVEN = "transform(of, x -> named_struct('name', x.name, 'n', x.n - least(x.n - 1, rounds) - if(x.n - 1 > rounds AND x.down <= rest, 1L, 0L)))"


def _named(source: Column) -> Column:
    """A text for each source that is not null, even for the null source."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def period(totals: DataFrame, weights: dict[str, float] | None, resolution: int) -> DataFrame:
    """(name, n, q, job, slot) from (name, chars): one row for each slot of a period."""
    if weights is None:
        asked = totals.select("name", F.floor(F.sqrt(F.col("chars").cast("double"))).cast("long").alias("r"))
    else:
        scale = 10**9 / sum(weights.values())
        pairs = [(f"s{k}" if k is not None else "n", int(v * scale)) for k, v in weights.items()]
        asked = totals.select("name").join(F.broadcast(totals.sparkSession.createDataFrame(pairs, "name string, r long")), "name", "left").select("name", F.coalesce("r", F.lit(0).cast("long")).alias("r"))
    # Windows over the table of sources, which has a row for each.
    over = W.partitionBy(F.lit(1))
    every = asked.withColumn("all", F.greatest(F.sum("r").over(over), F.lit(1))).withColumn("q", F.greatest(F.lit(resolution), 16 * F.count("*").over(over)).cast("int"))
    share = every.withColumn("n", F.greatest(F.expr("cast(cast(r as decimal(38,0)) * q div all as bigint)"), F.lit(1).cast("long"))).withColumn("rest", F.expr("cast(r as decimal(38,0)) * q % all"))
    # What rounding has left over goes to the largest remainders; what it has taken too much comes from the largest shares above one, in rounds.
    share = share.withColumn("left", F.col("q") - F.sum("n").over(over))
    share = share.withColumn("up", F.row_number().over(over.orderBy(F.desc("rest"), "name"))).withColumn("down", F.row_number().over(over.orderBy(F.desc("n"), "name")))
    share = share.withColumn("n", F.col("n") + F.when(F.col("up") <= F.col("left"), 1).otherwise(0))
    listed = share.groupBy("q", F.greatest(-F.col("left"), F.lit(0).cast("long")).alias("over")).agg(F.array_sort(F.collect_list(F.struct("name", "n", "down"))).alias("of"))
    listed = listed.withColumn("rounds", F.expr(ROUNDS)).withColumn("rest", F.expr(REST)).select("q", F.expr(GIVEN).alias("of")).select("q", "of", F.col("of.n").alias("ns"))
    slots = listed.select("q", "of", F.posexplode(F.expr(PERIOD)).alias("slot", "i")).select("q", "slot", F.col("of")[F.col("i")].alias("x")).select("q", "slot", "x.name", "x.n")
    return slots.withColumn("job", (F.row_number().over(W.partitionBy("name").orderBy("slot")) - 1).cast("long"))


def _placed(docs: DataFrame, keep: list[Column], weights: dict[str, float] | None, block_chars: int, resolution: int) -> DataFrame:
    digits = max(2, math.ceil(math.log(max(1, docs.count()) / PIECE_ROWS, 16)) if docs.take(1) else 2)
    rows = docs.select(
        *keep,
        _named(F.col("source")).alias("name"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary")).alias("h"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("size"),
    ).withColumn("piece", F.substring("h", 1, digits))
    sums = rows.groupBy("name", "piece").agg(F.sum("size").alias("chars"))
    before = sums.select("name", "piece", (F.sum("chars").over(W.partitionBy("name").orderBy("piece").rowsBetween(W.unboundedPreceding, -1))).alias("before"))
    within = W.partitionBy("name", "piece").orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    started = rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(before, ["name", "piece"]).withColumn("start", F.col("within") + F.coalesce("before", F.lit(0)))
    slots = period(sums.groupBy("name").agg(F.sum("chars").alias("chars")), weights, resolution)
    # A source's length of period goes with each of its jobs; the table has q rows.
    jobs = slots.groupBy("name", "n", "q").agg(F.map_from_entries(F.collect_list(F.struct("job", "slot"))).alias("slots"))
    block = started.withColumn("block", F.expr(f"start div {block_chars}"))
    met = block.join(F.broadcast(jobs), "name").withColumn("round", F.expr("block div n")).withColumn("job", F.expr("block % n"))
    return met.select(
        "*",
        F.expr("round * q + (job * q) div n").alias("release"),
        F.expr("round * q + ((job + 1) * q + n - 1) div n").alias("deadline"),
        F.expr("round * q + slots[job]").alias("at_slot"),
    )


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS, resolution: int = RESOLUTION) -> DataFrame:
    """(doc_id, source, block, release, deadline, slot, start) for every row of ``docs``; start is where it starts among its source's characters.

    Reading by slot, then start, is the mix.
    """
    placed = _placed(docs, [F.col("doc_id"), F.col("source"), F.col("doc_id").alias("id")], weights, block_chars, resolution)
    return placed.select("doc_id", "source", "block", "release", "deadline", F.col("at_slot").alias("slot"), "start")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS, resolution: int = RESOLUTION) -> DataFrame:
    """The rows of ``docs``, all of them, in the order of the mix: written out, files and rows follow each other in it."""
    placed = _placed(docs, [F.struct("*").alias("row"), F.col("doc_id").alias("id")], weights, block_chars, resolution)
    return placed.repartitionByRange("at_slot", "start").sortWithinPartitions("at_slot", "start", "h", "id", "size").select("row.*")


def slotted(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS, resolution: int = RESOLUTION) -> DataFrame:
    """(doc_id, text, slot) for every row of ``docs``."""
    return _placed(docs, [F.col("doc_id"), F.col("text"), F.col("doc_id").alias("id")], weights, block_chars, resolution).select("doc_id", "text", F.col("at_slot").alias("slot"))


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE rows AS (
    SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS name, md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS h, coalesce(length(text), 0) AS size FROM documents
), asked AS (
    SELECT name, floor(sqrt(sum(size)::DOUBLE))::BIGINT AS r FROM rows GROUP BY name
), every AS (
    SELECT greatest(sum(r), 1)::BIGINT AS every_r, greatest(1000, 16 * count(*))::BIGINT AS q FROM asked
), share AS (
    SELECT name, q, greatest(r * q // every_r, 1) AS n, r * q % every_r AS rest FROM asked, every
), ranked AS (
    SELECT *, q - sum(n) OVER () AS spare, row_number() OVER (ORDER BY rest DESC, name) AS up, row_number() OVER (ORDER BY n DESC, name) AS down FROM share
), weighed AS (
    SELECT name, q, (n + CASE WHEN up <= spare THEN 1 WHEN down <= -spare THEN -1 ELSE 0 END)::BIGINT AS n, row_number() OVER (ORDER BY name) AS i FROM ranked
), listed AS (
    SELECT any_value(q) AS q, list(n ORDER BY i) AS ns FROM weighed
), edf AS (
    SELECT -1::BIGINT AS t, list_transform(ns, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick FROM listed
    UNION ALL
    SELECT t, list_transform(done, lambda d, i: CASE WHEN i = pick THEN d + 1 ELSE d END), pick FROM (
        SELECT t + 1 AS t, done, list_min(list_filter(list_transform(range(1, len(ns) + 1), lambda i:
            CASE WHEN done[i] < ns[i] AND done[i] * q // ns[i] <= t + 1 THEN ((done[i] + 1) * q + ns[i] - 1) // ns[i] * 100000 + i END), lambda x: x IS NOT NULL)) % 100000 AS pick
        FROM edf, listed WHERE t + 1 < q
    )
), slots AS (
    SELECT pick AS i, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS job FROM edf WHERE t >= 0
), placed AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY name ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM rows
), blocks AS (
    SELECT p.*, start // 65536 AS block, n, q, i FROM placed p JOIN weighed USING (name)
)
SELECT doc_id, source, block, block // n * q + (block % n) * q // n AS release, block // n * q + ((block % n + 1) * q + n - 1) // n AS deadline, block // n * q + slot AS slot, start
FROM blocks b JOIN slots s ON s.i = b.i AND s.job = block % n
"""
