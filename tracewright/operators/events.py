"""Operators over events: filters, classes, sessions and pacing.

``events`` has the columns of ``schemas.ORDERED_EVENT``; the ordinal is an event's place in its capture.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions import sqltext
from tracewright.storage import numbered, small, written


def parse_instant(text: str) -> int:
    """Microseconds of an RFC 3339 time or of whole Unix seconds."""
    text = text.strip()
    if text.lstrip("-").isdigit():
        return int(text) * 1_000_000
    t = datetime.fromisoformat(text)
    if t.tzinfo is None:
        raise ValueError(f"no zone in {text!r}")
    return (t - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def parse_window(text: str) -> tuple[int | None, int | None]:
    """``from..to``; either end may be open, but not both."""
    start, dots, end = text.partition("..")
    if not dots:
        raise ValueError(f"a time window is FROM..TO, not {text!r}")
    a, b = (parse_instant(x) if x.strip() else None for x in (start, end))
    if a is None and b is None:
        raise ValueError("a time window needs one end")
    if a is not None and b is not None and a >= b:
        raise ValueError("a time window ends after it starts")
    return a, b


@dataclass(frozen=True)
class Filters:
    """F1 to F5. What is null never matches."""

    db: str | None = None
    user: str | None = None
    window: tuple[int | None, int | None] = (None, None)

    def matches(self) -> Column:
        out = F.lit(True)
        if self.db is not None:
            out = out & F.coalesce(F.col("db") == self.db, F.lit(False))
        if self.user is not None:
            out = out & F.coalesce(F.col("user") == self.user, F.lit(False))
        if self.window[0] is not None:
            out = out & (F.col("ts_micros") >= self.window[0])
        if self.window[1] is not None:
            out = out & (F.col("ts_micros") < self.window[1])
        return out

    def apply(self, events: DataFrame) -> DataFrame:
        return events.where(self.matches())


def filtered_totals(events: DataFrame, filters: Filters) -> DataFrame:
    """(events, filtered): how many stay and how many go."""
    return events.agg(F.count_if(filters.matches()).alias("events"), F.count_if(~filters.matches()).alias("filtered"))


def with_fingerprint(events: DataFrame) -> DataFrame:
    return events.withColumn("fingerprint", sqltext.fingerprint(F.col("query")))


def fingerprint_dim(events: DataFrame) -> DataFrame:
    """(id, text) with dense ids in the order in which classes first appear. One row for each class is ordered."""
    firsts = events.groupBy("fingerprint").agg(F.min("ordinal").alias("first"))
    return firsts.select((F.row_number().over(W.orderBy("first")) - 1).cast("long").alias("id"), F.col("fingerprint").alias("text"))


def classified(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with the id of their class, for a capture that is being made, and the table of classes, which is written.

    Events are many and classes few, so the table goes to the events as long as its measured size allows it.
    """
    named = with_fingerprint(events.drop("fingerprint_id"))
    dim = written(fingerprint_dim(named), "classes")
    texts = dim.select(F.col("id").alias("fingerprint_id"), F.col("text").alias("fingerprint"))
    return named.join(small(texts), "fingerprint").drop("fingerprint"), dim


def with_fingerprint_id(events: DataFrame) -> DataFrame:
    return classified(events)[0]


def with_text(events: DataFrame, dim: DataFrame) -> DataFrame:
    """Events with the text of their class."""
    texts = dim.select(F.col("id").alias("fingerprint_id"), F.col("text").alias("fingerprint"))
    return events.join(texts, "fingerprint_id", "left").withColumn("fingerprint", F.coalesce("fingerprint", F.concat(F.lit("<unknown fingerprint "), F.col("fingerprint_id"), F.lit(">"))))


def capture_summary(events: DataFrame) -> DataFrame:
    """(event_count, session_count)."""
    return events.agg(F.count("*").alias("event_count"), F.count_distinct("session_id").alias("session_count"))


def executable(allow_writes: bool, skip_use: bool) -> Column:
    """whether an event is run; ``skip_use`` where the database of a connection is not the session's to choose."""
    out = sqltext.should_execute(F.col("query"), allow_writes)
    return out & ~sqltext.is_use(F.col("query")) if skip_use else out


def prune_sessions(events: DataFrame, allow_writes: bool = False, skip_use: bool = False) -> DataFrame:
    """F8: without the sessions in which nothing is run; ``runs`` tells which events are."""
    marked = events.withColumn("runs", executable(allow_writes, skip_use))
    return marked.withColumn("live", F.bool_or("runs").over(W.partitionBy("session_id"))).where("live").drop("live")


def session_order(events: DataFrame) -> DataFrame:
    """With ``session_rank``, sessions counted as they first appear, and ``in_session``, an event's place in its session."""
    firsts = events.groupBy("session_id").agg(F.min("ordinal").alias("first"))
    ranks = numbered(firsts, ["first"], "place").select("session_id", (F.col("place") + 1).cast("int").alias("session_rank"))
    return events.withColumn("in_session", F.row_number().over(W.partitionBy("session_id").orderBy("ordinal"))).join(ranks, "session_id")


def due_offsets(events: DataFrame, speed: float) -> DataFrame:
    """``due_us``, when an event is due after the start of a paced replay."""
    base = events.agg(F.min("ts_micros").alias("base"))
    return events.join(F.broadcast(base)).withColumn("due_us", F.round(F.greatest(F.col("ts_micros") - F.col("base"), F.lit(0)) / float(speed)).cast("long")).drop("base")


def pacing_lag(events: DataFrame, speed: float) -> DataFrame:
    """When each event would start if its recorded latency held, and its lag behind its due time.

    An event starts when it is due and the one before it in its session has ended. With S the latencies' running sum, the i-th ends at
    S_i + max over j <= i of (due_j - S_{j-1}). The cap on connections is not modelled.
    """
    order = W.partitionBy("session_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    paced = due_offsets(events, speed).withColumn("latency_us", F.greatest(F.round(F.col("orig_query_time_s") * 1e6).cast("long"), F.lit(1).cast("long")))
    paced = paced.withColumn("sum_us", F.sum("latency_us").over(order))
    paced = paced.withColumn("slack_us", F.max(F.col("due_us") - F.col("sum_us") + F.col("latency_us")).over(order))
    paced = paced.withColumn("start_us", F.col("sum_us") + F.col("slack_us") - F.col("latency_us"))
    return paced.withColumn("lag_us", F.col("start_us") - F.col("due_us")).drop("sum_us", "slack_us")


def write_events(events: DataFrame, path: str) -> None:
    """The native event store: Parquet laid out by session, so that a replay reads a session's events together and in order."""
    events.repartition("session_id").sortWithinPartitions("session_id", "ordinal").write.option("compression", "zstd").parquet(path)
