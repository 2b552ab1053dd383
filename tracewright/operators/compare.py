"""Comparison of two runs: joins of their classes, verdicts, rankings and checks of comparability.

``base`` and ``cand`` are tables of classes (``schemas.FINGERPRINT_REPORT`` as columns), matched by text, as ids are a capture's own. Catalyst
chooses the join: both sides have a row for each class.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import scalars

THRESHOLD_PCT, MIN_COUNT = 20.0, 5
#: Knobs of a replay, which mean nothing for a recorded run, and filters, which always matter.
KNOBS = ("max_connections", "allow_writes", "db_override", "speed", "pool", "warmup", "checksum")
FILTERS = ("filter_db", "filter_user", "time_window")


def classes_of(run: DataFrame) -> DataFrame:
    """The classes of a run report as rows."""
    return run.select(F.explode("fingerprints").alias("f")).select("f.*")


def _sides(df: DataFrame, side: str) -> DataFrame:
    return df.select(F.col("fingerprint"), F.struct("*").alias(side))


def matched(base: DataFrame, cand: DataFrame) -> DataFrame:
    """(fingerprint, b, c) of the classes that both runs have."""
    return _sides(base, "b").join(_sides(cand, "c"), "fingerprint")


def only_in(one: DataFrame, other: DataFrame) -> DataFrame:
    """Classes that ``other`` does not have."""
    return one.join(other.select("fingerprint"), "fingerprint", "left_anti").select("fingerprint", "count", "errors").orderBy(F.desc("count"), "fingerprint")


def verdict(b_count: Column, c_count: Column, pct: Column, c_us: Column, threshold: float = THRESHOLD_PCT, min_count: int = MIN_COUNT) -> Column:
    """X9. No percentage means that there was nothing before, so anything now is a regression."""
    few = (F.least(b_count, c_count) == 0) | (F.least(b_count, c_count) < min_count)
    worse = F.when(pct.isNull(), c_us > 0).otherwise(pct >= threshold)
    return F.when(few, "low_sample").when(worse, "regressed").when(pct <= -threshold, "improved").otherwise("stable")


def deltas(base: DataFrame, cand: DataFrame, threshold: float = THRESHOLD_PCT, min_count: int = MIN_COUNT) -> DataFrame:
    """A row for each matched class with its changes and its verdict."""
    m = matched(base, cand)
    delta = lambda f: scalars.metric_delta(F.col(f"b.{f}"), F.col(f"c.{f}"))
    sizes = F.when(
        F.col("b.result_bytes").isNotNull() & F.col("c.result_bytes").isNotNull(),
        F.struct(
            F.col("b.result_bytes.mean").alias("baseline_mean"),
            F.col("c.result_bytes.mean").alias("candidate_mean"),
            scalars.pct_change(F.col("b.result_bytes.mean"), F.col("c.result_bytes.mean")).alias("mean_delta_pct"),
            F.col("b.result_bytes.total").alias("baseline_total"),
            F.col("c.result_bytes.total").alias("candidate_total"),
        ),
    )
    out = m.select(
        "fingerprint",
        F.col("b.count").alias("baseline_count"),
        F.col("c.count").alias("candidate_count"),
        (F.col("b.count") != F.col("c.count")).alias("count_mismatch"),
        F.col("b.errors").alias("baseline_errors"),
        F.col("c.errors").alias("candidate_errors"),
        (F.col("c.errors") - F.col("b.errors")).alias("error_delta"),
        *[delta(f"{p}_us").alias(p) for p in ("p50", "p95", "p99", "mean")],
        sizes.alias("result_bytes"),
        "b",
        "c",
    )
    return out.withColumn("verdict", verdict(F.col("baseline_count"), F.col("candidate_count"), F.col("p95.delta_pct"), F.col("p95.candidate_us"), threshold, min_count))


def regressions(d: DataFrame) -> DataFrame:
    """O2: the worst first; what has no percentage is worst."""
    return d.where("verdict = 'regressed'").orderBy(F.desc_nulls_first("p95.delta_pct"), F.desc("p95.delta_us"), "fingerprint")


def improvements(d: DataFrame) -> DataFrame:
    """O3."""
    return d.where("verdict = 'improved'").orderBy("p95.delta_pct", "p95.delta_us", "fingerprint")


def low_sample(d: DataFrame) -> DataFrame:
    """O4."""
    return d.where("verdict = 'low_sample'").orderBy(F.desc(F.coalesce("p95.delta_pct", F.lit(0.0))), "fingerprint")


def stable(d: DataFrame) -> DataFrame:
    """In the baseline's order."""
    return d.where("verdict = 'stable'").orderBy(F.desc("b.p95_us"), F.desc("baseline_count"), "fingerprint")


def error_changes(d: DataFrame) -> DataFrame:
    """U4."""
    return d.where("error_delta <> 0")


def decade_pairs(d: DataFrame, threshold: float = THRESHOLD_PCT, min_count: int = MIN_COUNT) -> DataFrame:
    """Decades that both runs have enough of; ``listed`` where only the decade tells of a regression."""
    side = lambda s: d.select("fingerprint", "verdict", F.explode(f"{s}.size_buckets").alias(s)).withColumn("bucket", F.col(f"{s}.bucket"))
    both = side("b").join(side("c").drop("verdict"), ["fingerprint", "bucket"])
    enough = F.least("b.count", "c.count")
    delta = lambda f: scalars.metric_delta(F.col(f"b.{f}"), F.col(f"c.{f}"))
    out = both.where((enough > 0) & (enough >= min_count)).select(
        "fingerprint",
        "bucket",
        F.col("b.count").alias("baseline_count"),
        F.col("c.count").alias("candidate_count"),
        (F.col("b.count") != F.col("c.count")).alias("count_mismatch"),
        *[delta(f"{p}_us").alias(p) for p in ("p50", "p95", "mean")],
        F.col("b.bytes_total").alias("baseline_bytes_total"),
        F.col("c.bytes_total").alias("candidate_bytes_total"),
        "verdict",
    )
    worse = F.when(F.col("p95.delta_pct").isNull(), F.col("p95.candidate_us") > 0).otherwise(F.col("p95.delta_pct") >= threshold)
    return out.withColumn("listed", worse & (F.col("verdict") != "regressed")).drop("verdict")


def size_regressions(pairs: DataFrame) -> DataFrame:
    """O5."""
    return pairs.where("listed").orderBy(F.desc_nulls_first("p95.delta_pct"), F.desc("p95.delta_us"), "fingerprint", "bucket")


def correctness(d: DataFrame) -> DataFrame:
    """Classes whose results were checksummed in both runs; status is matched, mismatch or advisory."""
    rows = d.where("b.checksum.events > 0 AND c.checksum.events > 0").select(
        "fingerprint",
        *[F.col(f"{s}.checksum.{f}").alias(f"{name}_{n}") for f, n in (("digest", "digest"), ("rows_total", "rows"), ("events", "events")) for s, name in (("b", "baseline"), ("c", "candidate"))],
        (F.col("b.checksum.columns") != F.col("c.checksum.columns")).alias("columns_differ"),
        (F.col("b.checksum.nondeterministic") | F.col("c.checksum.nondeterministic")).alias("nondeterministic"),
        (F.col("b.checksum.events") != F.col("c.checksum.events")).alias("events_differ"),
    )
    status = F.when(F.col("baseline_digest") == F.col("candidate_digest"), "matched").when(F.col("nondeterministic") | F.col("events_differ"), "advisory").otherwise("mismatch")
    return rows.withColumn("status", status).orderBy(F.desc(F.abs(F.col("baseline_rows") - F.col("candidate_rows"))), "fingerprint")


def summary(d: DataFrame, pairs: DataFrame, checks: DataFrame) -> DataFrame:
    """One row of counts, flags and the exit code."""
    one = d.agg(
        F.count_if("count_mismatch").alias("count_mismatches"),
        F.coalesce(F.sum("error_delta"), F.lit(0).cast("long")).alias("error_delta"),
        F.coalesce(F.bool_or(F.col("verdict") == "regressed"), F.lit(False)).alias("regressed"),
    )
    two = pairs.agg(F.count("*").alias("size_buckets_checked"), F.coalesce(F.bool_or("listed"), F.lit(False)).alias("size_regressed"))
    three = checks.agg(F.count("*").alias("checked"), F.count_if(F.col("status") == "matched").alias("matched"), F.count_if(F.col("status") == "mismatch").alias("mismatches"), F.count_if(F.col("status") == "advisory").alias("advisory"))
    out = one.join(F.broadcast(two)).join(F.broadcast(three)).withColumn("correctness_failed", F.col("mismatches") > 0)  # a row each
    return out.withColumn("exit_code", F.when(F.col("regressed") | F.col("size_regressed") | F.col("correctness_failed"), 2).otherwise(0))


def settings_diff(base: DataFrame, cand: DataFrame) -> DataFrame:
    """(name, baseline, candidate) where settings (name, value) differ; null where a side has none."""
    both = base.withColumnRenamed("value", "baseline").join(cand.withColumnRenamed("value", "candidate"), "name", "full_outer")
    return both.where(~F.col("baseline").eqNullSafe(F.col("candidate"))).orderBy("name")


def flag_rows(run: DataFrame) -> DataFrame:
    """(name, value, knob) of a run's flags; a flag that is not set shows as ``<none>``."""
    rows = [F.struct(F.lit(f.replace("_", "-")).alias("name"), F.coalesce(F.col(f"flags.{f}").cast("string"), F.lit("<none>")).alias("value"), F.lit(f in KNOBS).alias("knob"), F.lit(i).alias("at")) for i, f in enumerate(KNOBS + FILTERS)]
    return run.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def flag_diff(base: DataFrame, cand: DataFrame) -> DataFrame:
    """(name, baseline, candidate) of flags that differ; knobs only if both runs were replayed."""
    replayed = lambda run: flag_rows(run).join(F.broadcast(run.select((F.col("latency_source") != "recorded-slow-log").alias("replayed"))))
    b, c = replayed(base), replayed(cand)
    both = b.select("name", "at", "knob", F.col("value").alias("baseline"), F.col("replayed").alias("b")).join(c.select("name", F.col("value").alias("candidate"), F.col("replayed").alias("c")), "name")
    return both.where("baseline <> candidate AND (NOT knob OR (b AND c))").orderBy("at").select("name", "baseline", "candidate")


@dataclass
class Comparison:
    """What two run reports (one row each) say about each other."""

    base: DataFrame
    cand: DataFrame
    threshold: float = THRESHOLD_PCT
    min_count: int = MIN_COUNT

    def __post_init__(self):
        self.base_classes, self.cand_classes = classes_of(self.base), classes_of(self.cand)
        self.deltas = deltas(self.base_classes, self.cand_classes, self.threshold, self.min_count)
        self.pairs = decade_pairs(self.deltas, self.threshold, self.min_count)
        self.checks = correctness(self.deltas)
        self.summary = summary(self.deltas, self.pairs, self.checks)
        self.only_base, self.only_cand = only_in(self.base_classes, self.cand_classes), only_in(self.cand_classes, self.base_classes)
        settings = lambda run: run.select(F.explode("target_settings").alias("name", "value"))
        self.settings = settings_diff(settings(self.base), settings(self.cand))
        self.flags = flag_diff(self.base, self.cand)

    def totals(self) -> DataFrame:
        """F16: totals of both runs and their changes."""
        side = lambda run, name: run.select(*[F.col(c).alias(f"{name}_{n}") for c, n in (("totals.qps", "qps"), ("wall_secs", "wall_secs"), ("totals.executed", "executed"), ("totals.errors", "errors"))])
        both = side(self.base, "baseline").join(F.broadcast(side(self.cand, "candidate")))
        change = lambda f: scalars.pct_change(F.col(f"baseline_{f}"), F.col(f"candidate_{f}"))
        return both.withColumns({"qps_delta_pct": change("qps"), "wall_delta_pct": change("wall_secs"), "error_delta": F.col("candidate_errors") - F.col("baseline_errors")})


def checks_of_runs(base: DataFrame, cand: DataFrame) -> DataFrame:
    """(check, fires) by one look at the two runs."""
    pick = lambda run, s: run.select(F.struct("capture_file", "capture_dialect", "target_server_version", "latency_source", "aborted", F.col("flags.checksum").alias("checksum")).alias(s))
    both = pick(base, "b").join(F.broadcast(pick(cand, "c")))
    recorded = lambda s: F.col(f"{s}.latency_source") == "recorded-slow-log"
    family = lambda s: scalars.server_family(F.col(f"{s}.target_server_version"))
    fires = {
        "capture_file": F.col("b.capture_file") != F.col("c.capture_file"),
        "capture_dialect": F.col("b.capture_dialect") != F.col("c.capture_dialect"),
        "engine_family": F.coalesce(family("b") != family("c"), F.lit(False)),
        "measurement_planes": recorded("b") != recorded("c"),
        "aborted": F.col("b.aborted") | F.col("c.aborted"),
        "checksum_one_sided": F.col("b.checksum") != F.col("c.checksum"),
    }
    return both.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("fires")) for k, v in fires.items()])).alias("x")).select("x.*")
