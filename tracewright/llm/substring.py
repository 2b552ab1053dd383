"""Operator 9: removal of repeated passages with a log-structured fingerprint index.

A window is WINDOW = 50 consecutive words. Its fingerprint is the least hash of its 26 runs of 25 words, so equal windows have equal
fingerprints while a text has about two fingerprints for every 27 words: the index stays small, and no window is left out.

``FingerprintIndex`` keeps sorted immutable runs in a folder, named by a manifest there, and can be opened again. Runs are dealt out by
fingerprint to a fixed number of buckets and sorted in each, so a batch is shuffled once, by itself, and merge-joined with every run as the
run lies. What a batch has becomes a run of its own; once there are more than ``fan`` runs they are merged into one. ``ingest`` returns the
(fingerprint, doc_id) pairs that have come to be shared by documents, in the batch or before it.

These are candidates only. Their windows are brought together by hashes over all their 50 words, and of each the smallest doc_id is the
source. Stretches of windows that one source has in the same order are then compared with the source's words, word by word, and only
what is equal is removed. The words of a source travel in blocks of BLOCK words. Documents that have the same words as one of a
smaller doc_id are settled by their SHA-256 alone, so groups of copies cost one document.

Cases: null texts and texts under 50 words have no window and stay as they are. Texts of any length are hashed whole, SEGMENT bytes at a time. Repeated
rows are judged alike. If a doc_id has several texts, each is judged; they do not take words from each other. A null doc_id
neither loses words nor takes them from others. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import hadoop_path, materialize, removed, settings, shared_path, table, tuned

WINDOW, GRAM, BATCHES, FAN, BLOCK = 50, 25, 4, 2, 64
RUN = "print long, doc_id long, shared boolean, alone long"
#: Windows that are sent at once.
SENT = 1 << 16
#: Bytes of a text that are hashed at once.
SEGMENT = 1 << 20
#: Odd multipliers of the rolling hashes over bytes, and over words for fingerprints and for windows: fixed values.
BYTE_BASE, GRAM_BASE, WINDOW_BASES = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            made.append(np.multiply.accumulate(out))
        _powers[base] = made[0], made[1]
    return _powers[base]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(text):
        end = len(text)
        if end - at > SEGMENT:  # cut where a word ends
            part = np.frombuffer(text, np.uint8, count=end - at, offset=at)
            step = SEGMENT
            while at + step < end and not _SPACE[part[step]]:
                step += 1
            end = at + step
        data = np.frombuffer(text, np.uint8, count=end - at, offset=at)
        word = ~_SPACE[data]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        powers, inverse = _tables(BYTE_BASE, len(data))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], dtype=np.uint64)))
        out.append(_mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(GRAM_BASE)))
        at = end
    return np.concatenate(out)


def rolling(words: np.ndarray, k: int, base: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` words."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    powers, inverse = _tables(base, n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers[:n], dtype=np.uint64)))
    return _mixed((sums[k:] - sums[: n - k + 1]) * inverse[: n - k + 1])


def window_prints(words: np.ndarray) -> np.ndarray:
    """The fingerprint of each window: the least hash among its runs of GRAM words."""
    least = rolling(words, GRAM, GRAM_BASE)
    span, step = WINDOW - GRAM + 1, 1
    if len(least) < span:
        return np.zeros(0, np.uint64)
    while 2 * step <= span:
        least = np.minimum(least[: len(least) - step], least[step:])
        step *= 2
    return np.minimum(least[: len(least) - (span - step)], least[span - step :])


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _sign(batches):
    for batch in batches:
        shas, counts, prints = [], [], []
        for text in batch.column("text").to_pylist():
            words = (text or b"").split()
            shas.append(_sha(words))
            counts.append(len(words))
            prints.append(np.unique(window_prints(word_hashes(text or b""))).view(np.int64))
        yield pa.record_batch([batch.column("doc_id"), pa.array(shas), pa.array(counts, pa.int64()), pa.array(prints, pa.list_(pa.int64()))], ["doc_id", "sha", "n_words", "prints"])


def _windows(batches):
    """The windows whose fingerprint is shared: hashes over all their words, and where they start."""
    for batch in batches:
        out, held = [], 0
        for doc_id, text, shared in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "shared")), strict=True):
            words = word_hashes(text)
            at = np.flatnonzero(np.isin(window_prints(words), np.array(shared, np.int64).view(np.uint64)))
            one, two = (rolling(words, WINDOW, b)[at] for b in WINDOW_BASES)
            out.append((one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32), np.full(len(at), doc_id, np.int64), at.astype(np.int32)))
            held += len(at)
            if held >= SENT:
                yield _joined(out)
                out, held = [], 0
        if held:
            yield _joined(out)


def _joined(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], ["one", "two", "doc_id", "at"])


def _stretches(batches):
    """Of the windows that documents have from others: stretches that one source has in the same order."""
    for batch in batches:
        rows = []
        for doc_id, claims in zip(batch.column("doc_id").to_pylist(), batch.column("claims").to_pylist(), strict=True):
            last = None
            for at, source, start in sorted((c["at"], c["source"], c["start"]) for c in claims):
                if last and (at, source, start) == (last[1] + last[2], last[3], last[4] + last[2]):
                    last[2] += 1
                else:
                    last = [doc_id, at, 1, source, start]
                    rows.append(last)
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "at", "n", "source", "start"])


def _blocks(batches):
    """The blocks of words that are asked for."""
    for batch in batches:
        rows = []
        for doc_id, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "blocks")), strict=True):
            words = text.split()
            rows += [(doc_id, k, b" ".join(words[k * BLOCK : (k + 1) * BLOCK])) for k in wanted if k * BLOCK < len(words)]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["source", "block", "words"])


def covered(words: list[bytes], stretches: list[tuple[int, int, int, int]], blocks: dict[tuple[int, int], list[list[bytes]]]) -> np.ndarray:
    """Which words lie in windows that are, word by word, in their source. ``blocks`` has those of each text of a source."""
    edge = np.zeros(len(words) + 1, np.int64)
    for at, n, source, start in stretches:
        length = min(n + WINDOW - 1, len(words) - at)
        equal = np.array([any(p % BLOCK < len(b) and b[p % BLOCK] == w for b in blocks.get((source, p // BLOCK), ())) for p, w in enumerate(words[at : at + max(0, length)], start)], bool)
        ends = np.cumsum(np.concatenate(([0], equal)))
        whole = np.flatnonzero(ends[WINDOW:] - ends[:-WINDOW] == WINDOW) + at
        edge[whole] += 1
        edge[whole + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


def _cut(batches):
    for batch in batches:
        rows = []
        for doc_id, text, stretches, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "stretches", "parts")), strict=True):
            words = text.split()
            blocks: dict = {}
            for x in parts:
                blocks.setdefault((x["source"], x["block"]), []).append(x["words"].split())
            gone = covered(words, [(x["at"], x["n"], x["source"], x["start"]) for x in stretches], blocks)
            rows.append((doc_id, _sha(words), int(gone.sum()), _sha([w for w, g in zip(words, gone.tolist(), strict=True) if not g])))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], ["doc_id", "sha", "n_removed", "kept_sha256"])


class FingerprintIndex:
    """Sorted immutable runs of (print, doc_id, shared, alone): the smallest doc_id that has a print, whether others have it, and the one
    that had it alone until this run. ``path`` is a folder of its own, new or with an index; its newest manifest says which runs count."""

    def __init__(self, spark: SparkSession, path: str | None = None, fan: int = FAN):
        self.spark, self.path, self.fan = spark, path or shared_path(spark, "index"), fan
        files, folder = hadoop_path(spark, self.path)
        found = [str(f.getPath().getName()) for f in files.listStatus(folder)] if files.exists(folder) else []
        manifests = sorted(n for n in found if n.startswith("manifest-"))
        held = {"buckets": int(spark.conf.get("spark.sql.shuffle.partitions")), "runs": [], "written": 0}
        if manifests:
            stream = files.open(hadoop_path(spark, f"{self.path}/{manifests[-1]}")[1])
            try:
                held = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        self.version = int(manifests[-1][9:17]) if manifests else 0
        self.buckets, self.runs, self.written = held["buckets"], held["runs"], held["written"]

    def _commit(self, runs: list[str]) -> None:
        """From here on ``runs`` count: a manifest is written aside and renamed, so a reader finds the one before it or this one whole."""
        self.runs, self.version = runs, self.version + 1
        files, aside = hadoop_path(self.spark, f"{self.path}/_{uuid.uuid4().hex}")
        out = files.create(aside)
        out.writeBytes(json.dumps({"buckets": self.buckets, "runs": self.runs, "written": self.written}))
        out.close()
        if not files.rename(aside, hadoop_path(self.spark, f"{self.path}/manifest-{self.version:08d}.json")[1]):
            raise RuntimeError(f"{self.path} is being written by another")

    def _settings(self):
        return settings(self.spark, {"spark.sql.shuffle.partitions": str(self.buckets), "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"})

    def _add(self, rows: DataFrame) -> str:
        name, t = f"run-{self.written:06d}", f"tracewright_{uuid.uuid4().hex}"
        self.written += 1
        rows.write.bucketBy(self.buckets, "print").sortBy("print").option("path", f"{self.path}/{name}").saveAsTable(t)
        self.spark.sql(f"DROP TABLE {t}")  # the catalog's entry; the files are not its own
        return name

    def run(self, name: str) -> DataFrame:
        """A run as Spark has to see it in order to know how it is dealt out and sorted; the catalog keeps no entry of it."""
        t = f"tracewright_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {t} ({RUN}) USING parquet CLUSTERED BY (print) SORTED BY (print) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        try:
            return self.spark.read.table(t)
        finally:
            self.spark.sql(f"DROP TABLE {t}")

    def history(self) -> DataFrame:
        """(print, doc_id, shared) of all runs."""
        rows = self.spark.createDataFrame([], RUN) if not self.runs else self.run(self.runs[0])
        for name in self.runs[1:]:
            rows = rows.unionByName(self.run(name))
        return rows.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.bool_or("shared").alias("shared"))

    def ingest(self, pairs: DataFrame) -> DataFrame:
        """Takes in (print, doc_id) and returns those pairs, of the batch and of before, that have come to be shared. The result reads files of this index."""
        with self._settings():
            held = pairs.groupBy("print").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
            for i, name in enumerate(self.runs):
                held = held.join(self.run(name).select("print", F.col("doc_id").alias(f"doc{i}"), F.col("shared").alias(f"shared{i}")).hint("merge"), "print", "left")
            n = range(len(self.runs))
            before = F.least(*[F.col(f"doc{i}") for i in n], F.lit(None).cast("long")) if len(n) else F.lit(None).cast("long")
            known = F.coalesce(F.greatest(*[F.col(f"shared{i}") for i in n], F.lit(False)) if len(n) else F.lit(False), F.lit(False))
            held = held.withColumns({"before": before, "known": known}).withColumn("shared", F.expr("known OR first < last OR coalesce(before <> first, false)"))
            name = self._add(held.select("print", F.least("first", "before").alias("doc_id"), "shared", F.when(F.expr("shared AND NOT known"), F.col("before")).alias("alone")))
        self._commit([*self.runs, name])
        made = self.spark.read.schema(RUN).parquet(f"{self.path}/{name}")  # read without its buckets, a join can split a print that very many documents have
        met = pairs.join(made.where("shared").select("print").hint("merge"), "print").select("print", "doc_id")
        if len(self.runs) > self.fan:
            self.compact()
        return met.unionByName(made.where("alone IS NOT NULL").select("print", F.col("alone").alias("doc_id")))

    def compact(self) -> None:
        """Merges all runs into one. Those before stay until ``vacuum``."""
        with self._settings():
            name = self._add(self.history().withColumn("alone", F.lit(None).cast("long")))
        self._commit([name])

    def vacuum(self, everything: bool = False) -> None:
        """Removes the files of runs that no longer count, or of the whole index."""
        if everything:
            removed(self.spark, self.path)
        else:
            for k in range(self.written):
                if f"run-{k:06d}" not in self.runs:
                    removed(self.spark, f"{self.path}/run-{k:06d}")


def remove_repeats(docs: DataFrame, batches: int = BATCHES, index: FingerprintIndex | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs``.

    The fingerprints are taken in in ``batches``. With an ``index`` they stay there; else it is removed when it has served.
    """
    spark = tuned(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = materialize(texts.mapInArrow(_sign, "doc_id long, sha string, n_words long, prints array<long>"), "signed")
    # Of each distinct sequence of words the first document stands for all.
    heads = materialize(signed.where("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("first")), "heads")
    stands = heads.select("sha", F.col("first").alias("doc_id"), F.pmod(F.xxhash64("sha"), F.lit(batches)).alias("batch"))
    named = signed.where("size(prints) > 0").join(stands.hint("merge"), ["sha", "doc_id"]).select("batch", "doc_id", "prints")
    named = materialize(named.sortWithinPartitions("batch"), "named")
    own = index or FingerprintIndex(spark)
    met = [own.ingest(named.where(F.col("batch") == k).select(F.explode("prints").alias("print"), "doc_id")) for k in range(batches)]
    hits = met[0]
    for m in met[1:]:
        hits = hits.unionByName(m)
    hits = materialize(hits.groupBy("doc_id").agg(F.collect_set("print").alias("shared")), "hits")
    own.vacuum(everything=index is None)
    held = materialize(texts.join(hits.hint("merge"), "doc_id").select("doc_id", "text", "shared"), "candidates")
    windows = materialize(held.mapInArrow(_windows, "one long, two int, doc_id long, at int"), "windows")
    firsts = windows.groupBy("one", "two").agg(F.min("doc_id").alias("source"), F.min_by("at", "doc_id").alias("start"), F.max("doc_id").alias("last"))
    firsts = materialize(firsts.where("source < last").drop("last"), "sources")
    claims = windows.join(firsts.hint("merge"), ["one", "two"]).where("doc_id > source").groupBy("doc_id").agg(F.collect_set(F.struct("at", "source", "start")).alias("claims"))
    stretches = materialize(claims.mapInArrow(_stretches, "doc_id long, at int, n int, source long, start int"), "stretches")
    spread = stretches.withColumn("block", F.explode(F.expr(f"cast(sequence(start div {BLOCK}, (start + n + {WINDOW - 2}) div {BLOCK}) AS array<int>)")))
    wanted = spread.select("source", "block").distinct().groupBy(F.col("source").alias("doc_id")).agg(F.collect_list("block").alias("blocks"))
    blocks = materialize(held.join(wanted.hint("merge"), "doc_id").mapInArrow(_blocks, "source long, block int, words binary").distinct(), "blocks")
    told = spread.join(blocks.hint("merge"), ["source", "block"]).groupBy("doc_id").agg(F.collect_set(F.struct("at", "n", "source", "start")).alias("stretches"), F.collect_set(F.struct("source", "block", "words")).alias("parts"))
    cut = held.select("doc_id", "text").join(told.hint("merge"), "doc_id").mapInArrow(_cut, "doc_id long, sha string, n_removed long, kept_sha256 string")
    cut = materialize(cut.dropDuplicates(["doc_id", "sha"]), "cut")
    copy = F.expr(f"doc_id > first AND n_words >= {WINDOW}")
    known = signed.select("doc_id", "sha", "n_words").join(heads.hint("merge"), "sha", "left").join(cut.hint("merge"), ["doc_id", "sha"], "left")
    return known.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_sha([]))).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
