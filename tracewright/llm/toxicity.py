"""Operator 10: toxicity by class-conditional Kneser-Ney models of word sequences.

Words are lower-cased (A-Z). Each class, toxic and ordinary, has a model of three layers, every one of which discounts its counts and leaves
what that frees to the layer below:

* pairs of words, and below them words, by the class's continuation counts (after how many different words it has seen them), so
  that copies of a text count once;
* the spelling of words as bytes, in runs of ORDER bytes. The class's counts, of distinct words, are used for the longest runs only. Below
  them both classes back off to shared continuation counts, so a rare expression that neither class favours weighs nothing.

Words and pairs are discounted by one: what was seen once is left to the layer below. A pair's backoff weight is that of both classes
together, so a pair seen in neither class weighs what its second word weighs.

A word's ratio is the difference of its log-likelihoods in the two models. A text is scored by its ratios normalised for length: that of
the whole text, those of its worst passages of PASSAGES words, and that of the text as a mixture, in which a share of SHARE of the words
is toxic and the rest ordinary. A logistic regression on these, fitted on labelled rows that the models have not seen, makes them a probability, and
is shifted to the share of toxic rows among all training labels.

The models are fitted in one task on a bounded sample of labelled rows: SAMPLE = (toxic, ordinary) rows at most, those whose doc_id has the
smallest hashes, and SAMPLE_BYTES of their text at most. What executors get are tables of the sample's words, pairs and byte runs.

Cases: null and empty texts have the ratios 0. Texts of any length are scored whole, BATCH_BYTES of texts at a time, and a longer text by itself; a text
longer than a sixteenth of SAMPLE_BYTES is not learnt from. Rows of ``labels`` without a label or a document do not count; if a doc_id has
several labels, the largest does; if it has several texts, the smallest is learnt from. If a class has no rows to learn from, every
score is the share of toxic rows, 0 if there are none. A null doc_id hashes as the empty text and has no label. Repeated rows are
scored alike. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.common import LOWER, fold, materialize, table, tuned
from tracewright.llm.substring import _mixed, word_hashes

ORDER, PASSAGES, SHARE, THRESHOLD = 8, (1, 2, 4, 8), 0.002, 0.3
SAMPLE, SAMPLE_BYTES = (3000, 6000), 32 << 20
#: What a word must have been followed by, before its pairs count for more than the words below them.
PRIOR = 1000
#: One in so many sampled rows calibrates; the models have the others.
CALIBRATE = 5
#: Bytes of texts that are looked up together.
BATCH_BYTES = 1 << 19
#: Parts in which pairs are counted, one after the other.
SHARDS = 16
#: Multiplier that tells the first word of a pair from the second: a fixed value.
FIRST = np.uint64(0x9E3779B97F4A7C15)
RESULT = "doc_id long, held_out boolean, score double, predicted int"


def _spellings(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each word and the blank after it: the run of ORDER bytes that ends there; and where each word starts."""
    pad = b" " * (ORDER - 1)
    data = np.frombuffer(pad + pad.join(w + b" " for w in words), np.uint8).astype(np.uint64)
    runs = np.zeros(len(data) - ORDER + 1, np.uint64)
    for j in range(ORDER):
        runs = (runs << np.uint64(8)) | data[j : len(data) - ORDER + 1 + j]
    lengths = np.array([len(w) + 1 for w in words])
    starts = np.concatenate(([0], np.cumsum(lengths + ORDER - 1)[:-1]))
    keep = np.ones(len(runs), bool)
    for j in range(ORDER - 1):
        keep[(starts[1:] - 1 - j)] = False
    return runs[keep], np.concatenate(([0], np.cumsum(lengths)[:-1]))


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, weights=weights, minlength=len(found))


def _discount(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return one / (one + 2 * two) if one else 0.5


def _places(keys: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key among the sorted ``found``, and whether it is there."""
    if not len(found):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(found, keys), len(found) - 1)
    return at, found[at] == keys


def _of(keys: np.ndarray, found: np.ndarray, values: np.ndarray, default: float) -> np.ndarray:
    at, there = _places(keys, found)
    return np.where(there, values[at], default) if len(found) else np.full(len(keys), default)


def _shared(runs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shared model's probability of the last byte of each of the sorted distinct ``runs`` after the bytes before it."""
    levels, own = [], (runs, counts)
    for k in range(ORDER, 0, -1):
        levels.append(own)
        shorter = own[0] & np.uint64((1 << 8 * (k - 1)) - 1)
        own = _summed(shorter, np.ones(len(shorter), np.float32))  # how many different bytes come before
    below, p = np.zeros(1, np.uint64), np.full(1, 1 / 256)
    for k, (keys, n) in zip(range(1, ORDER + 1), levels[::-1], strict=True):
        d = _discount(n)
        context, place = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, kinds = np.bincount(place, weights=n, minlength=len(context)), np.bincount(place, minlength=len(context))
        under = _of(keys & np.uint64((1 << 8 * (k - 1)) - 1), below, p, 1 / 256)
        below, p = keys, (n - d + d * kinds[place] * under) / total[place]
    return p


class Spelling:
    """Both classes' models of how words are spelled, learnt from the distinct words of each class."""

    def __init__(self, words: list[list[bytes]]):
        sides = []
        for names in words:
            found = (np.zeros(0, np.uint64), np.zeros(0))
            for at in range(0, len(names), 10_000):
                keys = _spellings(names[at : at + 10_000])[0]
                found = _summed(np.concatenate((found[0], keys)), np.concatenate((found[1], np.ones(len(keys)))))
            sides.append(found)
        self.runs, counts = _summed(np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides]))
        shared = _shared(self.runs, counts)
        self.contexts, place = np.unique(self.runs >> np.uint64(8), return_inverse=True)
        self.logs, self.unseen = np.zeros((2, len(self.runs)), np.float32), np.zeros((2, len(self.contexts)), np.float32)
        for c, (keys, n) in enumerate(sides):
            d = _discount(n)
            own = _of(self.runs, keys, n, 0.0)
            total, kinds = np.bincount(place, weights=own, minlength=len(self.contexts)), np.bincount(place, weights=own > 0, minlength=len(self.contexts))
            left = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            self.logs[c] = np.log(np.maximum(own - d, 0) / np.maximum(total[place], 1) + left[place] * shared)
            self.unseen[c] = np.log(left)

    def log(self, words: list[bytes]) -> np.ndarray:
        """The log-likelihood of each word's spelling in the ordinary and the toxic model; a run that neither has seen is one byte of 256."""
        out = np.zeros((2, len(words)))
        for at in range(0, len(words), 10_000):
            some = words[at : at + 10_000]
            runs, starts = _spellings(some)
            place, hit = _places(runs, self.runs)
            context, met = _places(runs >> np.uint64(8), self.contexts)
            for c in (0, 1):
                value = np.where(hit, self.logs[c][place], np.where(met, self.unseen[c][context], 0.0) - np.log(256)).astype(np.float64)
                out[c, at : at + len(some)] = np.add.reduceat(value, starts)
        return out


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, in order, and where each is first; worked out in parts, as sorting takes several times the room."""
    found = []
    for k in range(SHARDS):
        at = np.flatnonzero(hashes % np.uint64(SHARDS) == k)
        some, first = np.unique(hashes[at], return_index=True)
        found.append((some, at[first]))
    values, places = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(values)
    return values[order], places[order]


def _picked(texts: list[bytes], lengths: list[int], places: np.ndarray) -> list[bytes]:
    """The words at ``places`` among all words of the texts."""
    out: list[bytes] = [b""] * len(places)
    order = np.argsort(places)
    bounds = np.searchsorted(places[order], np.cumsum([0, *lengths]))
    start = 0
    for text, n, lo, hi in zip(texts, lengths, bounds, bounds[1:], strict=False):
        if hi > lo:
            words = text.split()
            for k in order[lo:hi].tolist():
                out[k] = words[places[k] - start]
        start += n
    return out


def _seen(hashes: np.ndarray, lengths: list[int]) -> dict[str, np.ndarray]:
    """What a class has seen, from the hashes of its texts' words. Each pair counts by the different words before it.

    words: after how many different words each came; firsts: the total of each word's pairs, and their kinds; pairs: those that count more than once.
    """
    starts = np.cumsum([0, *lengths])[:-1][np.array(lengths, np.int64) > 0]

    def back(at: np.ndarray, by: int) -> np.ndarray:
        """The word ``by`` places before; a text starts after empty words, so its first word and pair have a word before them, too."""
        begin = starts[np.searchsorted(starts, at, side="right") - 1]
        return np.where(at - by >= begin, hashes[np.maximum(at - by, 0)], np.uint64(0))

    shard, found = np.zeros(len(hashes), np.uint8), []
    for lo in range(0, len(hashes), 1 << 18):
        at = np.arange(lo, min(len(hashes), lo + (1 << 18)))
        shard[at] = _mixed(back(at, 1) * FIRST + hashes[at]) % np.uint64(SHARDS)
    for k in range(SHARDS):  # a pair is in one shard
        at = np.flatnonzero(shard == k)
        first = back(at, 1)
        pair = _mixed(first * FIRST + hashes[at])
        own = np.unique(_mixed(back(at, 2) * FIRST + pair), return_index=True)[1]
        keys, place, n = np.unique(pair[own], return_index=True, return_counts=True)
        first, second = first[own[place]], hashes[at[own[place]]]
        often = np.flatnonzero(n > 1)
        ends = np.unique(second, return_counts=True)
        begins, own = np.unique(first, return_inverse=True)
        found.append((*ends, begins, np.bincount(own, weights=n), np.bincount(own), keys[often], n[often], first[often], second[often]))
    words, after, firsts, total, kinds, pairs, n, first, second = (np.concatenate(x) for x in zip(*found, strict=True))
    words, after = _summed(words, after)
    total, kinds = _summed(firsts, total)[1], _summed(firsts, kinds)[1]
    order = np.argsort(pairs)
    return {"words": words, "after": after, "firsts": np.unique(firsts), "total": total, "kinds": kinds, "pairs": pairs[order], "n": n[order].astype(np.float64), "first": first[order], "second": second[order]}


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """A key for each word with the one before it, from the second word on."""
    return _mixed(hashes[:-1] * FIRST + hashes[1:])


class Ratios:
    """The two classes' models, as the ratios of words and pairs that differ from what the spelling says."""

    def __init__(self, texts: list[bytes], toxic: list[bool]):
        """``texts`` in lower case. Hashes stand for words, but for the distinct words of a class, whose spelling is learnt."""
        known, spoken, seen = [], [], []
        for c in (False, True):
            side = [t for t, x in zip(texts, toxic, strict=True) if bool(x) == c]
            hashes = [word_hashes(t) for t in side]
            lengths = [len(h) for h in hashes]
            hashes = np.concatenate([np.zeros(0, np.uint64), *hashes])
            some, at = _distinct(hashes)
            known.append(some)
            spoken.append(_picked(side, lengths, at))
            seen.append(_seen(hashes, lengths))
        self.spelling = Spelling(spoken)
        vocabulary = np.union1d(*known)
        # Words by continuation counts, discounted by one; the rest of the mass is spelled.
        self.left, own = [], []
        for x in seen:
            total = max(1.0, float(x["after"].sum()))
            own.append(np.maximum(_of(vocabulary, x["words"], x["after"], 0.0) - 1, 0) / total)
            self.left.append(max(1.0, float(len(x["words"]))) / total)
        said = np.flatnonzero((own[0] > 0) | (own[1] > 0) | np.isin(vocabulary, np.concatenate([x["second"] for x in seen])))
        at, there = _places(vocabulary[said], known[0])
        other = _places(vocabulary[said], known[1])[0]
        spelled = self.spelling.log([spoken[0][i] if t else spoken[1][j] for i, t, j in zip(at.tolist(), there.tolist(), other.tolist(), strict=True)])
        p = [own[c][said] + self.left[c] * np.exp(spelled[c]) for c in (0, 1)]
        self.words, self.of_word = vocabulary[said], np.log(p[1] / p[0]).astype(np.float32)
        # Pairs that a class has seen after more than one word.
        self.pairs, place = np.unique(np.concatenate([x["pairs"] for x in seen]), return_index=True)
        first, second = (np.concatenate([x[k] for x in seen])[place] for k in ("first", "second"))
        at = np.searchsorted(self.words, second)
        total = [_of(first, x["firsts"], x["total"], 0.0) for x in seen]
        free = (sum(_of(first, x["firsts"], x["kinds"], 0.0) for x in seen) + 2 * PRIOR) / (total[0] + total[1] + 2 * PRIOR)
        q = [np.maximum(_of(self.pairs, x["pairs"], x["n"], 0.0) - 1, 0) / (total[c] + PRIOR) + free * p[c][at] for c, x in enumerate(seen)]
        self.of_pair = np.log(q[1] / q[0]).astype(np.float32)

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ratio of each word of each of ``texts``, which are in lower case."""
        each = [word_hashes(t) for t in texts]
        hashes = np.concatenate([np.zeros(0, np.uint64), *each])
        at, there = _places(hashes, self.words)
        ratio = np.where(there, self.of_word[at], 0.0) if len(self.words) else np.zeros(len(hashes))
        rest = np.flatnonzero(~there)
        if len(rest):
            _, first, place = np.unique(hashes[rest], return_index=True, return_inverse=True)
            spoken = [w for t in texts for w in t.split()]
            spelled = self.spelling.log([spoken[i] for i in rest[first].tolist()])
            ratio[rest] = (spelled[1] - spelled[0] + np.log(self.left[1]) - np.log(self.left[0]))[place]
        out, start = [], 0
        for h in each:
            own = ratio[start : start + len(h)]
            start += len(h)
            if len(h):
                at, there = _places(_pairs(np.concatenate((np.zeros(1, np.uint64), h))), self.pairs)
                own = np.where(there, self.of_pair[at], own) if len(self.pairs) else own
            out.append(own)
        return out


def features(ratios: np.ndarray) -> list[float]:
    """The text's ratio for each word, those of its worst passages, and the ratio of the text as a mixture."""
    if not len(ratios):
        return [0.0] * (len(PASSAGES) + 2)
    sums = np.concatenate(([0.0], np.cumsum(ratios)))
    spans = [min(k, len(ratios)) for k in PASSAGES]
    worst = [float((sums[k:] - sums[:-k]).max()) / k for k in spans]
    return [float(sums[-1]) / len(ratios), *worst, float(np.log1p(SHARE * np.expm1(np.minimum(ratios, 50.0))).sum())]


def scaled(x: np.ndarray) -> np.ndarray:
    """Ratios count by their roots."""
    return np.sign(x) * np.sqrt(np.abs(x))


def weighed(ratios: Ratios, texts: list[bytes | None]) -> np.ndarray:
    """A row of features for each text."""
    rows, some, size = [], [], 0
    for i, t in enumerate(texts):
        some.append((t or b"").translate(LOWER))
        size += len(some[-1])
        if size >= BATCH_BYTES or i + 1 == len(texts):
            rows += [features(r) for r in ratios.of(some)]
            some, size = [], 0
    return scaled(np.array(rows).reshape(len(rows), len(PASSAGES) + 2))


def calibrate(x: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """(weights, offset, means, scales) of a logistic regression with a slight ridge, by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w, ridge = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (toxic - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1]), mean, scale


def sampled(docs: DataFrame, marks: DataFrame, rows: tuple[int, int], most_bytes: int) -> DataFrame:
    """(doc_id, toxic, text) to learn from: by the hash of doc_id, as many rows and bytes as are allowed."""
    chosen = [marks.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(k) for t, k in ((True, rows[0]), (False, rows[1]))]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # sum(rows) rows at most
    texts = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes // 16).join(chosen, "doc_id")
    texts = materialize(texts.groupBy("doc_id", "toxic").agg(F.min(F.col("text").cast("binary")).alias("text")), "sample")
    # Both classes' bytes are added up in one order of at most sum(rows) rows, of lengths only.
    order = W.partitionBy(F.lit(1)).orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    fits = texts.select("doc_id", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(order).alias("bytes")).where(F.col("bytes") <= most_bytes).select("doc_id")
    return texts.join(F.broadcast(fits), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> dict:
    """The model of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), which are training rows only."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    n = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = n.get(True, 0) / max(1, sum(n.values()))
    rows = sampled(docs, marks, sample, most_bytes).repartition(1).sortWithinPartitions("doc_id")  # bounded, so one task holds it
    made = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text").mapInArrow(_fit, "model binary").toArrow().column(0).to_pylist()
    return {"share": share} | (pickle.loads(made[0]) if made else {})


def _fit(batches):
    """The models and the calibration of all rows, pickled; nothing if one class has no rows to learn from or to calibrate by."""
    table = pa.Table.from_batches(list(batches), pa.schema([("doc_id", pa.int64()), ("toxic", pa.bool_()), ("text", pa.binary())]))
    toxic, texts = table.column("toxic").to_pylist(), table.column("text")
    fitting = [zlib.crc32(str(d).encode()) // 4 % CALIBRATE > 0 for d in table.column("doc_id").to_pylist()]
    if any(len({t for t, f in zip(toxic, fitting, strict=True) if f == side}) < 2 for side in (True, False)):
        return
    of = lambda side: [i for i, f in enumerate(fitting) if f == side]
    model = Ratios([(texts[i].as_py() or b"").translate(LOWER) for i in of(True)], [toxic[i] for i in of(True)])
    x = np.concatenate([weighed(model, [texts[i].as_py()]) for i in of(False)])
    y = np.array([toxic[i] for i in of(False)], np.float64)
    w, offset, mean, scale = calibrate(x, y)
    odds = lambda p: np.log(p / (1 - p))
    fitted = {"model": model, "weights": w, "offset": offset, "mean": mean, "scale": scale, "rate": odds(y.mean())}
    yield pa.record_batch([pa.array([pickle.dumps(fitted)], pa.binary())], ["model"])


def probabilities(fitted: dict, texts: list[bytes | None]) -> np.ndarray:
    if "model" not in fitted:
        return np.full(len(texts), fitted["share"])
    x = (weighed(fitted["model"], texts) - fitted["mean"]) / fitted["scale"]
    shift = np.log(fitted["share"] / (1 - fitted["share"])) - fitted["rate"]  # from the share of toxic rows that calibrated to that of all
    return 1 / (1 + np.exp(-np.clip(x @ fitted["weights"] + fitted["offset"] + shift, -500, 500)))


def _scorer(sent):
    def score(batches):
        for batch in batches:
            p = probabilities(sent.value, batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return score


def scores(docs: DataFrame, fitted: dict, modulus: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text)."""
    spark = tuned(docs.sparkSession)
    sent = spark.sparkContext.broadcast(fitted)  # bounded by the sample
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", modulus) == held).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_scorer(sent), RESULT)


def _acceptor(sent):
    def accept(batches):
        for batch in batches:
            p = probabilities(sent.value, batch.column("text").cast(pa.binary()).to_pylist())
            yield batch.filter(pc.less(pa.array(p, pa.float64()), THRESHOLD))

    return accept


def accepted(docs: DataFrame, fitted: dict) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not called toxic."""
    spark = tuned(docs.sparkSession)
    return docs.mapInArrow(_acceptor(spark.sparkContext.broadcast(fitted)), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    train_rows = lambda df: df.where(fold("doc_id", modulus) != held)
    return scores(docs, fit(train_rows(docs.select("doc_id", "text")), train_rows(labels.select("doc_id", "toxic")), sample), modulus, held)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
