"""Operator 7: language identification with hyperdimensional profiles.

Every letter has a random vector of DIM signs. A run of three letters is bound into one vector: the letters' vectors, turned by
two, one and no places, are multiplied. A text's vector bundles (adds) those of its runs. Letters count in
lower case, and what lies between letters counts as one blank. A language's prototype bundles the texts of that
language, each at length one. A text gets the language of the prototype with the largest cosine, after the mean of all prototypes, which
holds what languages share, is taken from both. The score is that cosine, mapped from -1..1 to 0..1.

Prototypes are sums of whole numbers over all training texts, so they do not depend on the order of rows. They are brought together in the
cluster, a row for each language, and predictions take them LANGS at a time, so a label column of very many values takes more passes over a
batch of texts and no more memory.

A letter's vector comes from a keyed hash of its code point, so no two letters share one and no table of letters is needed.

Cases: texts without letters, null and empty ones among them, are ``und`` with score 0, and are not learnt from. Rows with null
lang are not learnt from. Without any language learnt every text is ``und``. Ties go to the language that sorts first. A null doc_id hashes as
the empty text, and so is held out. Repeated rows count as often as they come. Texts of any length are read whole, a text of more than BATCH_CHARS letters by itself. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import fold, materialize, table, tuned
from tracewright.llm.substring import _mixed

DIM, SEED = 1024, 20
#: Texts whose vectors are made at once, and characters that they have at most, but for a single longer text.
BATCH, BATCH_CHARS = 64, 1 << 20
#: Unit vectors are added as whole numbers of this fraction.
UNIT = 1 << 20
#: Prototypes that are compared with at once: 8 MB.
LANGS = 1024


@functools.cache
def _alphabet() -> np.ndarray:
    """The lower-case letter of each code point: 0 for what is not a letter."""
    out = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            out[point] = ord(c.lower()[0])
    return out


def _letters(points: np.ndarray) -> np.ndarray:
    """A row of DIM signs for each letter."""
    places = np.arange(DIM // 64, dtype=np.uint64) + np.uint64(SEED * DIM)
    words = _mixed(_mixed(points.astype(np.uint64) + np.uint64(1))[:, None] + places * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(words.astype("<u8").view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def runs_of_letters(text: str) -> np.ndarray:
    """A number for each run of three symbols that has a letter: 21 bits for each symbol."""
    symbols = _alphabet()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    symbols = np.concatenate((np.zeros(1, np.uint32), symbols, np.zeros(1, np.uint32)))
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] > 0) | (symbols[:-1] > 0)
    s = symbols[keep].astype(np.int64)
    return (s[:-2] << 42) | (s[1:-1] << 21) | s[2:]


def _vectors(runs: list[np.ndarray]) -> np.ndarray:
    """The vectors of texts, given their runs."""
    distinct, column = np.unique(np.concatenate(runs), return_inverse=True)
    owner = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    cells, count = np.unique(owner * len(distinct) + column, return_counts=True)
    matrix = np.zeros((len(runs), len(distinct)), np.float32)
    matrix[cells // len(distinct), cells % len(distinct)] = count
    symbols, place = np.unique(np.concatenate([(distinct >> k) & 0x1FFFFF for k in (42, 21, 0)]), return_inverse=True)
    base = _letters(symbols)
    two, one, none = (np.roll(base, k, axis=1) for k in (2, 1, 0))
    first, second, third = place.reshape(3, -1)
    out = np.zeros((len(runs), DIM), np.float32)
    for at in range(0, len(distinct), 8192):
        some = slice(at, at + 8192)
        out += matrix[:, some] @ (two[first[some]] * one[second[some]] * none[third[some]]).astype(np.float32)
    return out


def _bundled(texts: list[str | None]):
    """(places of the texts with letters, their vectors), some at a time."""
    places, runs, chars = [], [], 0
    for i, t in enumerate(texts):
        r = runs_of_letters(t) if t else ()
        if not len(r):
            continue
        if places and (len(places) >= BATCH or chars + len(r) > BATCH_CHARS):
            yield np.array(places), _vectors(runs)
            places, runs, chars = [], [], 0
        places.append(i)
        runs.append(r)
        chars += len(r)
    if places:
        yield np.array(places), _vectors(runs)


def _learn(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for places, vectors in _bundled(batch.column("text").to_pylist()):
            units = np.rint(vectors / np.linalg.norm(vectors, axis=1, keepdims=True) * UNIT).astype(np.int64)
            for i, u in zip(places.tolist(), units, strict=True):
                sums[langs[i]] = sums.get(langs[i], 0) + u
    if sums:
        yield pa.record_batch([pa.array(list(sums)), pa.array([list(v) for v in sums.values()], pa.list_(pa.int64()))], ["lang", "bundle"])


def prototypes(docs: DataFrame) -> DataFrame:
    """(lang, bundle) of ``docs`` (text, lang): a row for each language."""
    tuned(docs.sparkSession)
    sums = docs.where("lang IS NOT NULL").select("text", "lang").mapInArrow(_learn, "lang string, bundle array<long>")
    each = sums.select("lang", F.posexplode("bundle").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    return materialize(each.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda x: x["x"]).alias("bundle")), "prototypes")


def _blocks(found: DataFrame):
    """The languages in order, LANGS at a time, with their prototypes at length one."""
    last = None
    while rows := (found if last is None else found.where(F.col("lang") > last)).orderBy("lang").limit(LANGS).collect():
        x = np.array([r.bundle for r in rows], np.float64)
        yield [r.lang for r in rows], x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        if len(rows) < LANGS:
            return
        last = rows[-1].lang


def _predict(sent):
    def predict(batches):
        langs, rest, mean = sent.value
        for batch in batches:
            best, score = batch.column("lang_pred").to_pylist(), batch.column("score").to_numpy().copy()
            for places, vectors in _bundled(batch.column("text").to_pylist()):
                units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) - mean
                cosines = units @ rest.T / np.maximum(np.linalg.norm(units, axis=1, keepdims=True), 1e-30)
                for i, j, c in zip(places.tolist(), cosines.argmax(axis=1).tolist(), cosines.max(axis=1).tolist(), strict=True):
                    mapped = min(1.0, max(0.0, (c + 1) / 2))
                    if best[i] == "und" or mapped > score[i]:  # of equal ones the language that sorts first is there already
                        best[i], score[i] = langs[j], mapped
            yield batch.set_column(batch.schema.get_field_index("lang_pred"), "lang_pred", pa.array(best, pa.string())).set_column(batch.schema.get_field_index("score"), "score", pa.array(score))

    return predict


def identify(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, held_out), by ``prototypes``."""
    spark = tuned(docs.sparkSession)
    total, n = np.zeros(DIM), 0
    for langs, x in _blocks(found):
        total, n = total + x.sum(axis=0), n + len(langs)
    mean = total / n if n > 1 else np.zeros(DIM)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    for langs, x in _blocks(found):
        rest = x - mean
        rest = (rest / np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-300)).astype(np.float32)
        out = out.mapInArrow(_predict(spark.sparkContext.broadcast((langs, rest, mean.astype(np.float32)))), "doc_id long, held_out boolean, text string, lang_pred string, score double")
    return out.select("doc_id", "held_out", "lang_pred", "score")


def language_ids(docs: DataFrame, modulus: int = 5) -> DataFrame:
    rows = docs.select("doc_id", "text", "lang", (fold("doc_id", modulus) == 0).alias("held_out"))
    return identify(rows, prototypes(rows.where("NOT held_out")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ids(table(spark, sf_dir, "documents"))
