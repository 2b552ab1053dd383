"""Operator 6: language-model scores by context-tree weighting over bytes.

A text's words, A-Z in lower case, are spelled as bytes with one space between words and an end byte. Each byte is coded as 8 binary
decisions. Every decision has a context tree: its nodes are the preceding bytes, the nearest first, to a depth of DEPTH. A node
has a Krichevsky-Trofimov estimate of the decision from the training texts. Estimates of all depths are mixed: a node weighs its own
estimate against the product of its children's by how well each has coded the training texts, half and half beforehand. All depths
from 0 to DEPTH are mixed. A node without training counts takes the estimate of its parent, and a root without counts is undecided (1/2).

How it runs: texts are dealt by a hash of the row to chunks of about CHUNK_BYTES. A chunk sends its distinct (context, byte) grams and words
with their training counts, packed in arrays, to buckets that are hashes of the two nearest bytes, or of the word. A bucket adds up what
all chunks sent and weighs the subtrees below its pairs of bytes. What these subtrees amount to is added up by nearest byte and decision, 65,536
rows at most, from which the driver works out the nodes of depths 1 and 0. A bucket then answers each chunk with the log-probability
of its grams and the counts of its words, and a chunk adds up its texts. All counts are over all training texts; what travels is distinct
grams of chunks, never a row for each byte.

Words are told apart by 64-bit hashes. The base score is that of the unigram model with additive smoothing 0.1.

Cases: null and empty texts have the end token only. Repeated rows are scored alike and count as often as they come. Without
training texts every decision is 1/2. A null doc_id hashes as the empty text, so it is held out. An empty table gives an empty result. Other
columns are ignored. A text of any length is scored whole, in one chunk, and makes that chunk longer.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import LOWER, fold, materialize, table, tuned

DEPTH, ROOT = 5, 2
CHUNK_BYTES = 8 << 20
END = 0xFF
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
MESSAGE = "kind string, bucket int, chunk long, keys binary, counts binary"
TOPS = "place long, ones double, n double, rest double"
ANSWER = "kind string, bucket int, chunk long, payload binary, train_tokens long, distinct_tokens long"


def spelled(text: bytes | None) -> tuple[list[bytes], bytes]:
    """The words of a text, and its spelling with the end byte."""
    words = (text or b"").translate(LOWER).split()
    return words, b" ".join(words) + bytes([END])


def grams(texts: list[bytes], depth: int) -> np.ndarray:
    """For each byte of the texts, in order, the number whose bytes are its context, the nearest byte first, and itself last."""
    pad = b"\x00" * depth
    data = np.frombuffer(pad + pad.join(texts), np.uint8)
    out = data[depth:].astype(np.uint64)
    for j in range(1, depth + 1):
        out |= data[depth - j : len(data) - j].astype(np.uint64) << np.uint64(8 * (depth + 1 - j))
    lengths = np.array([len(t) for t in texts])
    keep = np.ones(len(out), bool)
    ends = np.cumsum(lengths + depth)[:-1] - depth
    for j in range(depth):
        keep[ends + j] = False
    return out[keep]


def _bucket_of_grams(keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    root = keys >> np.uint64(8 * (depth + 1 - ROOT))
    return ((root * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2)."""
    return _log_gamma(n + 0.5)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 1/2, by Stirling's series at x + 8."""
    z = x + 8.0
    series = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    product = np.ones_like(x)
    for i in range(8):
        product *= x + i
    return series - np.log(product)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of sorted ``keys``, and the place of each key's value among them."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    return keys[new], np.cumsum(new) - 1


class Trees:
    """The context trees over sorted distinct grams with training counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.depth = depth
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.roots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        seen = counts > 0
        keys, counts = keys[seen], counts[seen].astype(np.float64)
        weighted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in range(depth, ROOT - 1, -1):
            # Contexts of d bytes and the byte after them: sorted, because the nearest byte leads.
            level = (keys >> np.uint64(8 * (depth + 1 - d)) << np.uint64(8)) | (keys & np.uint64(255))
            order = np.argsort(level, kind="stable")
            leaves, place = _runs(level[order])
            total = np.bincount(place, weights=counts[order], minlength=len(leaves))
            for bit in range(7, -1, -1):
                parents, place = _runs(leaves >> np.uint64(1))
                ones = np.bincount(place, weights=total * (leaves & np.uint64(1)), minlength=len(parents))
                both = np.bincount(place, weights=total, minlength=len(parents))
                own = _log_gamma_half(ones) + _log_gamma_half(both - ones) - _log_gamma(both + 1) - math.log(math.pi)
                share = np.ones(len(parents))
                if d < depth:
                    below, value = weighted[bit]
                    above = (below >> np.uint64(8 + bit) << np.uint64(bit)) | (below & np.uint64((1 << bit) - 1))
                    rest = np.bincount(np.searchsorted(parents, above), weights=value, minlength=len(parents))
                    share = 1 / (1 + np.exp(np.clip(rest - own, -700, 700)))
                    own = math.log(0.5) + np.logaddexp(own, rest)
                self.nodes[d, bit] = parents, (ones + 0.5) / (both + 1), share
                if d == ROOT:
                    self.roots[bit] = parents, ones, both, own
                weighted[bit] = parents, own
                leaves, total = parents, both

    def tops(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the subtrees below pairs of bytes amount to, by nearest byte and decision: (256 * byte + decision, ones, all, weighted log)."""
        out = []
        for bit, (nodes, ones, both, own) in self.roots.items():
            place = (nodes >> np.uint64(8 + bit) << np.uint64(8)) | np.uint64(1 << bit) | (nodes & np.uint64((1 << bit) - 1))
            found, at = np.unique(place, return_inverse=True)
            out.append((found.astype(np.int64), *(np.bincount(at, weights=x, minlength=len(found)) for x in (ones, both, own))))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def log10(self, keys: np.ndarray, top: np.ndarray | None = None) -> np.ndarray:
        """log10 of the probability of each gram's byte in its context; ``top`` has the nodes above, as ``upper_nodes`` gives them."""
        out = np.zeros(len(keys))
        for bit in range(8):
            mixed, known = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
            for d in range(self.depth, ROOT - 1, -1):
                nodes, one, share = self.nodes[d, bit]
                if not len(nodes):
                    continue
                wanted = (keys >> np.uint64(8 * (self.depth + 1 - d)) << np.uint64(bit)) | ((keys & np.uint64(255)) >> np.uint64(8 - bit))
                at = np.minimum(np.searchsorted(nodes, wanted), len(nodes) - 1)
                here = nodes[at] == wanted
                mixed = np.where(here, np.where(known, share[at] * one[at] + (1 - share[at]) * mixed, one[at]), mixed)
                known |= here
            if top is not None:
                decision = ((np.uint64(1) << np.uint64(bit)) | ((keys & np.uint64(255)) >> np.uint64(8 - bit))).astype(np.int64)
                nearest = (keys >> np.uint64(8 * self.depth)).astype(np.int64)
                for at in (256 * nearest + decision, (1 << 16) + decision):
                    one, share, here = top[0][at], top[1][at], top[2][at] > 0
                    mixed = np.where(here, np.where(known, share * one + (1 - share) * mixed, one), mixed)
                    known |= here
            out += np.log10(np.where((keys >> np.uint64(7 - bit)) & np.uint64(1), mixed, 1 - mixed))
        return out


def upper_nodes(places: np.ndarray, ones: np.ndarray, both: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """(estimates, weights of the own estimate, whether there are counts) of the nodes of depth 1, then of depth 0, from summed ``Trees.tops``."""
    out = np.zeros((3, (1 << 16) + 256))
    below = np.zeros((3, 256, 256))
    below[:, places // 256, places % 256] = ones, both, rest

    def weigh(n1: np.ndarray, n: np.ndarray, rest: np.ndarray):
        own = _log_gamma_half(n1) + _log_gamma_half(n - n1) - _log_gamma(n + 1) - math.log(math.pi)
        mixed = np.where(n > 0, math.log(0.5) + np.logaddexp(own, rest), 0)
        return (n1 + 0.5) / (n + 1), 1 / (1 + np.exp(np.clip(rest - own, -700, 700))), n > 0, mixed

    *first, mixed = weigh(*below)
    out[:, : 1 << 16] = [x.reshape(-1) for x in first]
    *root, _ = weigh(below[0].sum(axis=0), below[1].sum(axis=0), mixed.sum(axis=0))
    out[:, 1 << 16 :] = root
    return out


def _in_buckets(keys: np.ndarray, where: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``keys`` by bucket and then by number, and where each bucket starts in it."""
    order = np.lexsort((keys, where))
    return order, np.searchsorted(where[order], np.arange(buckets + 1, dtype=np.uint64))


def _words_of(names: list[bytes], buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words by bucket: the words, their hashes, their order before, and where each bucket starts."""
    import xxhash

    hashes = np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64)
    order, bounds = _in_buckets(hashes, hashes % np.uint64(buckets), buckets)
    return [names[i] for i in order.tolist()], hashes[order], order, bounds


def _counted_words(words: list[list[bytes]], held: list[bool]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of a chunk, the end token among them, and their training counts."""
    count: Counter = Counter()
    for w, out in zip(words, held, strict=True):
        if not out:
            count.update(w)
    count[b""] = sum(not x for x in held)  # the end token
    names = [*count, *(set().union(*(w for w, out in zip(words, held, strict=True) if out)) - count.keys())]
    return names, np.array([count[x] for x in names], np.uint64)


def _counted_grams(found: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a chunk, and their training counts."""
    keys, counts = np.unique(found[trained], return_counts=True)
    if not trained.all():
        more = np.setdiff1d(found[~trained], keys)
        keys, counts = np.concatenate((keys, more)), np.concatenate((counts, np.zeros(len(more), np.int64)))
    return keys, counts.astype(np.uint64)


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _pack_keys(x: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte of their columns, which compresses well."""
    if not len(x):
        return b""
    gaps = np.diff(x, prepend=np.zeros(1, np.uint64))
    return pa.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, kind: type, n: int) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    return np.frombuffer(pa.decompress(data, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _unpack_keys(data: bytes, n: int) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    raw = _unpack(data, np.uint8, 8 * n).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).reshape(-1).view(np.uint64), dtype=np.uint64)


def _framed(n: int, data: bytes) -> bytes:
    return n.to_bytes(4, "little") + data


def _opened(data: bytes) -> tuple[int, bytes]:
    return int.from_bytes(data[:4], "little"), data[4:]


def _read(docs: pa.Table):
    words, texts = [], []
    for t in docs.column("text").to_pylist():
        w, s = spelled(t)
        words.append(w)
        texts.append(s)
    return words, texts, docs.column("held_out").to_pylist()


def _tell(depth: int, buckets: int):
    def tell(docs: pa.Table) -> pa.Table:
        words, texts, held = _read(docs)
        chunk = docs.column("chunk")[0].as_py()
        names, counts = _counted_words(words, held)
        _, hashes, order, bounds = _words_of(names, buckets)
        counts = counts[order]
        keys, occurred = _counted_grams(grams(texts, depth), ~np.repeat(held, [len(t) for t in texts]))
        order, cuts = _in_buckets(keys, _bucket_of_grams(keys, depth, buckets), buckets)
        keys, occurred = keys[order], occurred[order]
        rows = []
        for b in range(buckets):
            lo, hi = bounds[b : b + 2].tolist()
            rows.append(("w", b, chunk, _framed(hi - lo, _pack_keys(hashes[lo:hi])), _pack(counts[lo:hi])))
            lo, hi = cuts[b : b + 2].tolist()
            if hi > lo:
                rows.append(("g", b, chunk, _framed(hi - lo, _pack_keys(keys[lo:hi])), _pack(occurred[lo:hi])))
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "bucket", "chunk", "keys", "counts"])

    return tell


def _added(told: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What each chunk asks, then all keys in order, and of the distinct ones the place of each key, and the summed counts."""
    framed = [_opened(x) for x in told.column("keys").to_pylist()]
    each = [_unpack_keys(data, n) for n, data in framed]
    counts = [_unpack(x, np.uint64, n) for (n, _), x in zip(framed, told.column("counts").to_pylist(), strict=True)]
    keys = np.concatenate(each)
    order = np.argsort(keys, kind="stable")
    distinct, place = _runs(keys[order])
    total = np.bincount(place, weights=np.concatenate(counts)[order].astype(np.float64), minlength=len(distinct))
    return each, order, distinct, place, total


def _sum_up(depth: int):
    def sum_up(told: pa.Table) -> pa.Table:
        _, _, distinct, _, total = _added(told)
        place, *sums = Trees(distinct, total, depth).tops()
        return pa.table([pa.array(place, pa.int64()), *(pa.array(np.asarray(x, np.float64)) for x in sums)], [c.split()[0] for c in TOPS.split(", ")])

    return sum_up


def _answer(depth: int, top: np.ndarray):
    def answer(told: pa.Table) -> pa.Table:
        kind, bucket = told.column("kind")[0].as_py(), told.column("bucket")[0].as_py()
        chunks = told.column("chunk").to_pylist()
        each, order, distinct, place, total = _added(told)
        values = total if kind == "w" else Trees(distinct, total, depth).log10(distinct, top)
        of_key = np.empty(len(order))
        of_key[order] = values[place]
        payloads, at = [], 0
        for k in each:
            payloads.append(_framed(len(k), _pack(of_key[at : at + len(k)])))
            at += len(k)
        n, v = (int(total.sum()), int((total > 0).sum())) if kind == "w" else (0, 0)
        m = len(chunks)
        return pa.table([pa.array([kind] * m), pa.array([bucket] * m, pa.int32()), pa.array(chunks, pa.int64()), pa.array(payloads, pa.binary()), pa.array([n] * m, pa.int64()), pa.array([v] * m, pa.int64())], ["kind", "bucket", "chunk", "payload", "train_tokens", "distinct_tokens"])

    return answer


def _lookup(keys: np.ndarray, values: np.ndarray):
    """A function from grams, all of which are among ``keys``, to their values: one read of a hash table of places for nearly all."""
    bits = max(16, int(len(keys)).bit_length() + 4)
    slot = lambda k: ((k * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)
    slots = slot(keys)
    cells = np.full(1 << bits, -1, np.int32)
    cells[slots] = np.arange(len(keys), dtype=np.int32)
    taken, n = np.unique(slots, return_counts=True)
    cells[taken[n > 1]] = -1
    order = np.argsort(keys)
    ordered = keys[order]

    def find(k: np.ndarray) -> np.ndarray:
        at = cells[slot(k)]
        miss = np.flatnonzero(at < 0)
        at[miss] = order[np.searchsorted(ordered, k[miss])]
        return values[at]

    return find


def _score(depth: int, buckets: int):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], [c.split()[0] for c in RESULT.split(", ")])
        words, texts, held = _read(docs)
        parts = {(k, b): _opened(p) for k, b, p in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "payload")), strict=True)}
        join = lambda kind, dtype: np.concatenate([_unpack(data, dtype, n) for (k, _), (n, data) in sorted(parts.items()) if k == kind] or [np.zeros(0, dtype)])
        total, distinct = (sum(answers.column(c).to_pylist()) for c in ("train_tokens", "distinct_tokens"))
        names = _words_of(list({b""}.union(*words)), buckets)[0]
        known = join("w", np.float64)
        cost = dict(zip(names, np.log10(known + 0.1).tolist(), strict=True))
        end_known = bool(known[names.index(b"")] > 0)
        found = grams(texts, depth)
        keys = np.unique(found)
        keys = keys[_in_buckets(keys, _bucket_of_grams(keys, depth, buckets), buckets)[0]]
        values = _lookup(keys, join("g", np.float64))(found)
        sums = np.add.reduceat(values, np.concatenate(([0], np.cumsum([len(t) for t in texts])[:-1])))
        scale = math.log10(total + 0.1 * (distinct + 1))
        rows = []
        for w, own, out in zip(words, sums.tolist(), held, strict=True):
            n = len(w) + 1
            c = np.fromiter(map(cost.__getitem__, w), np.float64, len(w))
            rows.append((out, n, int((c > -0.5).sum()) + end_known, total, float(c.sum()) + cost[b""] - n * scale, own))
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([docs.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [c.split()[0] for c in RESULT.split(", ")])

    return score


def ctw_scores(docs: DataFrame, depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES, modulus: int = 10) -> DataFrame:
    """Scores every row of ``docs`` with the model of the rows whose fold is not 0."""
    tuned(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    buckets = max(8, round(8 * math.sqrt(chunks)))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
        (fold("doc_id", modulus) == 0).alias("held_out"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"),
    )
    told = materialize(rows.groupBy("chunk").applyInArrow(_tell(depth, buckets), MESSAGE), "told")
    tops = told.where("kind = 'g'").groupBy("bucket").applyInArrow(_sum_up(depth), TOPS)
    summed = tops.groupBy("place").agg(F.sum("ones"), F.sum("n"), F.sum("rest")).collect()  # a row for each byte and decision: 65,536 at most
    places, *sums = (np.array(x) for x in zip(*summed, strict=True)) if summed else (np.zeros(0, np.int64), *[np.zeros(0)] * 3)
    top = upper_nodes(places.astype(np.int64), *sums)
    answers = told.groupBy("kind", "bucket").applyInArrow(_answer(depth, top), ANSWER)
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(depth, buckets), RESULT)


def op6_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw_scores(table(spark, sf_dir, "documents"))
