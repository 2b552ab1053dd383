"""Operator 4: token ids in sorted-string-table shards.

Documents are encoded with a ``tokenizers`` vocabulary, an end id is appended, and each lands under its identifier in a shard:

    magic | block ... | block index | Bloom filter | footer

A block holds entries sorted by key. An entry stores how many bytes its key shares with the one before, the rest of the key and the
ids; every RESTART entries a key is stored whole and its place is noted, so a block can be searched by halves. Blocks
are compressed with zstd. The sparse index has the last key and the place of each block. The Bloom filter tells most absent keys
without a read. The footer has the places of both, the counts and the width of an id. A key is the identifier as 8
big-endian bytes with the sign bit flipped, so that byte order is numeric order; a null identifier is the empty key and comes first.

Shards follow each other in key order: rows are dealt by ranges of the identifier and sorted within. A task writes under a
name of its attempt and renames at the end, so a lost executor leaves no half shard under a final name.

Cases: null texts encode as empty, and any document has the end id at least. Rows that share a doc_id are all kept, in the order of
their texts' hashes. An empty table writes no shard and reads back no row. Other columns are not stored.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import LOWER, shared_path, table, tuned

MAGIC = b"TWSST\x00\x01\n"
FOOTER = struct.Struct("<QIQIIIQQ8s")  # index at, bytes; Bloom filter at, bytes; probes; id width; documents; ids; magic
BLOCK_BYTES, RESTART = 1 << 16, 16
#: A shard is closed once it has so many bytes.
SHARD_BYTES = 128 << 20
BLOOM_BITS, BLOOM_PROBES = 10, 7
#: Words of a generation whose ids a worker remembers; there are two.
CACHE_WORDS = 400_000
MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long, first binary, last binary"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, probes: int) -> list[int]:
    import xxhash

    h = xxhash.xxh64_intdigest(key)
    step = (h >> 32) | 1
    return [(h + i * step) % bits for i in range(probes)]


class ShardWriter:
    """Writes one shard; keys have to come in ascending order."""

    def __init__(self, files: pafs.FileSystem, path: str, attempt: str, width: int):
        self.files, self.path, self.width = files, path, width
        self.draft = f"{path}.{attempt}.draft"
        self.out = files.open_output_stream(self.draft)
        self.out.write(MAGIC)
        self.at, self.n_docs, self.n_tokens = len(MAGIC), 0, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self._reset()

    def _reset(self) -> None:
        self.block, self.restarts, self.count, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.count = key, self.count + 1
        self.keys.append(key)
        self.n_docs += 1
        self.n_tokens += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _write(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at, len(data)

    def _flush(self) -> None:
        if self.count:
            raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
            self.index.append((self.last, *self._write(struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True))))
        self._reset()

    def close(self) -> None:
        self._flush()
        index = self._write(b"".join(_varint(len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index))
        distinct = set(self.keys)
        bloom = bytearray(max(8, len(distinct) * BLOOM_BITS // 8 + 1))
        for key in distinct:
            for bit in _probes(key, len(bloom) * 8, BLOOM_PROBES):
                bloom[bit >> 3] |= 1 << (bit & 7)
        filtered = self._write(bytes(bloom))
        self._write(FOOTER.pack(*index, *filtered, BLOOM_PROBES, self.width, self.n_docs, self.n_tokens, MAGIC))
        self.out.close()
        self.files.move(self.draft, self.path)


class Shard:
    """Reads one shard: ``scan`` goes through all of it, ``get`` reads one block."""

    def __init__(self, uri: str):
        files, path = pafs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        index_at, index_n, bloom_at, bloom_n, self.probes, self.width, self.n_docs, self.n_tokens, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a shard, or is cut short")
        self.bloom = self.file.read_at(bloom_n, bloom_at)
        self.keys, self.places = [], []
        data, at = self.file.read_at(index_n, index_at), 0
        while at < len(data):
            n, at = _read_varint(data, at)
            self.keys.append(data[at : at + n])
            self.places.append(struct.unpack_from("<QI", data, at + n))
            at += n + 12

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        at, n = self.places[i]
        data = self.file.read_at(n, at)
        raw = pa.decompress(data[8:], decompressed_size=struct.unpack_from("<Q", data)[0], codec="zstd", asbytes=True)
        count = struct.unpack_from("<I", raw, len(raw) - 4)[0]
        end = len(raw) - 4 - 4 * count
        return raw[:end], list(struct.unpack_from(f"<{count}I", raw, end))

    @staticmethod
    def _entries(data: bytes, at: int = 0):
        key = b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            yield key, data[at + rest : at + rest + n]
            at += rest + n

    def scan(self):
        """(key, ids as bytes) in key order."""
        for i in range(len(self.places)):
            yield from self._entries(self._block(i)[0])

    def get(self, key: bytes) -> list[bytes]:
        """The ids stored under ``key``: none, or one for each row that had it."""
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _probes(key, len(self.bloom) * 8, self.probes)):
            return []
        found = []
        for i in range(bisect.bisect_left(self.keys, key), len(self.keys)):
            data, restarts = self._block(i)
            first = bisect.bisect_left(restarts, key, key=lambda at: next(self._entries(data, at))[0])
            for k, value in self._entries(data, restarts[max(0, first - 1)]):
                if k > key:
                    return found
                if k == key:
                    found.append(value)
        return found


class _Words(dict):
    """Ids of words, worked out when first asked for. Of ``old``, the generation before, those stay that come again."""

    def __init__(self, work_out):
        super().__init__({b"": b""})
        self.work_out, self.old = work_out, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        self[word] = ids = self.work_out(word) if ids is None else ids
        return ids


class Encoder:
    """Encodes texts word by word, remembering the ids of words.

    This vocabulary lower-cases, drops white space, and splits letters from punctuation, so no token spans white space, and a word of letters
    with ASCII punctuation around it is encoded part by part. All other words are encoded as they stand.
    """

    #: Punctuation but the apostrophe, which may belong to the letters after it.
    PARTS = re.compile(rb"([!-&(-/:-@\[-`{-~]*)([a-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, vocabulary: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model, self.normalizer, self.splitter = self.tokenizer.model, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.form = "H" if self.width == 2 else "I"
        self.pack = struct.Struct("<" + self.form).pack
        self.end = self.pack(end_id)
        self.known = _Words(self._word)

    def _word(self, word: bytes) -> bytes:
        pack = self.pack
        if word.isalpha() and word.islower():  # a-z is what normalizer and splitter leave as it is
            return b"".join([pack(t.id) for t in self.model.tokenize(word.decode())])
        m = self.PARTS.fullmatch(word)
        if m and b"<|" not in word and (m[2].isalpha() or m[2].decode("utf-8", "replace").isalpha()):
            if len(m[2]) < len(word):
                known = self.known
                return known[m[1]] + known[m[2]] + known[m[3]]
            pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(word.decode()))
            return b"".join([pack(t.id) for piece, _ in pieces for t in self.model.tokenize(piece)])
        ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}{self.form}", *ids)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text and the end id, as little-endian integers of ``width`` bytes."""
        out = []
        for t in texts:
            # A text with what may be a special token keeps its case, as special tokens are looked for before lower-casing.
            words = (t if b"<|" in t else t.translate(LOWER)).split() if t else []
            out.append(b"".join(map(self.known.__getitem__, words)) + self.end)
            if len(self.known) > CACHE_WORDS:
                self.known.old = {}
                old, self.known = self.known, _Words(self._word)
                self.known.old = old
        return out


_encoders: dict[tuple[int, int], Encoder] = {}


def _encoder(vocabulary: str, end_id: int) -> Encoder:
    """A Python worker keeps one encoder, and the words that it knows, from task to task."""
    key = zlib.crc32(vocabulary.encode()), end_id
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary, end_id)
    return _encoders[key]


def _writer(directory: str, vocabulary, end_id: int):
    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), str(context.taskAttemptId())
        encoder = _encoder(vocabulary.value, end_id)
        files, base = pafs.FileSystem.from_uri(directory)
        shard, seq = None, 0

        def closed():
            shard.close()
            uri = f"{directory}/{os.path.basename(shard.path)}"
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([uri]), pa.array([shard.n_docs]), pa.array([shard.n_tokens]), pa.array([shard.keys[0]], pa.binary()), pa.array([shard.keys[-1]], pa.binary())], ["part", "seq", "path", "n_docs", "n_tokens", "first", "last"])

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                if shard is None:
                    shard = ShardWriter(files, f"{base}/part-{part:06d}-{seq:04d}.sst", attempt, encoder.width)
                shard.add(key_of(doc_id), ids)
                if shard.at >= SHARD_BYTES:
                    yield closed()
                    shard, seq = None, seq + 1
        if shard is not None:
            yield closed()

    return write


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, directory: str | None = None, range_by: list | None = None) -> list[tuple[str, int, int, bytes, bytes]]:
    """Writes ``docs`` (doc_id, text) and returns (path, documents, ids, first key, last key) of each shard, in order.

    By default shards follow each other in ascending doc_id. ``range_by`` has other columns by which rows are dealt out to
    shards, for instance a training order; within a shard rows are sorted by doc_id all the same. The list has one row per shard.
    """
    spark = tuned(docs.sparkSession)
    directory = directory or shared_path(spark, "tokens")
    pafs.FileSystem.from_uri(directory)[0].create_dir(pafs.FileSystem.from_uri(directory)[1], recursive=True)
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("h"), *(range_by or []))
    rows = rows.repartitionByRange(*([c for c in rows.columns if c not in ("doc_id", "text", "h")] if range_by else ["doc_id", "h"])).sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    made = rows.mapInArrow(_writer(directory, vocabulary, end_id), MANIFEST).collect()
    return [(r.path, r.n_docs, r.n_tokens, bytes(r.first), bytes(r.last)) for r in sorted(made, key=lambda r: (r.part, r.seq))]


def _read(batches):
    import numpy as np

    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            shard, rows = Shard(path), []
            for key, value in shard.scan():
                ids = value if shard.width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()
                rows.append((id_of(key), start, len(ids) // 4, zlib.crc32(ids)))
                start += len(ids) // 4
                if len(rows) == 4096:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, shards: list[tuple]) -> DataFrame:
    """One row for each stored document: doc_id, start, n_tokens, ids_crc32, read from the files."""
    rows, start = [], 0
    for path, _, n, *_ in shards:
        rows.append((path, start))
        start += n
    places = spark.createDataFrame(rows, "path string, start long")
    return (places.repartition(min(len(rows), 4096)) if len(rows) > 1 else places).mapInArrow(_read, RESULT)


def lookup(shards: list[tuple], doc_id: int | None) -> list[list[int]]:
    """The ids of each document stored under ``doc_id``; opens the shards whose keys span it, and reads the blocks that may hold it.

    Shards in ascending order of keys, which is what ``write_shards`` gives by default, are searched by halves.
    """
    import numpy as np

    key, found = key_of(doc_id), []
    ordered = all(a[4] <= b[3] for a, b in zip(shards, shards[1:], strict=False))
    for path, _, _, first, last in shards[bisect.bisect_left(shards, key, key=lambda s: s[4]) if ordered else 0 :]:
        if ordered and first > key:
            break
        if first <= key <= last:
            shard = Shard(path)
            found += [np.frombuffer(v, f"<u{shard.width}").tolist() for v in shard.get(key)]
    return found


def op4_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shards = write_shards(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")), 2)
    return read_shards(spark, shards)
