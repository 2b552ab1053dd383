import random
import struct
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from tracewright.llm import sstable

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, start string, h int"


def expected(rows):
    t = Tokenizer.from_file(PATH)
    ids = {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows}
    out, start = {}, 0
    for d in sorted(ids, key=lambda d: (d is not None, d)):
        out[d] = (start, len(ids[d]), zlib.crc32(struct.pack(f"<{len(ids[d])}I", *ids[d])))
        start += len(ids[d])
    return ids, out


def rows_of(frame):
    return {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in frame.collect()}


def test_round_trip_and_lookup(spark, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 300)
    rng = random.Random(3)
    words = ["the", "HELLO", "Élan", "don't", "x1y2", "ß-Wort,", "日本", "<|endoftext|>", "éa", "ΟΔΟΣ", "!!", "a b"]
    rows = [(d, rng.choice([" ", "\n", "\t "]).join(rng.choice(words) for _ in range(rng.randint(0, 60))), "s", 1) for d in rng.sample(range(-500, 100_000), 300)]
    rows += [(1 << 62, None, None, None), (-(1 << 63), "", "", 0), (None, "no id", "", 0), (77_000_000, "word " * 60_000, "", 0)]
    shards = sstable.write_shards(spark.createDataFrame(rows, SCHEMA).repartition(5), PATH, 2)
    ids, want = expected(rows)
    assert rows_of(sstable.read_shards(spark, shards)) == want
    for d in rng.sample(sorted(x for x in ids if x is not None), 25) + [None]:
        assert sstable.lookup(shards, d) == [ids[d]]
    assert sstable.lookup(shards, 123_456_789) == []


def test_lookup_opens_the_shards_that_span_a_key(spark, monkeypatch):
    parts = [[(d, f"word {d}", "s", 1) for d in range(k * 100, k * 100 + 100, 2)] + [(k * 100, "again", "s", 1)] * 3 for k in range(5)]
    shards = [x for rows in parts for x in sstable.write_shards(spark.createDataFrame(rows, SCHEMA).coalesce(1), PATH, 2)]
    assert len(shards) >= 5
    opened, real = [], sstable.Shard
    monkeypatch.setattr(sstable, "Shard", lambda uri: opened.append(uri) or real(uri))
    assert len(sstable.lookup(shards, 100)) == 4 and len(sstable.lookup(shards, 498)) == 1
    assert len(opened) == len(set(opened)) <= 4
    opened.clear()
    assert sstable.lookup(shards, 10_000) == [] and not opened
    assert len(sstable.lookup(shards[::-1], 100)) == 4 and len(sstable.lookup(shards[::-1], 0)) == 4


def test_driver_table_against_whole_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _, want = expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert rows_of(sstable.op4_token_sstable(spark, sf_dir)) == want


def test_repeated_rows_and_empty_table(spark):
    frame = spark.createDataFrame([(5, "a b", "", 1)] * 40 + [(6, "c", "", 1)], SCHEMA)
    shards = sstable.write_shards(frame, PATH, 2)
    got = sstable.read_shards(spark, shards).collect()
    assert len(got) == 41 and len(sstable.lookup(shards, 5)) == 40
    assert sorted(r.start for r in got) == [3 * i for i in range(41)]
    assert sstable.read_shards(spark, sstable.write_shards(frame.limit(0), PATH, 2)).count() == 0


def test_cut_file_is_refused(tmp_path):
    (tmp_path / "x.sst").write_bytes(b"0" * 200)
    try:
        sstable.Shard(f"file://{tmp_path}/x.sst")
        raise AssertionError
    except ValueError:
        pass
