import struct
import zlib

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import test_decontaminate, test_simhash
from tracewright.llm import mixing, toxicity
from tracewright.llm.common import materialize, table


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = materialize(stage(spark, docs, sf_dir), name)
        out.append((docs, made))
        docs = made
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mix", "tokenize"]


def test_all_but_the_last_return_the_columns_of_documents(steps, spark, sf_dir):
    columns = table(spark, sf_dir, "documents").schema
    for _, made in steps[:-1]:
        assert [(f.name, f.dataType) for f in made.schema] == [(f.name, f.dataType) for f in columns]


def test_toxicity_drops_what_the_operator_rejects(steps, spark, sf_dir):
    docs, made = steps[0]
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    assert sorted(ids(made)) == sorted(ids(scored.where("predicted = 0")))
    assert 0 < made.count() < docs.count()


def test_near_dedup_keeps_one_of_each_component(steps):
    docs, made = steps[1]
    prints = {r.doc_id: test_simhash.fingerprint(r.text) for r in docs.collect()}
    parts = test_simhash.components(prints)
    assert sorted(ids(made)) == sorted(d for d, c in parts.items() if d == c)
    assert made.count() < docs.count()


def test_decontamination_drops_leaks_only(steps, spark, sf_dir):
    docs, made = steps[2]
    found = test_decontaminate.brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()])
    assert sorted(ids(made)) == sorted(set(ids(docs)) - {d for d, _ in found})


def test_mix_keeps_all_rows(steps):
    docs, made = steps[3]
    assert sorted(map(str, made.collect())) == sorted(map(str, docs.collect()))


def test_tokens_follow_the_mix(steps, spark):
    docs, made = steps[4]
    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    got = sorted(made.collect(), key=lambda r: r.start)
    start = 0
    for r in got:
        x = want[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x)))
        start += len(x)
    assert sorted(r.doc_id for r in got) == sorted(want)


def test_run_gives_the_last_stage(steps, spark, sf_dir):
    rows = lambda df: sorted(map(str, df.select("doc_id", "n_tokens", "ids_crc32").collect()))
    assert rows(corpus_pipeline.run(spark, sf_dir)) == rows(steps[-1][1])


def test_odd_rows_go_through(spark, sf_dir):
    """Nulls, empty texts, repeated rows and clashing columns: every stage has a defined result."""
    docs = table(spark, sf_dir, "documents").limit(30)
    kinds = {f.name: f.dataType for f in docs.schema}
    odd = spark.createDataFrame([(900_001, None, None, None, None), (900_002, "", "en", "src0", 0), (None, "some words without any id at all", None, None, 3), (900_003, "short", "en", "a", 5), (900_003, "short", "en", "a", 5)], docs.schema)
    both = docs.unionByName(odd).withColumn("name", F.lit("x")).withColumn("print", F.lit(1)).withColumn("block", F.lit(2))
    assert kinds["doc_id"].simpleString() == "bigint"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        both = materialize(stage(spark, both, sf_dir), name)
        assert both.columns[-3:] == ["name", "print", "block"]
        assert both.where("doc_id IS NULL").count() == 1
    kept = ids(both.where("doc_id > 900000"))
    assert len([d for d in kept if d == 900_003]) == 1 and len([d for d in kept if d in (900_001, 900_002)]) == 1
    last = corpus_pipeline.STAGES[-1][1](spark, both, sf_dir)
    assert last.count() == both.count()
    assert mixing.mixed(both.limit(0)).count() == 0
