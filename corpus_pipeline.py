"""A corpus pipeline: the documents table, stage by stage, to token shards.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and returns what goes on: all but the last return the columns of
documents. ``run`` writes each stage's rows as Parquet into the shared folder and reads them again as the next one's ``docs``.

1. toxicity: documents that the toxicity model, learnt from the training part of ``labels``, rejects are dropped.
2. near_dedup: of each group of near-duplicates by SimHash the document of the smallest doc_id stays.
3. decontaminate: documents that contain a passage of ``benchmark`` are dropped.
4. mix: sources are mixed to their target weights. All documents stay; the rows' order is the mix.
5. tokenize: texts go to token shards. Shards follow the mix, each holding a stretch of it, keyed and sorted by doc_id within; the rows
   tell where each document lies. The mix is read from the order of the stored rows.

Cases, which hold for every stage: null and empty texts are documents like others (no stage but near_dedup, for which they are copies of each
other, drops them). Texts of any length are judged whole. Of rows with the same doc_id and text one stays; rows that share a doc_id, or have none,
and differ in text are judged each by its own text. Ties go to the smaller doc_id, then to the smaller hash, so all runs agree. An empty table goes
through as an empty table. Further columns, whatever their names, are carried along up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, mixing, simhash, sstable, toxicity
from tracewright.llm.common import materialize, table

#: SQL cannot express the toxicity model, so that ``run`` is tested against brute-force versions of its stages instead.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    train_rows = lambda df: df.where(toxicity.fold("doc_id", 4) != 2)
    fitted = toxicity.fit(train_rows(docs.select("doc_id", "text")), train_rows(table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return toxicity.accepted(docs, fitted)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    try:  # the stage before has stored its rows in the order of the mix
        part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
        placed = docs.select("doc_id", "text", F.coalesce(part, F.lit(-1)).alias("part"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # rows that are not stored are put in order here
        placed = mixing.slotted(docs)
    shards = sstable.write_shards(placed, str(public_tokenizers.path("word_bpe_49k.json")), 2, range_by=placed.columns[2:])
    return sstable.read_shards(spark, shards)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("decontaminate", drop_contaminated),
    ("mix", mix),
    ("tokenize", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return materialize(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
