"""Helpers that the corpus operators share: table access, shared storage, folds and byte-level words."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps A-Z to a-z and leaves every other byte of UTF-8 alone.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: Rows that go to a Python worker at once; texts can be long, so batches are kept short.
ARROW_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """Short Arrow batches, unless the session has its own setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(ARROW_ROWS))
    return spark


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Settings for what runs inside; the session has its own back afterwards."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hadoop_path(spark: SparkSession, path: str):
    """A path as the cluster's file systems know it: (file system, path)."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def removed(spark: SparkSession, path: str) -> None:
    files, found = hadoop_path(spark, path)
    files.delete(found, True)


#: The temporary folder of each local application that has no shared one.
_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a full URI.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may go without: there is one machine,
    and a temporary folder of its own serves.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_roots:
            _local_roots[app] = f"file://{tempfile.mkdtemp(prefix='tracewright-')}"
        root = _local_roots[app]
    files, path = hadoop_path(spark, root)
    return str(files.makeQualified(path).toString()).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; paths of one application lie together."""
    return f"{shared_root(spark)}/tracewright-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back: its lineage ends there, whichever executor is lost."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus
