"""Results that must not be computed twice are written where all executors can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The temporary folder of each local application that has no shared one.
_local_roots: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_roots:
            _local_roots[app] = f"file://{tempfile.mkdtemp(prefix='tracewright-')}"
        root = _local_roots[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    path = path or shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_output(path: str):
    """A stream that writes a new file, at a local path or a URI."""
    import pyarrow as pa
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return pa.OSFile(path, "wb")
    files, place = fs.FileSystem.from_uri(path)
    files.create_dir(place.rpartition("/")[0], recursive=True)
    return files.open_output_stream(place)


#: Values of this many bytes may be sent to all executors.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, bytes_per_row: int = 64) -> DataFrame:
    """``df`` as the side of a join: broadcast if its texts and rows, which are measured, have BROADCAST_BYTES at most."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() == "string"]
    size = df.agg(F.sum(sum(texts, F.lit(bytes_per_row))).alias("bytes")).first().bytes or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place in ``order``, from 0, as ``name``; ``order`` tells all rows apart.

    Rows are dealt out by ranges and numbered in each; what is in one place is the number of rows of each range.
    """
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("n"))
    before = counts.select("_range", (F.sum("n").over(W.partitionBy(F.lit(1)).orderBy("_range")) - F.col("n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1 + F.col("_before")
    return dealt.join(F.broadcast(before), "_range").withColumn(name, place.cast("long")).drop("_range", "_before")
