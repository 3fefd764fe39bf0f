"""Cutting lineage in storage that driver and executors share."""

from __future__ import annotations

import gc
import tempfile

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset (as in tests
    on one machine) a temporary folder, which is then used for the whole session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="sparkquire-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Bytes of an Arrow batch of texts; Spark's own default is 64 MB, of which a task holds several at once.
BATCH_BYTES = 4 << 20


def modest_batches(spark: SparkSession) -> None:
    """Small Arrow batches for tasks that send texts to Python, where the session has Spark's default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m").removesuffix("b") in ("64m", str(64 << 20)):
        spark.conf.set(key, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept as a reliable checkpoint: an executor's loss
    afterwards costs a read, and Spark's cleaner removes the files of dropped frames."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files are too few for them: for costly work on rows of a small
    table.  A table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffles and checkpoints that no frame refers to any more; it
    learns of them from the driver's garbage collection, which otherwise may come much later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a uri or plain path, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)
