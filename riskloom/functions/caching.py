"""Intermediate results as tables in the shared folder.

A frame that several consumers read is written once as Parquet under the
folder the session names in ``spark.checkpoint.dir`` and read back. Nothing
stays in the executors' block stores, a lost executor costs a re-read, readers
prune columns and push filters, and the written plan is an ordinary query, so
adaptive execution sizes and splits its partitions.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


#: Stored intermediate tables are read a few times and written once; the session's codec holds for published ones.
STORED_CODEC = "zstd"


def run_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    return f"{ensure_checkpoint_dir(spark)}/riskloom-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=STORED_CODEC)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def input_key(spark: SparkSession, folder: str) -> str:
    """Names the state of an input folder: its full path and its entries' names, sizes and times of change.

    A table that is a folder counts by its total size, number of files and own
    time of change, so the key costs a few calls, not one per file.
    """
    files, at = _file_system(spark, folder)
    seen = [str(files.resolvePath(at))]
    for entry in files.listStatus(at):
        inner = files.getContentSummary(entry.getPath()) if entry.isDirectory() else None
        size = (inner.getLength(), inner.getFileCount()) if inner else (entry.getLen(), 1)
        seen.append(f"{entry.getPath().getName()} {size[0]} {size[1]} {entry.getModificationTime()}")
    return hashlib.sha256("\n".join([seen[0], *sorted(seen[1:])]).encode()).hexdigest()[:32]


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table at ``path`` was written to its end."""
    files, done = _file_system(spark, f"{path}/_SUCCESS")
    return files.exists(done)


def published_once(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that the queries of an application share: written at first use of this state of ``folder``, then read by path."""
    path = f"{run_folder(spark)}/{name}-{input_key(spark, folder)}"
    if not is_written(spark, path):
        build().write.mode("overwrite").parquet(path, compression=STORED_CODEC)
    return spark.read.parquet(path)
