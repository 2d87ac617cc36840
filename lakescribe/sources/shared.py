"""Intermediate results in the folder that all executors share.

A result that several operators read is written there and read back: it survives the loss of
executors and cuts the lineage, which caching does not.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session.

    Without one only a session of a single process, as in tests, has a folder that all its tasks
    share: a temporary one. On a cluster the setting is required.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/lakescribe"


_scope: ContextVar[str] = ContextVar("scope", default="")


@contextmanager
def run_scope(spark: SparkSession, label: str = "run") -> Iterator[str]:
    """What is materialized within goes into one folder, which is deleted at the end, also after an error.

    Results that read from there must be collected or written before. Scopes may be nested. Without one the tables stay, as
    results are lazy; the owner of the shared folder then clears it.
    """
    folder = fresh_folder(spark, label)
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        _delete(spark, folder)


def _read(path: str, like: DataFrame) -> DataFrame:
    """A folder's rows, none where it is missing."""
    spark = like.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder with all it holds, if there is one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_folder(spark: SparkSession, label: str = "run") -> str:
    return f"{_scope.get() or shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within go when it ends; Spark else keeps them until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, label: str = "table", **options: str) -> DataFrame:
    """The same rows, read back from a table written to the shared folder; what was shuffled for it is deleted."""
    path = fresh_folder(df.sparkSession, label)
    with _shuffles_end(df.sparkSession):
        df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_parts(work: Callable[..., DataFrame], tables: list[tuple[DataFrame, list[Column]]], parts: int) -> DataFrame:
    """work(*tables), done for one part of the keys after another; tables: (rows, key) each.

    For work that never looks at rows of different keys together. A part is the rows whose key has the same
    digest modulo ``parts``. Its result is written, then its shuffle files and inputs are deleted, so the disk holds
    the shuffles of one part only. One part is no more than work(*tables).
    """
    if parts == 1:
        return work(*[df for df, _ in tables])
    spark, folders = tables[0][0].sparkSession, []
    for df, key in tables:
        folders.append(fresh_folder(spark, "parts"))
        with _shuffles_end(spark):
            df.withColumn("__part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")).write.partitionBy("__part").parquet(
                folders[-1], compression="zstd")
    done = []
    for k in range(parts):
        given = [_read(f"{folder}/__part={k}", df) for (df, _), folder in zip(tables, folders)]
        done.append(materialize(work(*given), "part", compression="zstd"))
        for folder in folders:
            _delete(spark, f"{folder}/__part={k}")
    return reduce(DataFrame.unionAll, done)


def dealt(df: DataFrame) -> DataFrame:
    """The same rows, spread evenly over the shuffle's tasks: for long work on rows that few tasks read, such as texts."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
