"""Intermediate results written once, so that what is read often is neither planned nor computed again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names, which all executors see.

    Where it is unset a run on one machine gets a temporary folder, which goes with the driver; a
    cluster has no folder that could stand in for it, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="parchment-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def joined(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join of two tables that both grow with the input, by shuffles.

    Parquet tables compress well and are estimated by a share of their files, so that Spark would send
    such a table through the driver to all workers when it is far larger than its estimate.
    """
    return a.join(b.hint("merge"), on, how)


# Settings of the job that writes a table. Its shuffles are deleted when it ends, not when the driver's
# memory is next cleared; and rows that were moved by document meet by document and more without being moved again.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


@contextmanager
def settings_of(spark: SparkSession, given: dict[str, str]) -> Iterator[None]:
    """The session with these settings, and with its own after that."""
    before = {x: spark.conf.get(x, None) for x in given}
    try:
        for x, value in given.items():
            spark.conf.set(x, value)
        yield
    finally:
        for x, value in before.items():
            if value is None:
                spark.conf.unset(x)
            else:
                spark.conf.set(x, value)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder.

    Unlike cached blocks it survives lost executors, and later plans start at its scan.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` stored, its shuffles deleted: the disk holds those of one such table at a time, and the tables."""
    with settings_of(df.sparkSession, WRITING):
        return stored(df, name, compression="zstd")
