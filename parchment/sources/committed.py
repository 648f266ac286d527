"""A sink whose runs appear whole or not at all: files first, then one manifest that names them."""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "committed_files"
RUNS, DATA = "_runs", "data"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def manifests(path: str) -> list[dict]:
    """The manifests of all runs that count, in the order they were committed; those before a replacing run don't."""
    store, folder = store_of(path)
    found = store.get_file_info(fs.FileSelector(posixpath.join(folder, RUNS), allow_not_found=True))
    read = []
    for x in found:
        if x.path.endswith(".json"):
            with store.open_input_stream(x.path) as f:
                read.append(json.loads(f.read()))
    read.sort(key=lambda m: (m["seq"], m["run"]))
    start = max((i for i, m in enumerate(read) if m["replaces"]), default=0)
    return read[start:]


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: a file below the folder of its attempt, or no file if it had no rows."""

    file: str | None
    rows: int
    size: int


class CommittedFiles(DataSource):
    """Rows as Parquet files of a run.

    Options: `path` (a folder, by path or URI of any file system that Arrow knows) and `run` (a name; a run of the
    same name replaces the earlier one, so that a repeated job leaves its rows once; by default a new name). Mode
    "append" adds a run to those there, "overwrite" makes all earlier ones count no more. Tasks that fail, are repeated or
    run twice leave files that no manifest names, and a job that fails has no manifest.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: T.StructType, overwrite: bool) -> CommittedWriter:
        return CommittedWriter(self.options, schema, overwrite)


class CommittedWriter(DataSourceArrowWriter):
    def __init__(self, options, schema: T.StructType, overwrite: bool):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("the option 'path' is missing")
        self.run = options.get("run") or uuid.uuid4().hex
        if "/" in self.run or self.run.startswith((".", "_")):
            raise ValueError(f"not a name for a run: {self.run!r}")
        self.attempt = f"{DATA}/{self.run}-{uuid.uuid4().hex}"
        self.schema, self.replaces = schema.json(), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        """One file a task, batch by batch, under a name of its own."""
        store, folder = store_of(self.path)
        file, rows, sink = None, 0, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if sink is None:
                    file = f"{self.attempt}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet"
                    store.create_dir(f"{folder}/{self.attempt}", recursive=True)
                    sink = pq.ParquetWriter(f"{folder}/{file}", batch.schema, filesystem=store, compression="zstd")
                sink.write_batch(batch)
                rows += batch.num_rows
        finally:
            if sink is not None:
                sink.close()
        return Part(file, rows, store.get_file_info(f"{folder}/{file}").size if file else 0)

    def commit(self, messages: list[Part | None]) -> None:
        """The manifest, under a temporary name first: its move is the moment in which the run appears."""
        store, folder = store_of(self.path)
        parts = [x for x in messages if x is not None and x.file]
        known = manifests(self.path)
        manifest = {
            "run": self.run,
            "seq": max((m["seq"] for m in known), default=-1) + 1,
            "replaces": self.replaces,
            "schema": json.loads(self.schema),
            "files": [{"file": x.file, "rows": x.rows, "size": x.size} for x in parts],
        }
        store.create_dir(f"{folder}/{RUNS}", recursive=True)
        draft = f"{folder}/{RUNS}/{self.run}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(draft) as f:
            f.write(json.dumps(manifest).encode())
        store.move(draft, f"{folder}/{RUNS}/{self.run}.json")

    def abort(self, messages: list[Part | None]) -> None:
        """What the failed job's tasks wrote goes; nothing of it was visible."""
        store, folder = store_of(self.path)
        if store.get_file_info(f"{folder}/{self.attempt}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.attempt}")


def write_committed(df: DataFrame, path: str, run: str | None = None, mode: str = "append") -> None:
    """`df` as a run below `path`, all of it or nothing."""
    df.sparkSession.dataSource.register(CommittedFiles)
    writer = df.write.format(FORMAT).mode(mode)
    (writer.option("run", run) if run else writer).save(path)


def read_committed(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """Rows of all committed runs, or of one, with the columns of the newest; an error if there is no such run.

    Files are those that manifests name, so files of jobs under way, failed or replaced are never listed. A
    column that an older run doesn't have is null in its rows.
    """
    held = [m for m in manifests(path) if run in (None, m["run"])]
    if not held:
        raise FileNotFoundError(f"no committed run {run or ''} in {path}")
    schema = T.StructType.fromJson(held[-1]["schema"])
    files = [posixpath.join(path, x["file"]) for m in held for x in m["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def sweep(path: str, older_than: float = 7 * 86400.0) -> int:
    """Delete folders of attempts that no manifest names and that are older than so many seconds; returns their number.

    For what drivers left that died before they could abort. The age keeps jobs under way safe.
    """
    store, folder = store_of(path)
    named = {posixpath.dirname(x["file"]) for m in manifests(path) for x in m["files"]}
    gone = 0
    for x in store.get_file_info(fs.FileSelector(f"{folder}/{DATA}", allow_not_found=True)):
        if f"{DATA}/{posixpath.basename(x.path)}" not in named and x.mtime is not None and time.time() - x.mtime.timestamp() >= older_than:
            store.delete_dir(x.path)
            gone += 1
    return gone
