"""A data source of document files, in which files that can't be read are rows, too."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from parchment.config import DEFAULTS, Settings
from parchment.functions import geometry
from parchment.sources.files import http_code, truncation_warning, upload_error
from parchment.sources.media import media_facts

FORMAT = "document_files"
HEAD = 16


class Files(InputPartition):
    """Some files of a folder: (path, length), the length null if the file isn't there."""

    def __init__(self, held: list[tuple[str, int | None]]):
        self.held = held


class DocumentFiles(DataSource):
    """Files of a folder as rows: path, file_name, suffix, length, head (16 bytes), content, error_class, error.

    Options: `path` (a folder, by path or URI of any file system that Arrow knows), `files` (names below it, one a
    line, instead of all), `content` ("true" to read it), `most_bytes` (larger files have no content),
    `files_per_part` and `bytes_per_part`. Empty files are rows of length 0. A named file that isn't there is a row
    with FileNotFound, one that can't be read with UnreadableFile. Partitions are pieces of the listing,
    bounded by files and bytes, so that neither a large folder nor large files make a long task.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, file_name string, suffix string, length long, head binary, content binary, error_class string, error string"

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(self.options)


class DocumentReader(DataSourceReader):
    def __init__(self, options):
        get = options.get
        self.folder = get("path")
        if not self.folder:
            raise ValueError("the option 'path' is missing")
        self.names = [x.strip() for x in (get("files") or "").splitlines() if x.strip()]
        self.content = (get("content") or "").lower() == "true"
        self.most_bytes = int(get("most_bytes") or 1 << 31)
        self.files_per_part, self.bytes_per_part = int(get("files_per_part") or 256), int(get("bytes_per_part") or 64 << 20)

    def store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def partitions(self) -> list[InputPartition]:
        store, folder = self.store()
        if self.names:
            asked = [posixpath.join(folder, x) for x in self.names]
            found = [(path, x.size if x.type == fs.FileType.File else None) for path, x in zip(asked, store.get_file_info(asked), strict=True)]
        else:
            listed = store.get_file_info(fs.FileSelector(folder, recursive=True))
            found = sorted((x.path, x.size) for x in listed if x.type == fs.FileType.File)
        parts, held, size = [], [], 0
        for path, length in found:
            if held and (len(held) == self.files_per_part or size + (length or 0) > self.bytes_per_part):
                parts.append(Files(held))
                held, size = [], 0
            held.append((path, length))
            size += length or 0
        return [*parts, Files(held)]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = self.store()
        for path, length in partition.held:
            name = posixpath.basename(path)
            suffix = posixpath.splitext(name)[1].lower()
            if length is None:
                yield path, name, suffix, None, None, None, "FileNotFound", "the file was not found"
                continue
            try:
                with store.open_input_stream(path) as f:
                    data = f.read(length if self.content and length <= self.most_bytes else HEAD)
                yield path, name, suffix, length, data[:HEAD], data if self.content and length <= self.most_bytes else None, None, None
            except OSError as error:
                yield path, name, suffix, length, None, None, "UnreadableFile", f"the file could not be read: {type(error).__name__}"


def read_documents(spark: SparkSession, folder: str, files: list[str] | None = None, content: bool = True, settings: Settings = DEFAULTS) -> DataFrame:
    """The files of a folder, or those named, by the data source; files over the upload limit without their content."""
    spark.dataSource.register(DocumentFiles)
    reader = spark.read.format(FORMAT).option("content", str(content).lower()).option("most_bytes", settings.max_upload_bytes)
    return (reader.option("files", "\n".join(files)) if files else reader).load(folder)


def intake(files: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """What is to be read of each file: its columns but the content, n_pages, n_used, width and height to scale to, warnings, and fault.

    `fault` (struct<code, error>, null for good files) is the first of: the file isn't there or can't be read; an upload
    rule; a PDF or image that can't be opened. It is what `export.outcomes` takes.
    """
    known = files.withColumnsRenamed({"error_class": "_class", "error": "_error"})
    facts = media_facts(known, most_pixels=settings.max_pixels)
    missing = F.when(F.col("_class").isNotNull(), F.struct(F.coalesce(http_code(F.col("_class")), F.lit(500)).alias("code"), F.col("_error").alias("error")))
    broken = F.when(F.col("error_class").isNotNull(), F.struct(http_code(F.col("error_class")).alias("code"), F.col("error").alias("error")))
    fault = F.coalesce(missing, upload_error(F.col("suffix"), F.col("length"), F.col("head"), settings), broken)
    size = geometry.scaled_size(F.col("width"), F.col("height"), settings.max_image_side)
    good = facts.withColumn("fault", fault)
    ok = F.col("fault").isNull()
    shown = ok & F.col("width").isNotNull()
    return good.select(
        *(x for x in known.columns if x not in ("content", "head", "_class", "_error")),
        F.when(ok, F.col("n_pages")).alias("n_pages"),
        F.when(ok, F.least("n_pages", F.lit(settings.max_pages))).alias("n_used"),
        F.when(shown, size["width"]).alias("width"),
        F.when(shown, size["height"]).alias("height"),
        F.array_compact(F.array(F.when(ok, truncation_warning(F.col("n_pages"), settings)))).alias("warnings"),
        "fault",
    )
