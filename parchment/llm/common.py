"""Helpers that the operators share: shared tables, Arrow text slices, vectorised word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.sources.tables import stored as shared_table  # noqa: F401  (the operators take it from here)

SLICE_BYTES = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keep_only(docs: DataFrame, kept: DataFrame, id_col: str) -> DataFrame:
    """Rows of `docs` whose id is in `kept`, with exactly the columns of `docs`; a null id matches a null id."""
    flag = kept.select(F.col(id_col).alias("_kept_id"))
    return docs.join(flag, docs[id_col].eqNullSafe(flag["_kept_id"]), "left_semi")


def id_crc32(column) -> F.Column:
    return F.crc32(column.cast("string").cast("binary"))


def slices(batches: Iterator[pa.RecordBatch], text: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each part holds about `limit` bytes of text, and one row at least.

    At the end, memory that Arrow keeps for later goes back to the system: workers live on.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(text_bytes(batch.column(text))[1])
        part = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
        del batch
    pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the offset of each row; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_tables: dict[str, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    key = f"p{base}"
    if key not in _tables or len(_tables[key]) < n:
        x = np.full(max(n, SLICE_BYTES + 65536), base, np.uint64)
        x[0] = 1
        _tables[key] = np.cumprod(x, dtype=np.uint64)
    return _tables[key][:n]


def byte_codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for many spans: differences of one running sum of code * base**i."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * powers(MULTIPLIER, len(data)), out=total[1:])
    return mix((total[end] - total[start]) * powers(INVERSE, len(data) + 1)[start])


def by_row(at: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Offsets into `start` (sorted positions) of each row that `at` delimits."""
    return np.searchsorted(start, at)


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i+1]] for each i, zero for empty rows; works along axis 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]
