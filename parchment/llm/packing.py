"""Best-fit packing of token pieces into sequences, online and in bounded space."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from parchment.llm.common import slices, text_bytes
from parchment.llm.words import word_bpe

BATCH_BYTES = 32 << 20
LOT = 512  # pieces that come together, the longest first; fewer than the open bins, so that none of these closes unfilled for want of short pieces


class BestFit:
    """A fixed number of open bins; bit f of `free` is set while a bin with f places free is open."""

    def __init__(self, capacity: int, most_open: int, first_id: int):
        self.capacity, self.most_open, self.next_id = capacity, most_open, first_id
        self.free, self.open = 0, 0
        self.bins: dict[int, list[int]] = {}

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset for a piece: the open bin with the least sufficient space, or a new one."""
        if fits := self.free >> length:
            space = length + (fits & -fits).bit_length() - 1
            sequence = self.take(space)
        else:
            if length < self.capacity and self.open == self.most_open:
                self.take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            space, sequence = self.capacity, self.next_id
            self.next_id += 1
        if left := space - length:
            self.bins.setdefault(left, []).append(sequence)
            self.free |= 1 << left
            self.open += 1
        return sequence, self.capacity - space

    def take(self, space: int) -> int:
        held = self.bins[space]
        sequence = held.pop()
        if not held:
            del self.bins[space]
            self.free ^= 1 << space
        self.open -= 1
        return sequence


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    open_bins: int = 1024,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 0,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids with `keep_ids`).

    A document is its ids and `end_id`; only documents longer than `capacity` are cut. Each
    partition packs its own rows online, as they come, so nothing is shuffled and a lost task
    repeats alone with the same result; its number is the high part of sequence_id. Pieces come
    in lots of LOT, the longest of a lot first. At most `open_bins` bins are open, so memory doesn't
    grow with the input and a partition wastes at most what those have free at its end.

    Null and empty texts are one id, `end_id`. Repeated rows are packed each; a null id stays
    null; other columns are ignored. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        bins = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for batch in slices(batches, "text", BATCH_BYTES):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            done = 0
            for part in slices(iter([batch]), "text"):
                for x in bpe.encode(*text_bytes(part.column("text"))):
                    whole = np.append(x, np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(whole), capacity)):
                        cut = whole[at : at + capacity]
                        row.append(done)
                        piece.append(k)
                        start.append(at)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                        if keep_ids:
                            ids.append(cut.astype(np.int32))
                    done += 1
            sequence, offset = [0] * len(row), [0] * len(row)
            sizes = np.array(length)
            for at in range(0, len(row), LOT):
                for i in (at + np.argsort(-sizes[at : at + LOT], kind="stable")).tolist():
                    sequence[i], offset[i] = bins.place(length[i])
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, sequence, offset))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(run, schema)
