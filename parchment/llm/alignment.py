"""Alignment of the tokens of two tokenizers over the same bytes, by as-of joins, and corpus counts of linked ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parchment.llm.common import byte_codes, shared_table, slices, span_hashes, text_bytes

SLICE = 4 << 20
BATCH = 1 << 20
PIECE = 1 << 22  # id pairs whose counts are broadcast at once: 13 bytes each
HELD_PAIRS = 1 << 20
RUN = 64  # new units that are encoded as one text


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))})
    return letters


class TwoTokenizers:
    """Ids of texts by a byte-level BPE (A) and a sentencepiece BPE (B), with each token's bytes.

    Texts are cut before every space that follows a printable ASCII character. Neither side has tokens
    across such a point: A's pattern starts a piece there, and no piece of B has a space after
    something else (checked at the start; else texts stay whole). So each distinct unit is
    encoded once and looked up by a 64-bit hash from then on; the table is emptied at `most` units.
    """

    def __init__(self, name_a: str, name_b: str, most: int = 1 << 19):
        self.a = Tokenizer.from_file(public_tokenizers.path(name_a))
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name_b))
        letters = byte_letters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = [self.b.piece_to_id("▁")]  # a lone space at the end of a text; by itself it would be an empty text
        self.cuts = all("▁" not in p.lstrip("▁") for p in pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in held], np.int64) for held in (self.bytes_a, self.bytes_b))
        self.names = [f"{i}{mark}" for n, last in ((len(self.bytes_a), "|"), (len(self.bytes_b), ";")) for mark in (",", last) for i in range(n)]
        self.codes, self.most = byte_codes(43), most
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first, self.count = np.zeros((2, 0), np.int64), np.zeros((2, 0), np.int64)
        self.right = np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]

    def apart(self, units: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Of units by themselves: ids of both sides end to end, how many each unit has, and whether both sides give it back."""
        texts = [x.decode("utf-8", "replace") for x in units]
        found = [[x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([x[1:] for x in texts], num_threads=1)]
        found[1] = [y if len(x) > 1 else self.space for x, y in zip(units, found[1], strict=True)]
        right = [b"".join(map(self.bytes_a.__getitem__, x)) == unit and b"".join(map(self.bytes_b.__getitem__, y)) == unit for unit, x, y in zip(units, *found, strict=True)]
        ids = [np.fromiter(chain.from_iterable(x), np.int32) for x in found]
        return ids, np.array([[len(x) for x in side] for side in found], np.int64), np.array(right, bool)

    def cut(self, side: int, ids: list[int], run: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a run of units and how many each unit has; None if they don't give the run back, or one goes beyond a unit's end."""
        held, size = ((self.bytes_a, self.size_a), (self.bytes_b, self.size_b))[side]
        if b"".join(map(held.__getitem__, ids)) != run:
            return None
        found = np.array(ids, np.int32)
        till = np.cumsum(size[found])
        at = np.searchsorted(till, ends, "right")
        return (found, np.diff(at, prepend=0)) if (till[at - 1] == ends).all() else None

    def learn(self, units: list[bytes], hashes: np.ndarray) -> None:
        """Encode new units: those that end in printable ASCII in runs, as the next one begins with a space; the rest one by one."""
        easy = np.array([self.cuts and 32 < x[-1] < 127 for x in units], bool)
        hard, places = np.flatnonzero(~easy).tolist(), np.flatnonzero(easy).tolist()
        runs = [places[i : i + RUN] for i in range(0, len(places), RUN)]
        joined = [b"".join(map(units.__getitem__, x)) for x in runs]
        texts = [x.decode("utf-8", "replace") for x in joined]
        sides = [[x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([x[1:] for x in texts], num_threads=1)]
        order, parts, counts, right = [], ([], []), ([], []), []
        for run, text, *ids in zip(runs, joined, *sides, strict=True):
            ends = np.cumsum([len(units[i]) for i in run])
            found = [self.cut(side, x, text, ends) for side, x in enumerate(ids)]
            if any(x is None for x in found):
                hard += run
                continue
            order += run
            right.append(np.ones(len(run), bool))
            for side, (x, n) in enumerate(found):
                parts[side].append(x)
                counts[side].append(n)
        if hard:
            order += hard
            ids, number, given = self.apart([units[i] for i in hard])
            right.append(given)
            for side in (0, 1):
                parts[side].append(ids[side])
                counts[side].append(number[side])
        count = np.array([np.concatenate(x) for x in counts])
        first = np.cumsum(count, 1) - count + np.array([[len(x)] for x in self.ids])
        self.ids = [np.concatenate([held, *x]) for held, x in zip(self.ids, parts, strict=True)]
        known = np.concatenate([self.known, hashes[order]])
        by_hash = np.argsort(known, kind="stable")
        self.known, self.right = known[by_hash], np.concatenate([self.right, *right])[by_hash]
        self.first, self.count = np.concatenate([self.first, first], 1)[:, by_hash], np.concatenate([self.count, count], 1)[:, by_hash]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """Of rows of bytes that each begin with a space: which rows both sides give back, and for the units of those their row and (first, count) by side."""
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        if self.cuts:
            edge[1:-1] |= (data[1:] == 32) & (data[:-1] - np.uint8(33) < 94)
        start = np.flatnonzero(edge[:-1])
        end = np.append(start[1:], len(data))
        hashes = span_hashes(data, start, end, self.codes)
        distinct, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self.clear()
        entry = np.searchsorted(self.known, distinct)
        entry[entry == len(self.known)] = 0
        new = self.known[entry] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            self.learn([data[a:b].tobytes() for a, b in zip(start[where[new]].tolist(), end[where[new]].tolist(), strict=True)], distinct[new])
        entry = np.searchsorted(self.known, distinct)[which]
        row = np.searchsorted(at, start, "right") - 1
        good = np.ones(len(at) - 1, bool)
        good[row[~self.right[entry]]] = False
        held = good[row]
        return good, row[held], (self.first[:, entry[held]], self.count[:, entry[held]])


@lru_cache(maxsize=2)
def two_tokenizers(name_a: str, name_b: str) -> TwoTokenizers:
    return TwoTokenizers(name_a, name_b)


def with_space(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the rows with text, each with a space before it, and these rows' numbers."""
    data, at = text_bytes(column)
    rows = np.flatnonzero(np.diff(at) > 0)
    return np.insert(data, at[rows], np.uint8(32)), np.append(at[rows], at[-1]) + np.arange(len(rows) + 1), rows


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (count[i] of them) for each i."""
    till = np.cumsum(count)
    return np.repeat(first - till + count, count) + np.arange(till[-1] if len(till) else 0)


def covering(of: pd.DataFrame, by: pd.DataFrame) -> np.ndarray:
    """For each token's start, the number of the other side's token of the same document that covers it."""
    return pd.merge_asof(of[["doc", "start"]], by[["doc", "start", "number"]], on="start", by="doc")["number"].to_numpy()


def groups_of(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token of either side, numbered through the batch.

    Each token start finds the other side's covering token; the union of both directions are the overlaps.
    Where the two tokens of an overlap end together a group ends.
    """
    over_a = np.concatenate([a["number"].to_numpy(), covering(b, a)])
    over_b = np.concatenate([covering(a, b), b["number"].to_numpy()])
    equal = a["end"].to_numpy()[over_a] == b["end"].to_numpy()[over_b]
    out = []
    for side, over in ((a, over_a), (b, over_b)):
        closes = np.zeros(len(side), np.int64)
        closes[over[equal]] = 1
        out.append(np.cumsum(closes) - closes)
    return out[0], out[1]


def linked(ids: list[np.ndarray], groups: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, A id, B id) as one sorted number each, and how many links each has; doc is that of each group.

    A group's ids count once with their multiplicity, so that a long group costs its distinct ids.
    """
    sides = []
    for x, g in zip(ids, groups, strict=True):
        key, n = np.unique(g << 32 | x.astype(np.int64), return_counts=True)
        sides.append((key >> 32, key & 0xFFFFFFFF, n, np.searchsorted(key >> 32, np.arange(len(doc) + 1))))
    (g, a, n, _), (_, b, m, at) = sides
    count = np.diff(at)[g]
    mate = spread(at[g], count)
    key = np.repeat(doc[g] << 32 | a << 16, count) | b[mate]
    links = np.repeat(n, count) * m[mate]
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    return key[order][first], np.add.reduceat(links[order], first) if len(first) else links


def packed(pairs: np.ndarray, links: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted pairs as differences and their links, byte by byte of all numbers, which compresses well."""
    return tuple(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in (np.diff(pairs, prepend=0), links))


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all rows end to end, and where each row's begin."""
    sizes = np.array([len(x.as_buffer()) // 4 for x in column], np.int64)
    parts = [np.frombuffer(x.as_buffer(), np.uint8).reshape(4, -1).T for x in column]
    whole = np.ascontiguousarray(np.concatenate(parts)).view("<u4")[:, 0] if parts else np.zeros(0, np.uint32)
    return whole.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def unpacked_pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    steps, at = unpacked(column)
    total = np.concatenate([[0], np.cumsum(steps)])
    return total[1:] - np.repeat(total[at[:-1]], np.diff(at)), at


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_a: str = "byte_bpe_50k.json", name_b: str = "piece_bpe_32k.model", keep_groups: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and links (packed), and groups with `keep_groups`.

    Both sides encode a space and the text, special tokens as plain text. `groups` reads
    `a1,a2|b1;a3|b2,b3`. Null and empty texts, and those whose tokens of either side don't give the
    bytes back, have no tokens. Rows are independent, a null id stays null, other columns are
    ignored; an empty table gives no rows. One pass, no shuffle; a batch has about a megabyte of text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = two_tokenizers(name_a, name_b)
        base = 2 * len(both.bytes_a)
        for batch in slices(batches, "text", BATCH):
            data, at, rows = with_space(batch.column("text"))
            n = batch.num_rows
            numbers = np.zeros((4, n), np.int64)
            texts, pairs, links = [""] * n, [b""] * n, [b""] * n
            good, row, (first, count) = both.encode(data, at) if len(rows) else (np.zeros(0, bool), rows, (np.zeros((2, 0), np.int64),) * 2)
            if len(row):
                doc = rows[row]
                sides, ids = [], []
                for i, size in enumerate((both.size_a, both.size_b)):
                    held = both.ids[i][spread(first[i], count[i])]
                    end = np.cumsum(size[held])
                    ids.append(held)
                    sides.append(pd.DataFrame({"doc": np.repeat(doc, count[i]), "start": end - size[held], "end": end, "number": np.arange(len(held))}))
                groups = groups_of(*sides)
                of_doc = [x["doc"].to_numpy() for x in sides]
                last = [np.flatnonzero(np.diff(g, append=-1)) for g in groups]
                group_doc = of_doc[0][last[0]]
                of_group = [np.diff(x, prepend=-1) for x in last]
                for k, x in enumerate((*of_doc, group_doc)):
                    numbers[k] = np.bincount(x, minlength=n)
                numbers[3] = np.bincount(group_doc, of_group[0] * of_group[1], minlength=n).astype(np.int64)
                order = np.zeros(len(ids[0]) + len(ids[1]), np.int64)
                marks = [np.zeros(len(x), np.int64) for x in ids]
                for k in (0, 1):
                    marks[k][last[k]] = 1
                order[np.arange(len(ids[0])) + (last[1] + 1 - of_group[1])[groups[0]]] = ids[0] + marks[0] * len(both.bytes_a)
                order[np.arange(len(ids[1])) + (last[0] + 1)[groups[1]]] = base + ids[1] + marks[1] * len(both.bytes_b)
                cuts = np.concatenate([[0], np.cumsum(numbers[0] + numbers[1])]).tolist()
                for i in rows[good].tolist():
                    texts[i] = "".join(map(both.names.__getitem__, order[cuts[i] : cuts[i + 1]].tolist()))[:-1]
                key, times = linked(ids, list(groups), group_doc)
                cuts = np.searchsorted(key, np.arange(n + 1) << 32).tolist()
                for i in rows[good].tolist():
                    pairs[i], links[i] = packed(key[cuts[i] : cuts[i + 1]] & 0xFFFFFFFF, times[cuts[i] : cuts[i + 1]])
            digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in texts]
            columns = [batch.column("doc_id"), *map(pa.array, numbers), pa.array(digests), pa.array(pairs, pa.binary()), pa.array(links, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts)] * keep_groups, names)

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, links binary" + ", groups string" * keep_groups
    names = [x.split()[0] for x in schema.split(", ")]
    return rows.mapInArrow(run, schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): how many rows of `aligned` hold each linked pair (A id * 65536 + B id), and whether no other pair of its A id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in slices(batches, "pairs", SLICE):
            fresh, n = np.unique(unpacked_pairs(batch.column("pairs"))[0], return_counts=True)
            pairs, which = np.unique(np.concatenate([pairs, fresh]), return_inverse=True)
            counts = np.bincount(which, np.concatenate([counts, n]), minlength=len(pairs)).astype(np.int64)
            if len(pairs) > HELD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])
                pairs, counts = pairs[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

    counts = shared_table(found.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair_counts")
    a = F.shiftright("pair", 16)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row for each id of A's vocabulary
    return counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def weighed(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) from (row, pairs, links): looked up in broadcast counts."""
    spark = found.sparkSession
    table = counts.toArrow()
    pair = table["pair"].to_numpy()
    order = np.argsort(pair)
    held = spark.sparkContext.broadcast((pair[order], table["n"].to_numpy()[order].astype(np.int64), table["best"].to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = held.value
        for batch in slices(batches, "pairs", SLICE):
            asked, at = unpacked_pairs(batch.column("pairs"))
            links, _ = unpacked(batch.column("links"))
            place = np.minimum(np.searchsorted(pair, asked), max(len(pair) - 1, 0))
            met = pair[place] == asked if len(pair) else np.zeros(len(asked), bool)
            sums = [np.concatenate([[0], np.cumsum(np.where(met, x, 0) * links)]) if len(pair) else np.zeros(len(asked) + 1, np.int64) for x in ((best[place], n[place]) if len(pair) else (0, 0))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array((x[at[1:]] - x[at[:-1]]).astype(np.int64)) for x in sums)], ["row", "n_best", "count_sum"])

    return found.select("row", "pairs", "links").mapInArrow(run, "row long, n_best long, count_sum long")


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_a: str = "byte_bpe_50k.json", name_b: str = "piece_bpe_32k.model", piece: int = PIECE) -> DataFrame:
    """One row per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 ('' without tokens).

    Groups and links are those of `aligned`; a pair's count is how many rows hold it linked. Each row keeps its distinct
    pairs packed; counts are summed within tasks first and never belong to one document. They go back to the rows as
    broadcasts of at most `piece` pairs each, by hash of the pair: as many as the pairs need, which the two
    vocabularies bound, and which are one or two for any real corpus. Sums of the parts are those of the whole.

    Null and empty texts, and those that either side doesn't give back byte by byte, have zeros.
    Rows that share an id are documents each. An empty table gives no rows.
    """
    found = shared_table(aligned(docs, id_col, text_col, name_a, name_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = shared_table(pair_counts(found), "counts")
    parts = max(1, -(-counts.count() // piece))
    sums = [weighed(found, counts.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == i)) for i in range(parts)]
    total = sums[0]
    for more in sums[1:]:
        total = total.union(more)
    total = total.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.drop("pairs", "links").join(total, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
