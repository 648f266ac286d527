"""BPE encoding and decoding, with tree concatenation of long texts."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame

from parchment.llm.common import slices

LEAF_CHARS = 4096
WINDOW = 32
AGREE = 4


class ByteBpe:
    """Byte-level BPE given as ranks; a special token's text stands for its id, as in the tokenizers library."""

    def __init__(self, vocabulary: str, special: str, special_id: int, leaf_chars: int = LEAF_CHARS):
        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special, self.special_id, self.leaf_chars = special, special_id, leaf_chars
        self.names = [str(i) for i in range(max([*ranks.values(), special_id]) + 1)]
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.joins = 0  # windows encoded anew so far
        tokens = {rank: token for token, rank in ranks.items()}
        self.opens = [tokens.get(i, b"")[:1] == b" " for i in range(len(self.names))]
        self.closes = [b"!" <= tokens.get(i, b"")[-1:] <= b"~" for i in range(len(self.names))]

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars and self.special not in text:
            return self.bpe.encode_ordinary(text)
        ids: list[int] = []
        for i, part in enumerate(text.split(self.special)):
            if i:
                ids.append(self.special_id)
            ids += self.halved(part)
        return ids

    def halved(self, text: str) -> list[int]:
        """Ids of a text: halved down to leaves, these encoded in parallel and joined upwards."""
        leaves = [text]
        while len(leaves[0]) > self.leaf_chars:
            leaves = [half for x in leaves for half in (x[: (len(x) + 1) // 2], x[(len(x) + 1) // 2 :])]
        parts = self.bpe.encode_ordinary_batch(leaves, num_threads=2) if len(leaves) > 1 else [self.bpe.encode_ordinary(text)]
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) for i in range(0, len(parts), 2)]
        return parts[0]

    def safe(self, before: int, at: int) -> bool:
        """Whether a space follows something else between two ids.

        No piece of the vocabulary's pattern spans such a point, and none looks beyond it, so the
        ids on either side don't depend on the other side.
        """
        return self.opens[at] and self.closes[before]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of two neighbouring parts of a text, cut anywhere.

        A window around the join, from a safe point to a safe point (or an end), is encoded anew,
        and doubled until its first and last AGREE ids are those of the two sides.
        """
        if not left or not right:
            return left or right
        reach = WINDOW
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            while a and not self.safe(left[a - 1], left[a]):
                a -= 1
            while b < len(right) and not self.safe(right[b - 1], right[b]):
                b += 1
            text = self.bpe.decode_bytes(left[a:] + right[:b]).decode()
            window = self.bpe.encode_ordinary(text) if len(text) <= 2 * self.leaf_chars else self.unsplit(text)
            self.joins += 1
            if (a == 0 or window[:AGREE] == left[a : a + AGREE]) and (b == len(right) or window[-AGREE:] == right[b - AGREE : b]):
                return left[:a] + window + right[b:]
            reach *= 2

    def unsplit(self, text: str) -> list[int]:
        """Ids of a long stretch without white space: of its pattern pieces, long ones as trees."""
        ids: list[int] = []
        for m in self.pieces.finditer(text):
            ids += self.tree(m[0]) if len(m[0]) > self.leaf_chars else self.bpe._encode_single_piece(m[0])
        return ids

    def tree(self, piece: str) -> list[int]:
        """Ids of one long pattern piece: halved down to leaves, these encoded in parallel and joined upwards."""
        leaves = [piece]
        while len(leaves[0]) > self.leaf_chars:
            leaves = [half for x in leaves for half in (x[: (len(x) + 1) // 2], x[(len(x) + 1) // 2 :])]
        parts = self.bpe.encode_ordinary_batch(leaves, num_threads=2)
        while len(parts) > 1:
            parts = [self.join_bytes(parts[i], parts[i + 1]) for i in range(0, len(parts), 2)]
        return parts[0]

    def join_bytes(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of two neighbouring parts of one pattern piece.

        A window of ids around the join is encoded anew, and doubled until its first and last
        AGREE ids are those of the two sides. Every pair of adjacent ids of the result then stands
        in a correct encoding (of the left side, the window or the right side), which holds for
        the encoding of the whole and no other.
        """
        reach = WINDOW
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            window = self.bpe._encode_single_piece(self.bpe.decode_bytes(left[a:] + right[:b]))
            self.joins += 1
            if (a == 0 or window[:AGREE] == left[a : a + AGREE]) and (b == len(right) or window[-AGREE:] == right[b - AGREE : b]):
                return left[:a] + window + right[b:]
            reach *= 2

    def decode(self, ids: list[int]) -> bytes:
        if self.special_id not in ids:
            return self.bpe.decode_bytes(ids)
        parts: list[list[int]] = [[]]
        for i in ids:
            if i == self.special_id:
                parts.append([])
            else:
                parts[-1].append(i)
        return self.special.encode().join(self.bpe.decode_bytes(x) for x in parts)


@lru_cache(maxsize=2)
def byte_bpe(vocabulary: str, special: str, special_id: int, leaf_chars: int = LEAF_CHARS) -> ByteBpe:
    return ByteBpe(vocabulary, special, special_id, leaf_chars)


def bpe_round_trip(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.tiktoken",
    special: str = "<|endoftext|>",
    special_id: int = 50256,
    leaf_chars: int = LEAF_CHARS,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids_sha256, decoded_sha256, n_joins (and ids, decoded with `keep_ids`).

    Texts up to `leaf_chars` are encoded at once. Longer ones are halved down to leaves, wherever
    the middle is; the leaves are encoded in parallel, and each join is repaired by encoding a
    growing window around it anew, from a space to a space, until both sides agree. What has no
    space for long falls into pattern pieces, and a piece longer than `leaf_chars` is a tree of its
    own, joined by ids. `n_joins` counts the windows that were encoded anew.

    Null and empty texts have no tokens: n_tokens 0, both digests of the empty string. Rows are
    independent, a null id stays null, other columns are ignored. One pass without a shuffle.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary, special, special_id, leaf_chars)
        name = bpe.names.__getitem__
        for batch in slices(batches, "text"):
            counts, id_digests, text_digests, joins, kept, decoded = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                before = bpe.joins
                ids = bpe.encode(text) if text else []
                joins.append(bpe.joins - before)
                back = bpe.decode(ids)
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                text_digests.append(hashlib.sha256(back).hexdigest())
                if keep_ids:
                    kept.append(ids)
                    decoded.append(back.decode("utf-8", "replace"))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string()), pa.array(joins, pa.int64())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_joins"]
            if keep_ids:
                columns += [pa.array(kept, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_joins long" + ", ids array<int>, decoded string" * keep_ids
    return rows.mapInArrow(encode, schema)
