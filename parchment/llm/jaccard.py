"""N-gram Jaccard join by parity sketches: pigeonhole candidates, verified exactly, and their components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.llm.common import byte_codes, keep_only, mix, shared_table, slices, span_hashes, text_bytes
from parchment.llm.components import components

SKETCH_WORDS = 8
FILTER_WORDS = 1 << 20
BLOCK_KEYS = 1 << 19
CROWD = 8  # nodes at a key from which on it has hubs
OUTSIDE = 64  # nodes outside a group's largest component from which on the group is crowded
COMPARED = 32  # comparisons a node, within which groups stay as they are
FINE_SEED = 62
COUNTER_BITS = 18
COUNTER_BLOCK = 1 << 10
PAIRS_PER_PART = 256
CODES = byte_codes(29)
SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def compared() -> F.Column:
    """Comparisons that groups of (outside, total) nodes cost."""
    return F.sum(F.col("outside").cast("double") * F.col("total"))


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows end to end, and where each row's begin.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A row with fewer
    than `width` words has one shingle, the whole sequence; one without words has none.
    """
    data = LOWER[data]
    word = ~SPACE[data]
    first = np.ones(len(data), bool)
    first[1:] = ~word[:-1]
    first[at[:-1][at[:-1] < len(data)]] = True
    start = np.flatnonzero(word & first)
    last = np.ones(len(data), bool)
    last[:-1] = ~word[1:]
    last[at[1:][at[1:] > 0] - 1] = True
    end = np.flatnonzero(word & last) + 1
    hashes = span_hashes(data, start, end, CODES)
    row = np.searchsorted(at, start, "right") - 1
    words = np.bincount(row, minlength=len(at) - 1)
    till = np.cumsum(words)
    left = till[row] - np.arange(len(row))  # words of the row from here on
    begins = (left >= width) | (left == words[row]) & (words[row] < width)
    whole = np.flatnonzero(begins)
    code = np.zeros(len(whole), np.uint64)
    for k in range(width):
        held = left[whole] > k
        step = np.where(held, hashes[np.minimum(whole + k, max(len(hashes) - 1, 0))], np.uint64(0)) if len(hashes) else code
        code = code * np.uint64(0x9E3779B97F4A7C15) + step
    code = mix(code)
    rows = row[whole]
    order = np.lexsort((code, rows))
    code, rows = code[order], rows[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (rows[1:] != rows[:-1])
    code, rows = code[new], rows[new]
    return code, np.searchsorted(rows, np.arange(len(at)))


@dataclass(frozen=True)
class Bands:
    """Size bands and the pigeonhole arithmetic of a similarity of `percent` %.

    Sets of sizes a and b that reach it differ in at most (a + b)(100 - percent) / (100 + percent)
    members. Band j holds pairs whose larger set has at most tops[j] members, so that they
    differ in at most k members; members fall into k + 1 + slack segments by hash, and at least
    1 + slack segments of two such sets are equal. A set's segment is a parity vector over its
    members' hash positions, kept as the XOR of their 64-bit values. A segment without members
    says nothing; sets with more than `slack` such segments also give segments by a next seed,
    and so on until one seed leaves no more. Of two sets, take the first seed with which either is done:
    both give their segments by it, and one equal segment has members.
    """

    percent: int = 85
    growth: float = 1.5
    most: int = 1 << 40

    @cached_property
    def tops(self) -> np.ndarray:
        tops = [max(1, (100 + self.percent) // (2 * (100 - self.percent)) - 1)]
        while tops[-1] < self.most:
            tops.append(int(np.ceil(tops[-1] * self.growth)))
        return np.array(tops)

    @cached_property
    def allowed(self) -> np.ndarray:
        return 2 * self.tops * (100 - self.percent) // (100 + self.percent)

    @cached_property
    def segments(self) -> np.ndarray:
        return self.allowed + 1 + np.where(self.allowed > 0, np.maximum(1, self.allowed // 8), 0)

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The band of each size, and that of its largest partner."""
        return np.searchsorted(self.tops, sizes), np.searchsorted(self.tops, sizes * 100 // self.percent)

    def keys(self, code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segment keys of all rows, and the row of each."""
        sizes = np.diff(at)
        own, next_up = self.of(sizes)
        found = []
        for band, rows in ((own, np.flatnonzero(sizes > 0)), (next_up, np.flatnonzero((sizes > 0) & (next_up != own)))):
            seed = 0
            while len(rows):
                keys, owner, lacking = self.segment_keys(code, at, rows, band[rows], seed)
                found.append((keys, owner))
                rows = rows[lacking > self.segments[band[rows]] - 1 - self.allowed[band[rows]]]
                seed += 1
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    @cached_property
    def fine(self) -> np.ndarray:
        return np.maximum(64, 3 * self.allowed)

    def fine_keys(self, code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys of finer segments of all rows, their row and band, and how many of a row's keys a link can't do without.

        Linked sets differ in at most k segments, so each has at most k keys that the other lacks.
        In any order of all keys, the first one in common is among the first k + 1 of both. Sets with
        no more than k keys might have none in common; these share one key more. In a band without a
        difference distinct sets don't link, and have no keys.
        """
        sizes = np.diff(at)
        own, next_up = self.of(sizes)
        found = []
        for band, rows in ((own, np.flatnonzero(sizes > 0)), (next_up, np.flatnonzero((sizes > 0) & (next_up != own)))):
            rows = rows[self.allowed[band[rows]] > 0]
            if not len(rows):
                continue
            key, owner, lacking = self.segment_keys(code, at, rows, band[rows], FINE_SEED, self.fine)
            few = rows[self.fine[band[rows]] - lacking <= self.allowed[band[rows]]]
            key = np.concatenate([key, mix(band[few].astype(np.uint64) + np.uint64(101))])
            owner = np.concatenate([owner, few])
            found.append((key, owner, band[owner], self.allowed[band[owner]] + 1))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (none.view(np.uint64), none, none, none)

    def segment_keys(self, code: np.ndarray, at: np.ndarray, rows: np.ndarray, band: np.ndarray, seed: int, segments: np.ndarray | None = None):
        segments = self.segments if segments is None else segments
        sizes = at[rows + 1] - at[rows]
        till = np.cumsum(sizes)
        which = np.repeat(np.arange(len(rows)), sizes)
        members = code[np.repeat(at[rows] - till + sizes, sizes) + np.arange(till[-1])]
        place = members if not seed else mix(members ^ np.uint64(seed * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
        segment = ((place >> np.uint64(32)) * segments[band][which].astype(np.uint64)) >> np.uint64(32)
        if seed:
            order = np.lexsort((segment, which))
            members, segment, which = members[order], segment[order], which[order]
        new = np.ones(len(members), bool)
        new[1:] = (segment[1:] != segment[:-1]) | (which[1:] != which[:-1])
        starts = np.flatnonzero(new)
        words = np.bitwise_xor.reduceat(mix(members + np.uint64(1)), starts)
        owner, segment = which[starts], segment[starts]
        held = words != 0
        words, owner, segment = words[held], owner[held], segment[held]
        lacking = segments[band] - np.bincount(owner, minlength=len(rows))
        salt = (segment * np.uint64(64) + np.uint64(min(seed, 63))) * np.uint64(128) + band[owner].astype(np.uint64)
        return mix(words ^ mix(salt + np.uint64(11))), rows[owner], lacking


def set_ids(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each row's set."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(code ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return mix((total[at[1:]] - total[at[:-1]]) ^ np.diff(at).astype(np.uint64)).view(np.int64)


def sketches(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Parity sketch of each row: bit i says whether an odd number of members falls on i."""
    bits = SKETCH_WORDS * 64
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = rows * bits + (code & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=(len(at) - 1) * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, bits), axis=1, bitorder="little").view(np.int64)


def wide_sketches(code: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Parity sketches of four to eight bits per member, of 2**k >= SKETCH_WORDS * 64 bits, so that no size fills them."""
    sizes = np.diff(at)
    bits = 1 << np.maximum(int(np.log2(SKETCH_WORDS * 64)), np.ceil(np.log2(np.maximum(sizes, 1) * 4)).astype(np.int64))
    till = np.concatenate([[0], np.cumsum(bits)])
    rows = np.repeat(np.arange(len(sizes)), sizes)
    place = till[rows] + (code & (bits[rows] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.zeros(till[-1], np.uint8)
    np.bitwise_xor.at(odd, place, np.uint8(1))
    packed = np.packbits(odd, bitorder="little")
    return [packed[a // 8 : b // 8].tobytes() for a, b in zip(till[:-1].tolist(), till[1:].tolist(), strict=True)]


def apart(x: bytes, y: bytes) -> int:
    """Hamming distance of two wide sketches, the longer one folded to the shorter: at most the sets' difference."""
    x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def long_sketch(wide: bytes, n: int) -> np.ndarray | None:
    """A wide sketch folded to one to two bits per member, for sets that fill a sketch of SKETCH_WORDS."""
    if n <= SKETCH_WORDS * 64:
        return None
    words = np.frombuffer(wide, np.int64)
    while len(words) * 32 >= n:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def long_apart(x: F.Column, y: F.Column) -> F.Column:
    """Hamming distance of two long sketches, the longer one folded to the shorter; null where one is missing or more than twice as long."""
    size = F.least(F.size(x), F.size(y))

    def fold(z: F.Column) -> F.Column:
        halves = F.zip_with(F.slice(z, 1, size), F.slice(z, size + 1, size), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(z) == size, z).when(F.size(z) == 2 * size, halves)

    return F.aggregate(F.zip_with(fold(x), fold(y), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda total, v: total + v)


class NgramJoin:
    """Links between the word-shingle sets of `docs` that reach a Jaccard similarity, as components.

    `width` words make a shingle; two documents link when 100 * common >= percent * union.

    1. One pass gives (doc_id, node, n, sketch, wide), a node being a distinct set, so that copies
       count once from here on. A second gives the nodes' segment keys. Keys that repeat within
       a block of a task stay there with the block's first node as a star; only one row for
       a key and block is shuffled, so that no key, however common, meets in a task whole.
    2. Of each node's partners (the first and the previous node of its keys) that size and sketch
       allow, the one with the most common segments is verified; so is, at crowded keys, the
       allowed hub with the most common ones. A hub is the node of a key and size class that
       stands at most crowded keys. These links give components; a cluster of any size takes
       two verifications per node.
    3. What is left are pairs with an equal segment across components. Keys with several
       components go into groups by their hub, or by their first node where there is no crowd,
       so that two nodes with many common keys meet once. In each group, nodes outside its
       largest component are joined with all others. Where that takes over COMPARED comparisons a node,
       as with a passage that unlike texts share, nodes of the largest groups get finer segments, and meet by
       the rarest of them only: of k differences, k + 1 keys (see `Bands.fine_keys`), by hub where that is less. Sizes and sketches decide within
       the join, of long texts sketches of a bit a member, wide sketches after it, and what passes is verified. Only pairs near the limit are
       ever rows; Spark splits a large group's join by its two sides (adaptive skew join).
    4. Verification recomputes whole sets, of nodes that a filter of a fixed 8 MB lets through.
       A node with many partners, such as a hub, is dealt out with a part of them each.

    Every linked pair has an equal segment with members (see `Bands`), and one among its rarest finer
    ones, so it is verified or within a component already: components are exact, but for collisions of 64-bit hashes.

    Null and empty texts and those of white space only have no shingles and link with nothing.
    Rows with one id are one document's. Other columns are ignored. An empty table gives no rows.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85):
        self.rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
        self.width, self.percent, self.bands = width, percent, Bands(percent)

    def nodes(self) -> DataFrame:
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                code, at = shingle_sets(*text_bytes(batch.column("text")), width)
                sizes = np.diff(at)
                words = pa.FixedSizeListArray.from_arrays(pa.array(sketches(code, at).ravel()), SKETCH_WORDS).cast(pa.list_(pa.int64()))
                columns = [batch.column("doc_id"), pa.array(set_ids(code, at), mask=sizes == 0), pa.array(sizes, pa.int64()), words, pa.array(wide_sketches(code, at), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n", "sketch", "wide"])

        kind = self.rows.schema["doc_id"].dataType.simpleString()
        return self.rows.mapInArrow(run, f"doc_id {kind}, node long, n long, sketch array<long>, wide binary")

    def keys(self) -> DataFrame:
        """(at, node, key, via): a node at a key; or, with via, a node that met `via` at `key` in its own block."""
        width, bands = self.width, self.bands

        def stars(keys: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
            key, node = np.concatenate(keys), np.concatenate(nodes)
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node = key[new], node[new]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            via = node[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
            at = np.where(first, key, mix(key ^ mix(node.view(np.uint64)))).view(np.int64)
            order = np.argsort(node, kind="stable")  # equal nodes next to each other compress well
            at, node, key, via, first = (x[order] for x in (at, node, key, via, first))
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(node), pa.array(key.view(np.int64), mask=first), pa.array(via, mask=first)], ["at", "node", "key", "via"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, nodes, held, seen = [], [], 0, set()
            for batch in slices(batches, "text"):
                code, at = shingle_sets(*text_bytes(batch.column("text")), width)
                ids = set_ids(code, at)
                fresh = np.array([not (x in seen or seen.add(x)) for x in ids.tolist()], bool)
                if len(seen) > BLOCK_KEYS:
                    seen.clear()
                sizes = np.diff(at)
                code = code[np.repeat(fresh, sizes)]
                at = np.concatenate([[0], np.cumsum(np.where(fresh, sizes, 0))])
                key, owner = bands.keys(code, at)
                keys.append(key)
                nodes.append(ids[owner])
                held += len(key)
                if held >= BLOCK_KEYS:
                    yield stars(keys, nodes)
                    keys, nodes, held = [], [], 0
            if keys:
                yield stars(keys, nodes)

        return self.rows.select("text").mapInArrow(run, "at long, node long, key long, via long")

    def meetings(self) -> DataFrame:
        """(key, node, first, previous): nodes other than the first at keys that several nodes have."""
        order = Window.partitionBy("at").orderBy("node")
        met = self.keys().select(
            F.coalesce("key", "at").alias("key"),
            "node",
            "via",
            F.coalesce("via", F.min("node").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("first"),
            F.coalesce("via", F.lag("node").over(order)).alias("previous"),
        )
        return met.where("node != first AND node != previous").drop("via")

    def possible(self, n_a, n_b, sketch_a, sketch_b) -> F.Column:
        """Sizes and the Hamming distance of the sketches, which the difference can't be below, allow a link."""
        apart = sum((F.bit_count(sketch_a[i].bitwiseXOR(sketch_b[i])) for i in range(SKETCH_WORDS)), F.lit(0))
        near = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * self.percent
        return near & self.within(apart, n_a, n_b)

    def within(self, apart, n_a, n_b) -> F.Column:
        """Two sets of these sizes that differ in `apart` members at least can link."""
        return apart * (100 + self.percent) <= (n_a + n_b) * (100 - self.percent)

    def with_long(self, info: DataFrame) -> DataFrame:
        """(node, n, sketch, long): `info` with long sketches, null for small sets."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = [long_sketch(x.as_buffer(), n) for x, n in zip(batch.column("wide"), batch.column("n").to_pylist(), strict=True)]
                columns = [batch.column(x) for x in ("node", "n", "sketch")] + [pa.array(words, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "sketch", "long"])

        return info.select("node", "n", "sketch", "wide").mapInArrow(run, "node long, n long, sketch array<long>, long array<long>")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(node, members) of the wanted nodes, from whole texts; a few others pass the filter too."""
        width = self.width
        bits = wanted.select(F.shiftrightunsigned("node", 44).cast("int").alias("word"), F.expr("shiftleft(1L, cast(node & 63 as int))").alias("bit"))
        table = np.zeros(FILTER_WORDS, np.int64)
        for r in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():  # FILTER_WORDS rows at most
            table[r["word"]] = r["bits"]
        held = wanted.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = set()
            for batch in slices(batches, "text"):
                code, at = shingle_sets(*text_bytes(batch.column("text")), width)
                ids = set_ids(code, at)
                wide = ids.view(np.uint64)
                passes = (held.value[(wide >> np.uint64(44)).astype(np.int64)] >> (ids & 63)) & 1 == 1
                rows = [i for i in np.flatnonzero(passes & (np.diff(at) > 0)).tolist() if not (ids[i] in seen or seen.add(ids[i]))]
                if len(seen) > BLOCK_KEYS:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array([code[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary())], ["node", "members"])

        found = self.rows.select("text").mapInArrow(run, "node long, members binary")
        return found.groupBy("node").agg(F.first("members").alias("members"))

    def with_sets(self, pairs: DataFrame, sets: DataFrame, end: str) -> DataFrame:
        """`pairs` with the members of `end`; a node with many pairs gives its set once for each PAIRS_PER_PART of them."""
        parts = pairs.groupBy(end).agg(F.ceil(F.count("*") / PAIRS_PER_PART).cast("int").alias("parts"))
        many = parts.where("parts > 1")
        dealt = sets.toDF(end, f"members_{end}").join(many, end, "left")
        dealt = dealt.select(end, f"members_{end}", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        asked = pairs.join(many, end, "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        return asked.join(dealt, [end, "part"]).drop("part")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets reach the similarity."""
        percent = self.percent
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        both = self.with_sets(self.with_sets(pairs, sets, "a"), sets, "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "members_a"):
                keep = []
                for x, y in zip(batch.column("members_a"), batch.column("members_b"), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([batch.column(x).filter(pa.array(keep, pa.bool_())) for x in ("a", "b")], ["a", "b"])

        return both.mapInArrow(run, "a long, b long")

    def narrowed(self, pairs: DataFrame, info: DataFrame) -> DataFrame:
        """The pairs (a, b) whose wide sketches allow a link."""
        percent = self.percent
        facts = info.select("node", "n", "wide")
        both = pairs.select("a", "b").join(facts.toDF("a", "n_a", "wide_a"), "a").join(facts.toDF("b", "n_b", "wide_b"), "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
                far = np.array([apart(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("wide_a"), batch.column("wide_b"), strict=True)], np.int64)
                keep = pa.array(far * (100 + percent) <= total * (100 - percent))
                yield pa.RecordBatch.from_arrays([batch.column(x).filter(keep) for x in ("a", "b")], ["a", "b"])

        return both.mapInArrow(run, "a long, b long")

    def closest(self, pairs: DataFrame, facts: DataFrame) -> DataFrame:
        """Of each a the b that it meets most often, of those that size and sketch allow."""
        often = pairs.groupBy("a", "b").agg(F.count("*").alias("common"))
        often = often.join(facts.toDF("a", "n_a", "sketch_a"), "a").join(facts.toDF("b", "n_b", "sketch_b"), "b")
        allowed = often.where(self.possible(F.col("n_a"), F.col("n_b"), F.col("sketch_a"), F.col("sketch_b")))
        return allowed.groupBy("a").agg(F.max_by("b", F.struct("common", "b")).alias("b"))

    def crowds(self, met: DataFrame, members: DataFrame, facts: DataFrame) -> DataFrame:
        """(key, node, size, fame) of crowded keys: the node's size class and at how many such keys it stands."""
        crowded = met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= CROWD).select("key")
        found = shared_table(members.join(crowded, "key", "left_semi"), "crowds")
        fame = found.groupBy("node").agg(F.count("*").alias("fame")).join(facts, "node")
        size = F.floor(F.log("n") / float(np.log(100 / self.percent))).cast("int")
        return found.join(fame.select("node", size.alias("size"), "fame"), "node")

    def hub_pairs(self, crowds: DataFrame) -> DataFrame:
        """(a, b): members of crowded keys with the key's hubs of their own and the neighbouring size classes.

        A hub is the member of a class that stands at most crowded keys: near copies of one text
        differ from it less than from each other, and it shares most keys.
        """
        hubs = crowds.groupBy("key", "size").agg(F.max(F.struct("fame", "node")).alias("hub"))
        hubs = hubs.select("key", F.col("hub.node").alias("b"), F.explode(F.array(*(F.col("size") + i for i in (-1, 0, 1)))).alias("size"))
        return crowds.join(hubs, ["key", "size"]).select(F.col("node").alias("a"), "b").where("a != b")

    def groups(self, met: DataFrame, crowds: DataFrame, named: DataFrame) -> DataFrame:
        """(key, grp) of keys whose nodes are in several components: the crowd's hub, or the first node."""
        hubs = crowds.groupBy("key").agg(F.max(F.struct("fame", "node")).alias("hub"))
        firsts = met.groupBy("node", "first").agg(F.count("*").alias("keys"))
        across = firsts.join(named, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        across = across.join(named.toDF("first", "first_comp"), "first", "left").where(F.col("comp") != F.coalesce("first_comp", "first")).select("node", "first")
        mixed = met.join(across, ["node", "first"], "left_semi").groupBy("key").agg(F.min("first").alias("first"))
        return mixed.join(hubs, "key", "left").select("key", F.coalesce("hub.node", "first").alias("grp"))

    def rarest(self, wanted: DataFrame) -> DataFrame:
        """(grp, node): the keys of finer segments that a link of the wanted nodes can't do without, the rarest ones of each.

        How rare a key is comes from a table of 2**COUNTER_BITS counters by its leading bits, which has a
        fixed size. Any order of keys gives all links; this one leaves out passages that many texts share,
        if they fill less than about two thirds of the segments. Keys that one node alone has go in the
        shuffle that counts them. Of the nodes at a key in one slice of a task all but the first are known
        to share it, and are dealt elsewhere, so that no common key meets in a task whole.
        """
        bands = self.bands
        sets = shared_table(self.sets(wanted), "sets")

        def counter(key: np.ndarray) -> np.ndarray:
            return (key >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)

        def fine(batches: Iterator[pa.RecordBatch]):
            for batch in slices(batches, "members"):
                data, at = text_bytes(batch.column("members"))
                yield batch.column("node").to_numpy(), *bands.fine_keys(np.frombuffer(data.tobytes(), np.uint64), at // 8)

        def blocks(at: np.ndarray, table: np.ndarray) -> dict:
            return {"at": pa.array(at), "n": pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), COUNTER_BLOCK).cast(pa.list_(pa.int64()))}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(1 << COUNTER_BITS, np.int64)
            for _, key, *_ in fine(batches):
                table += np.bincount(counter(key), minlength=len(table))
            table = table.reshape(-1, COUNTER_BLOCK)
            at = np.flatnonzero(table.any(1))
            yield pa.RecordBatch.from_pydict(blocks(at, table[at]))

        def total(tasks: pa.Table) -> pa.Table:
            table = tasks.column("n").combine_chunks().flatten().to_numpy().reshape(-1, COUNTER_BLOCK)
            return pa.table(blocks(tasks.column("at").to_numpy()[:1], table.sum(0)))

        kind = "at long, n array<long>"
        counts = sets.mapInArrow(count, kind).groupBy("at").applyInArrow(total, kind).toArrow()  # 2**COUNTER_BITS numbers at most
        table = np.zeros(((1 << COUNTER_BITS) // COUNTER_BLOCK, COUNTER_BLOCK), np.int64)
        if counts.num_rows:
            table[counts["at"].to_numpy()] = counts["n"].combine_chunks().flatten().to_numpy().reshape(-1, COUNTER_BLOCK)
        held = wanted.sparkSession.sparkContext.broadcast(table.ravel())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for node, key, owner, band, needed in fine(batches):
                order = np.lexsort((key, held.value[counter(key)], band, owner))
                key, owner, band, needed = key[order], owner[order], band[order], needed[order]
                first = np.ones(len(key), bool)
                first[1:] = (owner[1:] != owner[:-1]) | (band[1:] != band[:-1])
                place = np.arange(len(key))
                keep = place - np.maximum.accumulate(np.where(first, place, 0)) < needed
                key, owner = key[keep], owner[keep]
                order = np.lexsort((owner, key))
                same = np.zeros(len(key), bool)
                same[1:] = key[order[1:]] == key[order[:-1]]
                again, shared = np.zeros(len(key), bool), np.zeros(len(key), bool)
                again[order] = same
                shared[order] = same | np.append(same[1:], False)
                at = np.where(again, mix(key ^ mix(node[owner].view(np.uint64))), key).view(np.int64)
                columns = [pa.array(at), pa.array(key.view(np.int64), mask=~again), pa.array(node[owner]), pa.array(shared)]
                yield pa.RecordBatch.from_arrays(columns, ["at", "key", "node", "shared"])

        found = sets.mapInArrow(run, "at long, key long, node long, shared boolean")
        found = found.withColumn("nodes", F.count("*").over(Window.partitionBy("at")))
        return found.where("shared OR nodes > 1").select(F.coalesce("key", "at").alias("grp"), "node")

    def crowding(self, held: DataFrame) -> DataFrame:
        """(grp, main, outside, total) of `held` (grp, node, comp): the largest component, nodes outside it, and all nodes."""
        sizes = held.groupBy("grp", "comp").agg(F.count("*").alias("held"))
        sizes = sizes.groupBy("grp").agg(F.max(F.struct("held", "comp")).alias("main"), F.sum("held").alias("total"))
        return sizes.select("grp", "main.comp", (F.col("total") - F.col("main.held")).alias("outside"), "total").withColumnRenamed("comp", "main")

    def heavy(self, sizes: DataFrame, nodes: int) -> DataFrame:
        """The crowded groups of `sizes` but for the smaller ones, which cost at most COMPARED comparisons for each of `nodes` together."""
        scale = F.floor(F.log2("outside")).cast("int")
        left, least = COMPARED * nodes, 64
        for r in sorted(sizes.groupBy(scale.alias("scale")).agg(compared().alias("work")).collect()):  # 63 rows at most
            left -= r["work"]
            if left < 0:
                least = r["scale"]
                break
        return sizes.where((F.col("outside") > OUTSIDE) & (scale >= least))

    def by_hub(self, finer: DataFrame) -> DataFrame:
        """`finer` (grp, node, comp) with crowded groups merged by their hub, the node in most of them: near copies meet once, not at each key."""
        crowded = self.crowding(finer).where(F.col("outside") > OUTSIDE).select("grp")
        held = shared_table(finer.join(crowded, "grp", "left_semi"), "crowds")
        fame = held.groupBy("node").agg(F.count("*").alias("fame"))
        hubs = held.join(fame, "node").groupBy("grp").agg(F.max(F.struct("fame", "node")).alias("hub")).select("grp", F.col("hub.node").alias("hub"))
        return finer.join(hubs, "grp", "left").select(F.coalesce("hub", "grp").alias("grp"), "node", "comp").distinct()

    def met_again(self, members: DataFrame, groups: DataFrame, named: DataFrame, nodes: int) -> DataFrame:
        """(grp, node, comp, main): what is to be compared, nodes outside a group's main component with all of the group.

        Where groups cost more than COMPARED comparisons for each of all `nodes`, the largest ones give way to groups
        by the rarest finer keys of their nodes, as they are or merged by hub, where these take fewer comparisons. Any way has every link.
        """
        held = members.join(groups, "key").select("grp", "node").distinct().join(named, "node", "left")
        held = shared_table(held.select("grp", "node", F.coalesce("comp", "node").alias("comp")), "members")
        sizes = shared_table(self.crowding(held).where("outside > 0"), "crowding")
        large = shared_table(self.heavy(sizes, nodes), "crowding")
        if large.isEmpty():
            return held.join(sizes.select("grp", "main"), "grp")
        wanted = held.join(large, "grp", "left_semi").select("node", "comp").distinct()
        finer = shared_table(self.rarest(wanted.select("node")).join(wanted, "node").select("grp", "node", "comp"), "finer")
        found = []
        for way in (finer, shared_table(self.by_hub(finer), "finer")):
            crowding = shared_table(self.crowding(way).where("outside > 0"), "crowding")
            found.append((crowding.select(compared().alias("work")).first()["work"] or 0, way, crowding))
        after, finer, finer_sizes = min(found, key=lambda x: x[0])
        if after >= large.select(compared().alias("work")).first()["work"]:
            return held.join(sizes.select("grp", "main"), "grp")
        small = sizes.join(large, "grp", "left_anti")
        return held.join(small.select("grp", "main"), "grp").union(finer.join(finer_sizes.select("grp", "main"), "grp"))

    def across(self, met: DataFrame, facts: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components of a group of `met`, that size and sketches allow; `facts` (node, n, sketch, long)."""
        held = shared_table(met.select("grp", "node", "comp", "main").join(facts, "node").select("grp", "node", "comp", "n", "sketch", "long", "main"), "members")
        a = held.where("comp != main").toDF("grp", *(f"{x}_a" for x in ("node", "comp", "n", "sketch", "long", "main")))
        b = held.drop("main").toDF("grp", *(f"{x}_b" for x in ("node", "comp", "n", "sketch", "long")))
        once = (F.col("comp_a") != F.col("comp_b")) & ((F.col("comp_b") == F.col("main_a")) | (F.col("node_a") < F.col("node_b")))
        allowed = self.possible(F.col("n_a"), F.col("n_b"), F.col("sketch_a"), F.col("sketch_b"))
        allowed &= F.coalesce(self.within(long_apart(F.col("long_a"), F.col("long_b")), F.col("n_a"), F.col("n_b")), F.lit(True))
        met = a.join(b, (a["grp"] == b["grp"]) & once & allowed)
        return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()

    def components(self) -> DataFrame:
        """One row per row of `docs`: doc_id, n_shingles, component_id, its smallest doc_id."""
        rows = shared_table(self.nodes(), "nodes")
        info = shared_table(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *(F.first(x).alias(x) for x in ("n", "sketch", "wide"))), "info")
        facts = info.select("node", "n", "sketch")
        met = shared_table(self.meetings(), "meetings")
        members = met.select("key", "node").union(met.select("key", F.col("first").alias("node"))).distinct()
        crowds = shared_table(self.crowds(met, members, facts), "crowds")
        pairs = met.select("node", "first").union(met.where("previous != first").select("node", "previous")).toDF("a", "b")
        best = self.closest(pairs, facts).union(self.closest(self.hub_pairs(crowds), facts)).distinct()
        links = shared_table(self.verified(shared_table(self.narrowed(best, info), "pairs")), "links")
        comps = components(links)

        left = self.across(self.met_again(members, self.groups(met, crowds, comps), comps, info.count()), self.with_long(info))
        more = shared_table(self.verified(shared_table(self.narrowed(left, info), "pairs")), "links")
        if not more.isEmpty():
            comps = components(links.union(more))

        named = info.select("node", "doc_id").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        smallest = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        by_node = named.join(smallest, "comp").select("node", "component_id")
        return rows.join(by_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each component, that with the smallest id: five words, a similarity of 0.8 or more.

    Null and empty texts link with nothing and stay, unless they share an id with a dropped
    row's component. Rows that share an id share its fate. Columns stay as they are, whatever
    their names. An empty table gives an empty one.
    """
    found = NgramJoin(docs, id_col, text_col, width, percent).components()
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return keep_only(docs, kept.select(F.col("doc_id").alias(id_col)).distinct(), id_col)
