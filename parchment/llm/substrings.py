"""Substring dedup by fixed-block anchors: aligned blocks indexed, probed by every rolling window, hits extended."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import INVERSE, MULTIPLIER, byte_codes, mix, powers, shared_table, slices, span_hashes, text_bytes

SLICE = 4 << 20
PER_BUCKET = 1 << 21  # words whose windows meet in one group, on average
NO_ID = np.iinfo(np.int64).max
CODES = byte_codes(41)
SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
RUN = np.dtype("<u4")


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of all rows end to end, and where each row's words begin."""
    data, at = text_bytes(column)
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
    end = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    return span_hashes(data, start, end, CODES), np.searchsorted(start, at)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of words[i : i + n] for each i, as differences of one running sum."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(words * powers(MULTIPLIER, len(words)), dtype=np.uint64)])
    return mix((total[n:] - total[:-n]) * powers(INVERSE, len(words) + 1)[: len(words) - n + 1])


def within_rows(at: np.ndarray, n: int) -> np.ndarray:
    """Starts of n words that lie in one row."""
    left = np.repeat(at[1:], np.diff(at)) - np.arange(at[-1])
    return np.flatnonzero(left >= n)


def new_values(*columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return new


def runs(held: np.ndarray) -> np.ndarray:
    """Starts and ends of the stretches of a mask, in turns."""
    return np.flatnonzero(np.diff(held.astype(np.int8), prepend=0, append=0)).astype(RUN)


def covered(starts: np.ndarray, size: int, total: int) -> np.ndarray:
    """Mask of `total` places that stretches of `size` from `starts` on cover."""
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + size, -1)
    return np.cumsum(step)[:total] > 0


def dealt(owner: np.ndarray, values: np.ndarray, n: int) -> list[bytes]:
    """The values of each of n owners as bytes; owners ascend."""
    cuts = np.searchsorted(owner, np.arange(n + 1))
    return [values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class BlockAnchors:
    """Windows of `window` words of `docs` that also stand in a document with a smaller id.

    1. Every document's aligned blocks of (window + 1) // 2 words are the index: a window of any
       document contains one of them whole, and whoever has the same window has that block at some
       place. Every rolling window of a block's size probes. Index and probes travel as packed
       bytes, about four and a half a word, to the bucket of their hash. A slice of rows sends each
       hash once, however often it has it, and tells its own repeats itself; so a passage that a
       third of all documents share sends one probe a slice. Buckets follow the number of words.
    2. Hashes of an aligned block that several slices have go back to the slices as hits. Each hit extends
       over all windows that contain it. Rows with hits meet their texts once by key, and these
       windows find their smallest document in the same packed way, by 128 bits of two halves;
       a slice decides its own repeats first and sends only its smallest document's windows.
    3. Neighbouring windows with a smaller document make the maximal repeats, as spans of words.

    Comparing by groups of windows instead of pair by pair costs the same for a passage of two documents as
    for one of all. Equal word sequences (by SHA-256) are found first: only the smallest id's is compared.
    24 bits of a hash within its bucket choose the hits, so a few hits are none; they change no result.

    Null and empty texts have no words. Rows of one id are one document's; a null id counts as the
    largest. Other columns are ignored, whatever their names. An empty table gives no rows.
    """

    def __init__(self, docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text"):
        if window < 2:
            raise ValueError("a window has two words at least")
        identity = docs[id_col].cast("long")
        self.rows = docs.select(F.xxhash64(identity, docs[text_col]).alias("key"), identity.alias("doc_id"), docs[text_col].alias("text"))
        self.window, self.block = window, (window + 1) // 2

    def facts(self) -> DataFrame:
        """(run, key, doc_id, n_words, digest) of every row; digest is that of the words joined by single spaces."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                words = [x.as_buffer().to_pybytes().split() if x.is_valid else [] for x in batch.column("text")]
                digests = [hashlib.sha256(b" ".join(x)).digest() for x in words]
                yield pa.RecordBatch.from_arrays([batch.column("run"), batch.column("key"), batch.column("doc_id"), pa.array(map(len, words), pa.int64()), pa.array(digests, pa.binary())], ["run", "key", "doc_id", "n_words", "digest"])

        return self.rows.withColumn("run", F.spark_partition_id()).mapInArrow(run, "run int, key long, doc_id long, n_words long, digest binary")

    def probes(self, buckets: int) -> DataFrame:
        """Rows for buckets: packed probes (hashes, aligned, gaps), and each slice's keys, word offsets and own repeats."""
        block = self.block
        names = ["bucket", "slice", "hashes", "aligned", "gaps", "keys", "at", "own"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", SLICE):
                words, at = word_hashes(batch.column("text"))
                place = within_rows(at, block)
                if not len(place):
                    continue
                gram = grams(words, block)[place]
                aligned = (place - at[np.searchsorted(at, place, "right") - 1]) % block == 0
                order = np.argsort(gram, kind="stable")
                first = np.flatnonzero(new_values(gram[order]))
                often = np.diff(np.append(first, len(gram)))
                aligned = np.maximum.reduceat(aligned[order], first)
                own = np.sort(place[order[np.repeat(often > 1, often)]])
                sent = order[first]
                by_place = np.argsort(sent)
                sent, aligned = sent[by_place], aligned[by_place]
                gram, place = gram[sent], place[sent]
                bucket = ((gram >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                keys = batch.column("key").to_numpy()
                name = int(np.bitwise_xor.reduce(mix(keys.view(np.uint64) * np.uint64(3) + np.arange(len(keys), dtype=np.uint64))).view(np.int64))
                out = [[name % buckets, name, None, None, None, keys.tobytes(), at.astype(RUN).tobytes(), own.astype(RUN).tobytes()]]
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    held = order[cuts[b] : cuts[b + 1]]
                    low = gram[held].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
                    gaps = np.diff(place[held], prepend=0).astype(RUN).view(np.uint8).reshape(-1, 4)
                    out.append([b, name, low.tobytes(), np.packbits(aligned[held]).tobytes(), gaps.T.tobytes(), None, None, None])
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        kept = self.rows.where("text IS NOT NULL").select("key", "text")
        return kept.mapInArrow(run, "bucket int, slice long, hashes binary, aligned binary, gaps binary, keys binary, at binary, own binary")

    def hits(self, buckets: int) -> DataFrame:
        """(key, spans): the window starts of rows to compare, as packed runs."""
        block, window = self.block, self.window

        def meet(table: pa.Table) -> pa.Table:
            tables = table.filter(table["keys"].is_valid())
            probes = table.filter(table["hashes"].is_valid())
            sizes = [len(x.as_buffer()) // 3 for x in probes["hashes"]]
            code = np.zeros((sum(sizes), 4), np.uint8)
            code[:, :3] = np.frombuffer(b"".join(x.as_buffer() for x in probes["hashes"]), np.uint8).reshape(-1, 3)
            code = code.view("<u4")[:, 0]
            aligned = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8))[:n].astype(bool) for x, n in zip(probes["aligned"], sizes, strict=True))])
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(new_values(code[order]))
            often = np.diff(np.append(first, len(code)))
            shared = np.zeros(len(code), bool)
            if len(code):
                shared[order] = np.repeat((often > 1) & np.maximum.reduceat(aligned[order], first), often)
            found, at = [], 0
            for x, n in zip(probes["gaps"], sizes, strict=True):
                place = np.cumsum(np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(4, n).T).view(RUN)[:, 0], dtype=np.int64)
                found.append(place[shared[at : at + n]].astype(RUN).tobytes())
                at += n
            some = pa.array([len(x) > 0 for x in found], pa.bool_())
            hits = pa.table({"slice": probes["slice"], "keys": pa.nulls(len(found), pa.binary()), "at": pa.nulls(len(found), pa.binary()), "places": pa.array(found, pa.binary())}).filter(some)
            return pa.concat_tables([pa.table({"slice": tables["slice"], "keys": tables["keys"], "at": tables["at"], "places": tables["own"]}), hits])

        def unfold(table: pa.Table) -> pa.Table:
            head = table.filter(table["keys"].is_valid()).slice(0, 1)
            keys, at = np.frombuffer(head["keys"][0].as_buffer(), np.int64), np.frombuffer(head["at"][0].as_buffer(), RUN).astype(np.int64)
            places = np.frombuffer(b"".join(x.as_buffer() for x in table["places"]), RUN).astype(np.int64)
            row = np.searchsorted(at, places, "right") - 1
            low = np.maximum(at[row], places - (window - block))
            high = np.minimum(at[row + 1] - window, places) + 1
            held = high > low
            step = np.zeros(at[-1] + 1, np.int64)
            np.add.at(step, low[held], 1)
            np.add.at(step, high[held], -1)
            asked = np.cumsum(step)[:-1] > 0
            rows = np.unique(row[held])
            out = [runs(asked[at[i] : at[i + 1]]).tobytes() for i in rows.tolist()]
            return pa.table({"key": pa.array(keys[rows]), "spans": pa.array(out, pa.binary())})

        met = self.probes(buckets).groupBy("bucket").applyInArrow(meet, "slice long, keys binary, at binary, places binary")
        found = met.groupBy("slice").applyInArrow(unfold, "key long, spans binary")
        return found.groupBy("key").agg(F.max("spans").alias("spans"))

    def repeats(self, asked: DataFrame, buckets: int) -> DataFrame:
        """(key, starts): packed starts of windows that a smaller document has; `asked` has key, doc_id, text, spans."""
        block, window = self.block, self.window
        names = ["bucket", "keys", "ids", "owner", "place", "first", "second"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", SLICE):
                words, at = word_hashes(batch.column("text"))
                half = grams(words, block)
                spans = [np.frombuffer(x.as_buffer(), RUN).astype(np.int64) + at[i] for i, x in enumerate(batch.column("spans"))]
                step = np.zeros(len(words) + 1, np.int64)
                for x in spans:
                    step[x[::2]] += 1
                    step[x[1::2]] -= 1
                place = np.flatnonzero(np.cumsum(step)[:-1] > 0)
                owner = np.searchsorted(at, place, "right") - 1
                a, b = half[place], half[place + window - block]
                ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
                keys = batch.column("key").to_numpy()
                order = np.lexsort((ids[owner], b, a))
                place, owner, a, b = place[order], owner[order], a[order], b[order]
                group = np.cumsum(new_values(a, b)) - 1
                first = np.flatnonzero(np.diff(group, prepend=-1))
                least = ids[owner][first][group] if len(first) else ids[:0]
                later = ids[owner] > least
                place -= at[owner]
                marked = np.lexsort((place[later], owner[later]))
                out = []
                if len(marked):
                    out.append([int(mix(a[:1] + np.uint64(len(a)))[0] % np.uint64(buckets)), keys.tobytes(), None, owner[later][marked].astype(RUN).tobytes(), place[later][marked].astype(RUN).tobytes(), None, None])
                place, owner, a, b = place[~later], owner[~later], a[~later], b[~later]
                bucket = ((a >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                order = np.lexsort((place, owner, bucket))
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for i in np.flatnonzero(np.diff(cuts)).tolist():
                    held = order[cuts[i] : cuts[i + 1]]
                    rows, which = np.unique(owner[held], return_inverse=True)
                    out.append([i, keys[rows].tobytes(), ids[rows].tobytes(), which.astype(RUN).tobytes(), place[held].astype(RUN).tobytes(), a[held].tobytes(), b[held].tobytes()])
                if out:
                    kinds = [pa.int32(), *[pa.binary()] * 6]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        def meet(table: pa.Table) -> pa.Table:
            def packed(name: str, kind) -> list[np.ndarray]:
                return [np.frombuffer(x.as_buffer(), kind) for x in asking[name]]

            told = table.filter(table["first"].is_null())
            asking = table.filter(table["first"].is_valid())
            keys, owners, places = packed("keys", np.int64), packed("owner", RUN), packed("place", RUN)
            base = np.cumsum([0, *map(len, keys)])
            key, ids, place = (np.concatenate([np.zeros(0, k), *x]) for k, x in ((np.int64, keys), (np.int64, packed("ids", np.int64)), (RUN, places)))
            owner = np.concatenate([np.zeros(0, np.int64), *(x.astype(np.int64) + n for x, n in zip(owners, base, strict=False))])
            a, b = (np.concatenate([np.zeros(0, np.uint64), *packed(x, np.uint64)]) for x in ("first", "second"))
            order = np.lexsort((ids[owner], b, a))
            group = np.cumsum(new_values(a[order], b[order])) - 1
            least = ids[owner[order]][np.flatnonzero(np.diff(group, prepend=-1))][group] if len(group) else ids
            later = np.zeros(len(a), bool)
            later[order] = ids[owner[order]] > least
            out_key, out = [], []
            for x, own, at in ((key, owner[later], place[later]), *((np.frombuffer(k.as_buffer(), np.int64), np.frombuffer(o.as_buffer(), RUN), np.frombuffer(p.as_buffer(), RUN)) for k, o, p in zip(told["keys"], told["owner"], told["place"], strict=True))):
                rows = np.unique(own)
                out_key.append(x[rows])
                out += [v for v in dealt(own, at, len(x)) if v]
            return pa.table({"key": pa.array(np.concatenate(out_key)), "starts": pa.array(out, pa.binary())})

        return asked.select("key", "doc_id", "text", "spans").mapInArrow(run, "bucket int, keys binary, ids binary, owner binary, place binary, first binary, second binary").groupBy("bucket").applyInArrow(meet, "key long, starts binary")

    def removed(self) -> DataFrame:
        """One row per row of `docs`: doc_id, n_words, n_removed, spans (of removed words: start and end), kept_sha256 (of kept words joined by single spaces)."""
        window = self.window
        facts = shared_table(self.facts(), "facts")
        words = facts.agg(F.sum("n_words")).first()[0] or 0
        buckets = max(8, -(-words // PER_BUCKET))
        parts = facts.where(F.col("n_words") >= window).groupBy("run", "digest").agg(F.min("doc_id").alias("least"))
        least = parts.groupBy("digest").agg(F.min("least").alias("least"))
        least = parts.select("run", "digest").join(least, "digest")
        facts = facts.join(least, ["run", "digest"], "left").withColumn("copy", F.col("least").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("least")))
        facts = shared_table(facts.drop("run", "least"), "facts")
        heads = facts.where(~F.col("copy") & (F.col("n_words") >= window)).select("key").distinct()
        hits = shared_table(self.hits(buckets).join(heads, "key", "left_semi"), "hits")
        asked = self.rows.join(hits, "key").groupBy("key").agg(*(F.first(x).alias(x) for x in ("doc_id", "text", "spans")))
        asked = shared_table(asked, "asked")
        starts = self.repeats(asked, buckets).groupBy("key").agg(F.collect_list("starts").alias("starts"))  # a key's starts are one document's

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                counts, spans, digests = [], [], []
                for text, starts in zip(batch.column("text"), batch.column("starts"), strict=True):
                    held = text.as_buffer().to_pybytes().split()
                    at = np.frombuffer(b"".join(starts.as_py()), RUN).astype(np.int64)
                    ends = runs(covered(at, window, len(held))).tolist()
                    kept, last = [], 0
                    for a, b in zip(ends[::2], ends[1::2], strict=True):
                        kept += held[last:a]
                        last = b
                    kept += held[last:]
                    counts.append(len(held) - len(kept))
                    spans.append([{"start": a, "end": b} for a, b in zip(ends[::2], ends[1::2], strict=True)])
                    digests.append(hashlib.sha256(b" ".join(kept)).digest())
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(counts, pa.int64()), pa.array(spans, SPANS), pa.array(digests, pa.binary())], ["key", "gone", "gone_spans", "kept"])

        done = asked.select("key", "text").join(starts, "key").mapInArrow(cut, "key long, gone long, gone_spans array<struct<start:int,end:int>>, kept binary")
        whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
        digest = F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.coalesce("kept", "digest"))))
        return facts.join(done, "key", "left").select(
            "doc_id",
            "n_words",
            F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0).cast("long"))).alias("n_removed"),
            F.when(F.col("copy"), whole).otherwise(F.coalesce("gone_spans", F.array().cast("array<struct<start:int,end:int>>"))).alias("spans"),
            digest.alias("kept_sha256"),
        )


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
