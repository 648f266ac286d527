"""Language ID by error-correcting output codes over binary byte n-gram classifiers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.llm.common import id_crc32, keep_only, row_sums, shared_table, slices, text_bytes

UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
SLOTS = 1 << 15
SLICE, BLOCK = 1 << 19, 1 << 17
LETTERS = np.arange(256, dtype=np.uint8)
LETTERS[65:91] += 32
LETTERS[[i for i in range(128) if not chr(i).isalpha()]] = 32


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A -1/+1 row for each of n languages. Up to five: all different splits; else random ones far apart."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1 if i == 0 or split >> (i - 1) & 1 else -1 for split in range(2 ** (n - 1) - 1)] for i in range(n)], float)
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(n)))
    best, apart = np.zeros((0, bits)), -np.inf
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code[0, np.abs(code.sum(0)) == n] *= -1  # a bit that is equal for all tells nothing
        nearest = ((bits - code @ code.T) / 2 + np.eye(n) * bits).min()
        if nearest > apart:
            best, apart = code, nearest
    return best


def gram_slots(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the slot of each n-gram within a row, and its row, rows ascending."""
    data = LETTERS[data]
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    keep = np.ones(len(data), bool)  # white space and marks count once, not in runs
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (row[1:] != row[:-1])
    data, row = data[keep], row[keep]
    code = np.zeros(len(data), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        m = len(data) - n + 1
        if m <= 0:
            return
        code = code[:m] * np.uint32(0x01000193) ^ data[n - 1 :]
        if n in ORDERS:
            whole = row[:m] == row[n - 1 :]
            mixed = (code[whole] ^ np.uint32(n * 0x1B873593 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            yield mixed >> np.uint32(17), row[:m][whole]


def has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each row has a letter of any alphabet."""
    ascii_letter = (data | 0x20) - np.uint8(97) < 26
    out = row_sums(ascii_letter.astype(np.float64), at) > 0
    for i in np.flatnonzero(~out & (np.diff(at) > 0)):
        out[i] = any(map(str.isalpha, data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


class LanguageModel:
    """Weights of one binary classifier for each bit, and the codewords that name languages."""

    def __init__(self, languages: list[str], counts: np.ndarray | None = None, smoothing: float = 0.5, reach: float = 48.0):
        self.languages, self.reach, self.smoothing = languages, reach, smoothing
        self.code = codewords(len(languages))
        self.weights = np.zeros((SLOTS, self.code.shape[1]), np.float32)
        self.trust = np.ones(self.code.shape[1])
        if counts is not None:
            self.learn((i, slot, counts[i, slot]) for i, slot in zip(*np.nonzero(counts), strict=True))

    def learn(self, counts: Iterable[tuple[int, int, float]]) -> None:
        """Weights of all bits from (language, slot, count), languages together; holds one language's counts at a time."""
        one, zero = (np.full((SLOTS, self.code.shape[1]), self.smoothing) for _ in range(2))
        for i, rows in groupby(counts, key=itemgetter(0)):
            slots, held = np.array([x[1:] for x in rows], float).T
            slots = slots.astype(int)
            for side, total in ((1, one), (-1, zero)):
                total[np.ix_(slots, self.code[i] == side)] += held[:, None]
        told = (self.code == -1).any(0)
        self.weights[:, told] = (np.log(one / one.sum(0)) - np.log(zero / zero.sum(0)))[:, told]

    def margins(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean log odds per n-gram of each row and bit."""
        sums, n = np.zeros((len(at) - 1, self.weights.shape[1])), np.zeros(len(at) - 1, np.int64)
        for slots, rows in gram_slots(data, at):
            n += np.bincount(rows, minlength=len(n))
            for i in range(0, len(slots), BLOCK):
                of = rows[i : i + BLOCK]
                start = np.flatnonzero(np.diff(of, prepend=-1))
                sums[of[start]] += np.add.reduceat(self.weights[slots[i : i + BLOCK]], start, axis=0, dtype=np.float64)
        return sums / np.maximum(n, 1)[:, None] * np.minimum(n, self.reach)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword by loss, its share of the likelihood, and the share of the runner-up."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ (self.trust / self.trust.sum())
        like = np.exp(loss.min(1, keepdims=True) - loss) ** 4
        share = like / like.sum(1, keepdims=True)
        best = share.argmax(1)
        first = share[np.arange(len(share)), best]
        share[np.arange(len(share)), best] = 0
        return best, first, share.max(1) if share.shape[1] > 1 else np.zeros(len(share))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_language: int = 2000, held_out_mod: int = 3, held_out_rest: int = 1) -> LanguageModel:
    """Fit on about `sample_per_language` rows of each language outside the held-out rows; there may be any number of languages.

    The sample, a documented bound, takes rows by a hash of their id, at the rate bound / rows of the language, which each
    row gets by a join. Its n-gram counts are summed by Spark, as rows of the slots a language has; the driver takes them
    language by language and keeps sums for each bit, of which there are ten times the logarithm of the languages.
    A second pass over the sample gives each bit a weight from the share of rows it gets right.
    """
    named = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    named = named.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_crc32(F.col("id")) % held_out_mod != held_out_rest))
    sizes = shared_table(named.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = sorted(r["lang"] for r in sizes.select("lang").toLocalIterator())
    if not languages:
        return LanguageModel([], np.zeros((0, SLOTS)))
    rate = sample_per_language / F.col("n")
    sample = named.join(sizes, "lang").where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20) < rate).select("text", "lang")
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            total = {i: np.zeros(SLOTS, np.int64) for i in set(lang.tolist())}
            for slots, rows in gram_slots(*text_bytes(batch.column("text"))):
                of = lang[rows]
                for i, held in total.items():
                    held += np.bincount(slots[of == i], minlength=SLOTS)
            for i, held in total.items():
                used = np.flatnonzero(held)
                yield pa.RecordBatch.from_arrays([pa.array(i * SLOTS + used), pa.array(held[used])], ["slot", "n"])

    model = LanguageModel(languages)
    counts = sample.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).orderBy("slot")
    model.learn((r["slot"] // SLOTS, r["slot"] % SLOTS, r["n"]) for r in counts.toLocalIterator())

    def right_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, n = np.zeros(model.code.shape[1]), 0
        for batch in slices(batches, "text", SLICE):
            margins = model.margins(*text_bytes(batch.column("text")))
            truth = model.code[[number[x] for x in batch.column("lang").to_pylist()]]
            right += (margins * truth > 0).sum(0)
            n += len(margins)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(right)), pa.int32()), pa.array(right), pa.array([n] * len(right), pa.int64())], ["bit", "right", "n"])

    seen = sample.mapInArrow(right_bits, "bit int, right double, n long").groupBy("bit").agg(F.sum("right").alias("right"), F.sum("n").alias("n"))
    for r in seen.collect():
        share = min(max((r["right"] + 1) / (r["n"] + 2), 0.51), 0.999)
        model.trust[r["bit"]] = np.log(share / (1 - share))
    return model


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", least_gap: float = 0.1) -> DataFrame:
    """One row per row of `docs`: doc_id, lang_pred, score, runner_up, ambiguous.

    The score is the likelihood share of the nearest codeword under the bits' logistic losses;
    `ambiguous` says that the runner-up's share is within `least_gap`. Null texts and those
    without any letter, or with no learned language, are `und` with score 0, not ambiguous. One
    pass over whole texts without a shuffle; the model's size doesn't depend on the data's.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(x, t) for x, t in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("runner_up", T.DoubleType()), ("ambiguous", T.BooleanType())))]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in slices(batches, "text", SLICE):
            data, at = text_bytes(batch.column("text"))
            known = has_letter(data, at) & bool(model.languages)
            best, first, second = model.decode(model.margins(data, at)) if model.languages else (np.zeros(len(known), int), np.zeros(len(known)), np.zeros(len(known)))
            best = np.where(known, best, len(model.languages))
            first, second = np.where(known, first, 0.0), np.where(known, second, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(np.clip(first, 0, 1)), pa.array(second), pa.array(known & (first - second < least_gap))],
                ["doc_id", "lang_pred", "score", "runner_up", "ambiguous"],
            )

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(predict, T.StructType(fields))


def reject_unknown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`docs` without rows whose text has no language: `und`, or so ambiguous that two codewords are equally near.

    Null and empty texts and those without a letter go; rows with the id of a kept row stay,
    repeats included. Columns stay as they are, whatever their names. An empty table gives an empty one,
    and so does one without any named language to learn from.
    """
    found = identify(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous"))
    return keep_only(docs, kept.select(F.col("doc_id").alias(id_col)).distinct(), id_col)
