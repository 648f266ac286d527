"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.llm.common import byte_codes, id_crc32, mix, row_sums, slices, span_hashes, text_bytes

BITS = 18
BIAS = 0
CODES = byte_codes(97)
# Byte classes: white space 0, letters and bytes of longer characters 1, digits 2, marks 3.
CLASS = np.array([0 if b in b" \t\n\v\f\r" else 1 if b >= 128 or chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)


def word_grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of word unigrams and bigrams, and the row of each.

    Words are runs of letters, of digits or of marks, with their case. A pair of the same word
    twice is one shared feature, whatever the word.
    """
    kind = CLASS[data]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[at[:-1][at[:-1] < len(data)]] = True
    start = np.flatnonzero(new[:-1])
    end = np.append(start[1:], len(data)) if len(start) else start
    held = kind[start] != 0
    start, end = start[held], end[held]
    row = np.searchsorted(at, start, "right") - 1
    one = span_hashes(data, start, end, CODES)
    two = mix(one[:-1] * np.uint64(3) + one[1:])
    two[one[1:] == one[:-1]] = 7
    whole = row[1:] == row[:-1]
    two_rows = row[1:][whole]
    slots = np.concatenate([one, two[whole]]) >> np.uint64(64 - BITS)
    slots[slots == BIAS] = 1
    rows = np.concatenate([row, two_rows])
    order = np.argsort(rows, kind="stable")
    return slots[order].astype(np.int64), rows[order]


def ftrl(rows: Iterator[tuple[np.ndarray, np.ndarray, int]], alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights after one follow-the-regularised-leader pass over (slots, values, label)."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for slots, values, label in rows:
        w = weights(slots)
        g = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
        sigma = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / alpha
        z[slots] += g - sigma * w
        n[slots] += g * g
    return weights(slice(None))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = 12000,
    learners: int = 4,
    passes: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.1,
    held_out_mod: int = 5,
    held_out_rest: int = 0,
) -> np.ndarray:
    """Weights by hashed slot, fitted on about `sample` labelled rows (a documented bound) outside the held-out ones.

    Rows are taken by a hash of their id at the rate bound / labelled rows. `learners` tasks
    each run FTRL over their share, in the order of the hash, `passes` times; their weights are
    averaged. Rows with null label are not used. Without labelled rows all weights are 0.
    """
    known = labels.select(labels[id_col].alias("id"), labels[label_col].alias("label"))
    known = known.where(F.col("label").isNotNull() & (id_crc32(F.col("id")) % held_out_mod != held_out_rest)).withColumn("h", F.xxhash64("id", F.lit("fit")))
    known = known.groupBy("id", "h").agg(F.max("label").cast("int").alias("label"))
    rows = known.count()
    if not rows:
        return np.zeros(1 << BITS)
    known = known.where(F.pmod("h", F.lit(1 << 20)) < sample / rows * (1 << 20))
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    fit = texts.join(F.broadcast(known), "id").withColumn("learner", F.pmod(F.shiftright("h", 20), F.lit(learners)).cast("int"))  # `sample` rows at most

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "id"])
        examples = []
        for text, label in zip(group["text"], group["label"], strict=True):
            data = np.frombuffer((text or "").encode(), np.uint8)
            slots, counts = np.unique(word_grams(data, np.array([0, len(data)]))[0], return_counts=True)
            values = counts / np.sqrt(max(counts.sum(), 1))
            examples.append((np.append(slots, BIAS), np.append(values, 1.0), label))
        w = ftrl((x for _ in range(passes) for x in examples), alpha, beta, l1, l2)
        used = np.flatnonzero(w)
        return pd.DataFrame({"slot": used, "w": w[used]})

    weights = np.zeros(1 << BITS)
    summed = fit.groupBy("learner").applyInPandas(learn, "slot long, w double").groupBy("slot").agg(F.sum("w").alias("w"))
    for r in summed.toLocalIterator():  # 2**BITS rows at most
        weights[r["slot"]] = r["w"] / learners
    return weights


def score_quality(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of `docs`: doc_id, score, predicted.

    The score is the logistic of the sparse dot product of weights and n-gram counts over the root
    of their number. Null and empty texts get the bias alone. Rows are independent; other
    columns are ignored. One pass over whole texts without a shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in slices(batches, "text"):
            data, at = text_bytes(batch.column("text"))
            slots, rows = word_grams(data, at)
            cuts = np.searchsorted(rows, np.arange(len(at)))
            total = row_sums(w[slots], cuts) / np.sqrt(np.maximum(np.diff(cuts), 1)) + w[BIAS]
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(score, T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
