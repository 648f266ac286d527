"""Substring dedup, whole and by its parts, against every window of every document."""

import hashlib
import random
import re

import numpy as np
import pytest

from parchment.llm import queries, substrings
from parchment.llm.substrings import BlockAnchors, covered, grams, runs, within_rows


def brute(rows, window):
    held = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())) for i, text in rows]
    least = {}
    for i, words in held:
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    out = []
    for i, words in held:
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            first = least.get(tuple(words[p : p + window]))
            if first is not None and (i is None or first < i):
                gone[p : p + window] = [True] * window
        kept = b" ".join(x for x, y in zip(words, gone, strict=True) if not y)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def results(docs, window):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in BlockAnchors(docs, window).removed().collect()), key=str)


def test_query_against_every_window(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = brute(rows, 50)
    got = queries.QUERIES["op11_substring_dedup"](spark, folder)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(x[2] for x in want) > 5000


@pytest.mark.parametrize("window", [2, 3, 6, 9])
def test_small_windows_over_two_letter_words(spark, window):
    rng = random.Random(window)
    rows = [(None, "a b a b b a"), (None, "a b a b b a"), (3, None), (4, ""), (4, " \t "), (7, "x " * 300), (7, "x " * 300), (9, "x " * 30), (-5, "a b a b\na\x0bb")]
    rows += [(rng.randrange(40), " ".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert results(docs.repartition(5), window) == brute(rows, window)


def test_passage_of_a_third_of_all_documents_in_small_slices(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE", 400)
    rng = random.Random(8)

    def words(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    passage, short = words(14), words(8)
    rows = [(i, f"{words(rng.randrange(5))} {passage if i % 3 == 0 else short} {words(rng.randrange(5))}") for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert results(docs, 10) == brute(rows, 10)
    spans = {r.doc_id: [tuple(x) for x in r.spans] for r in BlockAnchors(docs, 10).removed().collect()}
    assert spans[0] == spans[1] == [] and all(len(spans[i]) == 1 and spans[i][0][1] - spans[i][0][0] >= 14 for i in range(3, 120, 3))
    assert spans[200] == [(0, len(rows[0][1].split()))]


def test_empty_table_very_long_text_and_clashing_columns(spark):
    assert BlockAnchors(spark.createDataFrame([], "doc_id long, text string")).removed().count() == 0
    long = " ".join(str(i * 7919 % 100003) for i in range(60_000))
    rows = [(1, long, 9), (2, "head " + long[100:] + " tail", 9), (3, "none of it", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long").selectExpr("doc_id", "text", "key", "key as digest", "key as run", "key as spans")
    assert results(docs, 50) == brute([x[:2] for x in rows], 50)


def test_parts():
    words = np.arange(1, 8, dtype=np.uint64)
    twice = np.concatenate([words, words])
    g = grams(twice, 3)
    assert len(g) == 12 and (g[:5] == g[7:]).all() and len(set(g[:7].tolist())) == 7
    assert grams(words, 9).size == 0
    assert within_rows(np.array([0, 2, 2, 7]), 3).tolist() == [2, 3, 4]
    assert runs(np.array([True, False, True, True])).tolist() == [0, 1, 2, 4]
    assert covered(np.array([1, 2, 6]), 2, 9).tolist() == [False, True, True, True, False, False, True, True, False]
