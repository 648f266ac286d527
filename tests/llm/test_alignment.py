"""Alignment of two tokenizers against groups cut by hand and counts over all documents."""

import hashlib
import inspect
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from parchment.llm import alignment, queries
from parchment.llm.alignment import align_tokenizers, aligned, groups_of, linked, packed, two_tokenizers, unpacked, unpacked_pairs


def grouped(text):
    """Groups of a text by both libraries over the whole text."""
    if not text:
        return []
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")) if not hasattr(grouped, "a") else grouped.a
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")) if not hasattr(grouped, "b") else grouped.b
    grouped.a, grouped.b = a, b
    letters = alignment.byte_letters()
    sides = []
    for ids, bytes_of in (
        (a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(letters[c] for c in a.id_to_token(i))),
        (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()),
    ):
        parts = [bytes_of(i) for i in ids]
        if b"".join(parts) != (" " + text).encode():
            return []
        sides.append((ids, np.cumsum([len(x) for x in parts]).tolist()))
    (ids_a, ends_a), (ids_b, ends_b) = sides
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        out.append((ids_a[i:x], ids_b[j:y]))
        i, j = x, y
    return out


def brute(rows):
    docs = [(i, grouped(text)) for i, text in rows]
    counts = Counter()
    for _, groups in docs:
        counts.update({(a, b) for x, y in groups for a in x for b in y})
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for i, groups in docs:
        links = [(a, b) for x, y in groups for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sizes = [sum(len(g[k]) for g in groups) for k in (0, 1)]
        out.append((i, *sizes, len(groups), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


ODD = [
    (None, "a b"), (1, None), (1, ""), (2, " "), (3, "  a   b \n\n c\t d "), (4, "▁x y"), (5, "é é 日本 語 ½"), (6, "<s> </s> <|endoftext|> it's we'll  'll"),
    (7, "\x00 a\r\n b"), (8, "a" * 3000), (9, "x1 " * 900 + "y"), (10, "  a　 b. c"), (11, "😀 😀😀 👩‍👩‍👧"), (12, "\n a\n b !? ...   !"), (2, "Hello world"), (2, "Hello world"), (13, "1234567 89 3.14 -- __init__ 'S"),
]


def test_query_against_whole_texts(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.QUERIES["op12_tokenizer_alignment"](spark, folder)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_odd_texts_and_counts_in_pieces(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in ODD], "doc_id long, text string, n_a int").withColumnRenamed("n_a", "pairs").repartition(3)
    want = brute(ODD)
    for piece in (alignment.PIECE, 20):
        assert sorted((tuple(r) for r in align_tokenizers(docs, piece=piece).collect()), key=str) == want
    assert align_tokenizers(docs.limit(0)).count() == 0


def test_groups_as_text(spark):
    docs = spark.createDataFrame([(1, "Hello wörld")], "doc_id long, text string")
    want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in grouped("Hello wörld"))
    assert aligned(docs, keep_groups=True).first()["groups"] == want


def test_overlaps_come_from_as_of_joins_in_both_directions():
    assert inspect.getsource(alignment.covering).count("pd.merge_asof") == 1
    a = pd.DataFrame({"doc": [0, 0, 0, 1], "start": [0, 2, 5, 9], "end": [2, 5, 9, 12], "number": range(4)})
    b = pd.DataFrame({"doc": [0, 0, 0, 1, 1], "start": [0, 1, 5, 9, 10], "end": [1, 5, 9, 10, 12], "number": range(5)})
    x, y = groups_of(a, b)
    assert x.tolist() == [0, 0, 1, 2] and y.tolist() == [0, 0, 1, 2, 2]
    key, links = linked([np.array([7, 7, 8, 9]), np.array([1, 2, 1, 3, 3])], [x, y], np.array([0, 0, 1]))
    assert [(k >> 32, k >> 16 & 0xFFFF, k & 0xFFFF) for k in key.tolist()] == [(0, 7, 1), (0, 7, 2), (0, 8, 1), (1, 9, 3)] and links.tolist() == [2, 2, 1, 2]


def test_packed_pairs_round_trip():
    rows = [np.array([3, 9, 2**31]), np.zeros(0, np.int64), np.array([5])]
    cells = [packed(x, np.arange(1, len(x) + 1)) for x in rows]
    pairs, at = unpacked_pairs(pa.array([x for x, _ in cells], pa.binary()))
    links, _ = unpacked(pa.array([x for _, x in cells], pa.binary()))
    assert pairs.tolist() == [3, 9, 2**31, 5] and at.tolist() == [0, 3, 3, 4] and links.tolist() == [1, 2, 3, 1]


def test_table_of_units_is_emptied_and_filled_again():
    both = alignment.TwoTokenizers("byte_bpe_50k.json", "piece_bpe_32k.model", most=3)
    for text in ("one two three", "four five six seven", "one two three"):
        data, at, _ = alignment.with_space(pa.array([text]))
        _, row, (first, count) = both.encode(data, at)
        ids = both.ids[0][alignment.spread(first[0], count[0])].tolist()
        assert ids == both.a.encode(" " + text, add_special_tokens=False).ids and both.b.encode(text) == both.ids[1][alignment.spread(first[1], count[1])].tolist()
    assert two_tokenizers("byte_bpe_50k.json", "piece_bpe_32k.model").cuts


def test_new_units_are_encoded_in_runs():
    both, given = alignment.TwoTokenizers("byte_bpe_50k.json", "piece_bpe_32k.model"), []

    class Counted:
        def __init__(self, of):
            self.of = of

        def encode_batch_fast(self, texts, **more):
            given.extend(texts)
            return self.of.encode_batch_fast(texts, **more)

    words = [f" w{i}" for i in range(2000)] + ["  two", " don't", " x<|endoftext|>", " ü.", " <unk>x", " [UNK]!", " ▁a", " a▁b", " \t)", " ​z"]
    odd = [" Straße\n", " ", "  ", " 日本語", " é", " a▁"]
    units = [x.encode() for x in words + odd]
    alone = both.apart(units)
    both.a = Counted(both.a)
    both.learn(units, np.arange(len(units), dtype=np.uint64))
    assert len(given) < len(units) / 10
    assert both.right.tolist() == alone[2].tolist()
    for side in (0, 1):
        ends = np.cumsum(alone[1][side])
        one = [x.tolist() for x in np.split(alone[0][side], ends[:-1])]
        assert [both.ids[side][a : a + n].tolist() for a, n in zip(both.first[side], both.count[side])] == one
    only = alignment.TwoTokenizers("byte_bpe_50k.json", "piece_bpe_32k.model")
    only.learn([x.encode() for x in odd], np.arange(len(odd), dtype=np.uint64))
    assert only.right.tolist() == alone[2][len(words) :].tolist()
