"""Language ID, quality and sharding against brute force and held-out truth; odd tables."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from parchment.llm import language_id, quality
from parchment.llm.common import text_bytes
from parchment.llm.queries import QUERIES
from parchment.llm.sharding import interleaved_shards

DOCS = "/root/testdata/sf0.01"


def auc(scores, truth):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    pos = sum(truth)
    return (ranks[np.array(truth, bool)].sum() - pos * (pos + 1) / 2) / (pos * (len(truth) - pos))


def held(doc_id, mod, rest):
    return zlib.crc32(str(doc_id).encode()) % mod == rest


def test_held_out_languages_are_right(spark):
    got = {r["doc_id"]: r for r in QUERIES["op1_language_id"](spark, DOCS).collect()}
    rows = [r for r in spark.read.parquet(f"{DOCS}/documents.parquet").collect() if r["lang"] and held(r["doc_id"], 3, 1) and got[r["doc_id"]]["lang_pred"] != "und"]
    assert len(rows) > 200 and all(got[r["doc_id"]]["held_out"] for r in rows)
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows) >= 0.98 * len(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 12, 60])
def test_codewords_are_apart(n):
    code = language_id.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1.0, 1.0}
    if n > 1:
        apart = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
        assert apart >= (1 if n == 2 else code.shape[1] / 4) and all(abs(code.sum(0)) < n)


def test_decoding_is_the_plain_nearest_codeword():
    rng, model = np.random.default_rng(2), language_id.LanguageModel(list("abcdefg"), np.ones((7, language_id.SLOTS)))
    model.trust = rng.uniform(0.1, 3, model.code.shape[1])
    margins = rng.normal(0, 2, (200, model.code.shape[1]))
    best, first, second = model.decode(margins)
    for m, b, p, q in zip(margins, best, first, second):
        loss = [sum(t * np.log1p(np.exp(-x * c)) for x, c, t in zip(m, word, model.trust)) / model.trust.sum() for word in model.code]
        like = sorted((np.exp(-4 * (x - min(loss))) for x in loss), reverse=True)
        assert b == int(np.argmin(loss)) and p == pytest.approx(like[0] / sum(like)) and q == pytest.approx(like[1] / sum(like))


def test_mixed_texts_are_ambiguous(spark):
    words = {"xx": "alpha beta gamma delta", "yy": "ßig über ächt möge"}
    rows = [(i, words[k], k) for i, k in enumerate(["xx", "yy"] * 60)] + [(900, "q z q z", None), (901, words["xx"] + " " + words["yy"], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(docs, language_id.train(docs)).collect()}
    assert not got[0]["ambiguous"] and not got[1]["ambiguous"] and got[0]["score"] > 0.9
    far = {r["doc_id"]: r for r in language_id.identify(docs, language_id.train(docs), least_gap=1.0).collect()}
    assert far[901]["ambiguous"] and far[901]["score"] + far[901]["runner_up"] == pytest.approx(1)


def test_an_even_mix_of_two_languages_is_ambiguous_at_the_production_gap(spark):
    rng = random.Random(5)
    words = {"xx": ["alpha", "beta", "gamma", "delta"], "yy": ["ßig", "über", "ächt", "möge"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(20)), k) for i, k in enumerate(["xx", "yy"] * 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)

    def margin(text):
        return float(model.margins(*text_bytes(pa.array([text])))[0, 0])

    texts, side = ["alpha"], margin("alpha") > 0
    for _ in range(300):  # always a word of the language that is behind
        texts.append(texts[-1] + " " + rng.choice(words["yy" if (margin(texts[-1]) > 0) == side else "xx"]))
    even = min(texts, key=lambda x: abs(margin(x)))
    mixes = spark.createDataFrame([(901, even, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(docs.union(mixes), model).collect()}
    assert [k for k, r in got.items() if r["ambiguous"]] == [901]
    assert abs(got[901]["score"] - got[901]["runner_up"]) < 0.1


def test_any_number_of_languages_is_learned(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:03d}": ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(12)] for i in range(300)}
    rows = [(1000 * n + i, " ".join(rng.choice(held) for _ in range(25)), lang) for n, (lang, held) in enumerate(words.items()) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.languages == sorted(words)
    truth = {i: lang for i, _, lang in rows}
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()}
    assert sum(got[i] == truth[i] for i in out) >= 0.95 * len(out) > 500


def test_counts_learned_language_by_language_are_the_plain_sums():
    counts = np.random.default_rng(1).integers(0, 3, (7, language_id.SLOTS)).astype(float)
    model = language_id.LanguageModel(list("abcdefg"), counts)
    for bit in (0, 3, model.code.shape[1] - 1):
        one, zero = (counts[model.code[:, bit] == side].sum(0) + 0.5 for side in (1, -1))
        assert np.allclose(model.weights[:, bit], np.log(one / one.sum()) - np.log(zero / zero.sum()), atol=1e-5)


def plain_ftrl(examples, passes, alpha, beta, l1, l2):
    """The update rule one coordinate at a time."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(passes):
        for slots, values, label in examples:
            w = [weight(i) for i in slots]
            p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, values))))
            for i, x, wi in zip(slots, values, w):
                g = (p - label) * x
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / alpha * wi
                n[i] = before + g * g
    return {i: weight(i) for i in z}


def test_training_is_plain_ftrl():
    rng = np.random.default_rng(4)
    examples = [(np.unique(rng.integers(1, 50, 8)), None, int(rng.random() < 0.4)) for _ in range(120)]
    examples = [(np.append(s, 0), np.append(rng.uniform(0.1, 1, len(s)), 1.0), y) for s, _, y in examples]
    got = quality.ftrl((x for _ in range(3) for x in examples), 0.5, 1.0, 0.02, 0.1)
    want = plain_ftrl(examples, 3, 0.5, 1.0, 0.02, 0.1)
    assert all(got[i] == pytest.approx(w) for i, w in want.items()) and np.count_nonzero(got) == sum(w != 0 for w in want.values())


def test_scores_are_plain_dot_products(spark):
    rng = np.random.default_rng(5)
    weights = rng.normal(0, 1, 1 << quality.BITS)
    texts = ["One two two, 3!", "", None, "long " * 70000 + "end.", "Ünïcode é日本 日本", "One two two, 3!"]
    got = [(r["doc_id"], r["score"], r["predicted"]) for r in quality.score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), weights).orderBy("doc_id").collect()]
    for (_, score, predicted), text in zip(got, texts):
        data, at = text_bytes(__import__("pyarrow").array([text or ""]))
        slots = quality.word_grams(data, at)[0]
        total = sum(weights[slots]) / max(len(slots), 1) ** 0.5 + weights[quality.BIAS]
        assert score == pytest.approx(1 / (1 + np.exp(-np.clip(total, -35, 35)))) and predicted == int(score >= 0.3)


def test_held_out_quality_is_ranked(spark):
    got = {r["doc_id"]: r for r in QUERIES["op4_quality"](spark, "/root/testdata/sf0.1").collect()}
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if r["quality"] is not None and held(r["doc_id"], 5, 0) and r["doc_id"] in got]
    scores, truth = [got[r["doc_id"]]["score"] for r in rows], [r["quality"] for r in rows]
    assert len(rows) > 300 and all(got[r["doc_id"]]["held_out"] for r in rows) and auc(scores, truth) >= 0.9
    loss = -np.mean([np.log(max(s if t else 1 - s, 1e-12)) for s, t in zip(scores, truth)])
    assert loss < 0.6


def test_shards_are_the_plain_order_and_mixture(spark):
    import hashlib

    sources = ["a"] * 700 + ["b"] * 200 + [None] * 90 + ["c"] * 9
    rows = [(i, f"t{i % 50}" if i % 11 else None, s) for i, s in enumerate(sources)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = {r["doc_id"]: r for r in interleaved_shards(docs).collect()}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    order = []
    for s in set(sources):
        name = "" if s is None else "=" + s
        phase = int(md5(name)[:8], 16) / 2**32
        mine = sorted(i for i, x in enumerate(sources) if x == s)
        mine.sort(key=lambda i: (md5(f"17:{i}"), i))
        order += [((k + phase) / len(mine), name, i) for k, i in enumerate(mine)]
    for rank, (_, _, i) in enumerate(sorted(order)):
        assert (got[i]["shard"], got[i]["slot"]) == (rank * 8 // len(rows), rank - -(-(rank * 8 // len(rows)) * len(rows) // 8))
    for s in ("a", "b", None, "c"):
        counts = [sum(got[i]["shard"] == k for i, x in enumerate(sources) if x == s) for k in range(8)]
        assert max(counts) - min(counts) <= 2 and abs(counts[0] - sources.count(s) / 8) <= 2
    assert got[0]["size"] == 1 and got[0]["text_crc32"] == 0 and got[1]["size"] == 3 and got[1]["text_crc32"] == zlib.crc32(b"t1")


def test_repeated_rows_get_places_of_their_own(spark):
    rows = interleaved_shards(spark.createDataFrame([(1, "same", "a")] * 40, "doc_id long, text string, source string")).collect()
    places = [(r["shard"], r["slot"]) for r in rows]
    assert sorted(places) == [(k, j) for k in range(8) for j in range(5)]


ODD = "doc_id long, text string, lang string, source string, n_chars long, digest string, node long, run int, keep_id long, _kept_id long, comp string, lang_pred string, label int"


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_tables(spark, stage):
    """Empty tables, null ids and texts, repeats, ties, a long text and clashing names; columns stay, decisions don't depend on them."""
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["river", "stone", "window", "garden", "yellow", "morning", "letter", "table"]) + rng.choice("abcdefghij") for _ in range(n))
    one, long = prose(60), prose(20000)
    texts = [(1, one), (1, one), (2, one), (None, prose(50)), (None, None), (3, None), (4, ""), (5, "   "), (6, long), (7, long), (8, "12 34"), (9, prose(40)), (10, "café " + prose(30))]
    rows = [(i, t, "en", None, len(t or ""), "x", 7, 3, 5, 6, "c", "zz", 1) for i, t in texts]
    docs, f = spark.createDataFrame(rows, ODD), corpus_pipeline.STAGES[stage][1]
    none = f(spark, docs.where("false"), "")
    got = f(spark, docs, "").collect()
    assert none.count() == 0
    ids = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in got)
    want = {
        0: [-1, -1, 1, 1, 2, 6, 7, 9, 10],  # a null id of a kept row keeps all null ids
        1: [-1, -1, 1, 1, 3, 5, 6, 8, 9, 10],
        2: [-1, -1, 1, 1, 3, 4, 5, 6, 8, 9, 10],
        3: sorted(-1 if i is None else i for i, _ in texts),
    }
    if stage < 4:
        assert none.columns == docs.columns and ids == want[stage] and all(tuple(r) in set(rows) for r in got)
    else:
        assert {r["doc_id"] for r in got} == {i for i, _ in texts} and sum(r["piece"] == 0 for r in got) == len(texts)
