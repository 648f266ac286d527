import io
import random
import wave

import numpy as np
import pytest

from parchment.llm import chroma as operator
from parchment.llm import queries
from parchment.llm.chroma import RATE, align, chroma, compared, fingerprints, landmarks, prints, samples, sung, wav

CLASH = "rec_id long, audio binary, digest string, place int, run int"


def tune(seed, seconds, rate=RATE, parts=3):
    """Notes of three harmonics and changing length."""
    rng = np.random.default_rng(seed)
    out = []
    while sum(map(len, out)) < seconds * rate:
        t = np.arange(int(rng.uniform(0.1, 0.4) * rate)) / rate
        hertz = 110 * 2 ** (rng.integers(0, 24) / 12)
        out.append(sum(np.sin(2 * np.pi * hertz * k * t) / k for k in range(1, parts + 1)) * 0.4)
    return np.concatenate(out)[: int(seconds * rate)].astype(np.float32)


def file(x, rate, width, channels):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels), f.setsampwidth(width), f.setframerate(rate)
        whole = np.round(np.clip(x, -1, 1) * ((1 << (8 * width - 1)) - 1)).astype(np.int64) + (128 if width == 1 else 0)
        data = np.repeat(whole[:, None], channels, 1).astype("<i8").reshape(-1, 1).view(np.uint8)[:, :width]
        f.writeframes(data.tobytes())
    return out.getvalue()


def errors(a, b):
    n = min(len(a), len(b))
    return np.bitwise_count(a[:n] ^ b[:n]).mean() / 32


@pytest.mark.parametrize("rate, width, channels", [(2000, 1, 1), (8000, 2, 2), (44100, 2, 1), (44100, 3, 2), (22050, 4, 1)])
def test_any_pcm_gives_like_prints(rate, width, channels):
    plain = prints(chroma(tune(1, 6)))[0]
    got = prints(chroma(samples(file(tune(1, 6, rate), rate, width, channels))))[0]
    assert abs(len(got) - len(plain)) <= 2
    # lengths of notes are rounded to samples of each rate: only the beginning stays together
    assert errors(got[:40], plain[:40]) < 0.15 and errors(got[:40], prints(chroma(tune(2, 6)))[0][:40]) > 0.25


def test_different_songs_of_real_rates_differ(spark):
    rows = [(i, file(tune(i, 5, 44100), 44100, 2, 1)) for i in range(20, 30)]
    got = align(spark.createDataFrame(rows, "rec_id long, audio binary"), query_mod=1).collect()
    assert {r["kind"] for r in got} == {"member"} and all(r["n_prints"] > 100 for r in got)


def brute_force(queries, recordings, least_overlap, most_error):
    """The best place of every pair whose bits agree over the whole overlap."""
    found = {}
    for q, x in queries.items():
        for r, y in recordings.items():
            for place in range(least_overlap - len(x), len(y) - least_overlap + 1):
                a, b = x[max(0, -place) :], y[max(0, place) :]
                n = min(len(a), len(b))
                if n >= least_overlap and (e := errors(a[:n], b[:n])) <= most_error:
                    found[q, r] = min(found.get((q, r), (1, 0)), (e, place))
    return found


@pytest.mark.parametrize("noise_db", [20, 10, 6])
def test_recall_against_brute_force(spark, noise_db):
    """Takes that begin anywhere, quieter, with noise; some short, some overlapping by their ends only."""
    rng = np.random.default_rng(noise_db)
    songs = {i: tune(100 + i, 3 + i % 5) for i in range(40)}
    takes = {}
    for i, x in songs.items():
        y = x[int(rng.integers(1, len(x) // 3)) :] * 0.3
        if i % 4 == 0:
            y = np.concatenate([y, tune(900 + i, 1)])
        takes[1000 + i] = y + rng.normal(0, 10 ** (-noise_db / 20) * np.sqrt((y**2).mean()), len(y))
    one = lambda x: prints(chroma(samples(wav(x))))[0]
    want = brute_force({k: one(x) for k, x in takes.items()}, {k: one(x) for k, x in songs.items()}, 48, 0.2)
    frame = lambda rows: spark.createDataFrame([(k, wav(x)) for k, x in rows.items()], "rec_id long, audio binary")
    got = {}
    for r in align(frame(songs), frame(takes)).where("kind = 'match'").collect():
        got.setdefault((r["rec_id"], r["class_id"]), set()).add(r["place"])
    assert len(want) >= 25 and all(q - 1000 == r for q, r in got)
    assert sum(any(abs(p - place) <= 1 for p in got.get(k, ())) for k, (_, place) in want.items()) >= 0.9 * len(want)


def test_passages_and_copies(spark):
    """A passage between unrelated parts matches by its stretch; copies are members of one class and match once."""
    passage = tune(5, 4)
    rows = {20: np.concatenate([tune(6, 3), passage, tune(7, 2)]), 21: np.concatenate([tune(8, 5), passage, tune(9, 3)]), 22: tune(10, 6)}
    rows[23], rows[40] = rows[21], tune(6, 0.05)
    frame = spark.createDataFrame([(k, wav(x), "clash", 7, 9) for k, x in rows.items()] + [(None, wav(rows[22]), "", 0, 0)], CLASH)
    got = align(frame).collect()
    assert {(r["rec_id"], r["class_id"]) for r in got if r["kind"] == "member"} == {(20, 20), (21, 21), (22, 22), (23, 21), (40, 40), (None, 22)}
    match = [r for r in got if r["kind"] == "match"]
    assert [(r["rec_id"], r["class_id"]) for r in match] == [(20, 21)]
    r = match[0]
    assert abs(r["place"] - 2 * 1000 / 32) <= 1 and r["bit_error"] > 0.2 and r["stretch"] >= 90 and r["stretch_at"] <= 94 <= r["stretch_at"] + 60 and r["stretch_error"] <= 0.2


def test_common_passages_lose_no_pair(spark):
    jingle = tune(50, 3)
    rows = [(i, wav(np.concatenate([tune(200 + i, 1 + i % 3), jingle]))) for i in range(60)]
    got = align(spark.createDataFrame(rows, "rec_id long, audio binary")).where("kind = 'match'").collect()
    assert {(r["rec_id"], r["class_id"]) for r in got} == {(q, i) for q in (0, 20, 40) for i in range(60) if i != q}


def test_constant_audio_costs_its_runs():
    for x in (np.zeros(RATE * 60), np.sin(2 * np.pi * 220 * np.arange(RATE * 60) / RATE)):
        values, weak = prints(chroma(x.astype(np.float32)))
        assert len(values) > 1800 and len(landmarks(values, weak)[0]) < 400
    assert len(landmarks(prints(chroma(np.zeros(RATE * 60, np.float32)))[0])[0]) == 0


def test_odd_audio(spark):
    none = spark.createDataFrame([], "rec_id long, audio binary")
    assert align(none).count() == 0 and align(none, none).count() == 0
    broken = [(20, None), (21, b""), (22, b"RIFF not a file"), (23, wav(np.zeros(10))), (24, wav(np.zeros(0))), (20, None)]
    rows = align(spark.createDataFrame(broken, "rec_id long, audio binary")).collect()
    assert sorted((r["kind"], r["rec_id"], r["class_id"], r["n_prints"]) for r in rows) == [("member", i, i, 0) for i in (20, 20, 21, 22, 23, 24)]
    long = fingerprints(spark.createDataFrame([(1, wav(tune(3, 600)))], "rec_id long, audio binary")).first()
    assert long["n_prints"] == len(long["prints"]) // 4 == len(long["weak"]) > 18000


def test_turns_are_found_by_another_take(spark):
    rng = random.Random(8)
    texts = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(60 + i % 90))) for i in range(100)] + [(100, None), (120, "")]
    turns = spark.createDataFrame(texts, "rec_id long, text string")
    got = align(sung(turns, "rec_id", "text"), sung(turns.where("rec_id % 20 = 0"), "rec_id", "text", take=True)).collect()
    assert {(r["rec_id"], r["class_id"]) for r in got if r["kind"] == "match"} == {(i, i) for i in range(0, 100, 20)}
    assert sum(r["kind"] == "member" for r in got) == 102


def test_compared_keeps_the_better_of_neighbours():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.integers(0, 1 << 32, 100, dtype=np.uint32), 3)
    assert [r[0] for r in compared(x, x[30:], [-31, -30, -29], 48, 0.4)] == [-30]


def test_recall_of_the_query_by_length_over_all_its_queries(spark):
    """Every taken excerpt of 16 prints (half a second) or more counts; shorter ones have no landmark."""
    folder = "/root/testdata/sf0.1"
    turns = spark.read.parquet(f"{folder}/conversations.parquet").selectExpr("conv_id * 4096 + turn AS rec_id", "text")
    sizes = {r.rec_id: r.n_prints for r in fingerprints(sung(turns.where("rec_id % 20 = 0"), "rec_id", "text", take=True)).collect()}
    rows = queries.QUERIES["op3_chroma"](spark, folder).collect()
    classes = {r.rec_id: r.class_id for r in rows if r.kind == "member"}
    found = {r.rec_id for r in rows if r.kind == "match" and classes[r.rec_id] == r.class_id}
    long, short = ({k for k, n in sizes.items() if n >= 24}, {k for k, n in sizes.items() if 16 <= n < 24})
    assert len(found & (long | short)) >= 0.9 * len(long | short) and len(found & long) >= 0.95 * len(long)
    assert sum(classes[r.rec_id] != r.class_id for r in rows if r.kind == "match") <= 0.05 * len(found)


def test_short_overlaps_may_have_fewer_errors():
    assert [round(operator.allowed(n, 0.2), 3) for n in (16, 32, 48, 500)] == [0.133, 0.167, 0.2, 0.2]
