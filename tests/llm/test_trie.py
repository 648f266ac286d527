"""The prefix trie against one built by hand, and tree contraction against sums over every subtree."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from parchment.llm import queries, trie
from parchment.llm.trie import ends_of, prefix_trie, subtree_totals

COLUMNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda z: z[0])] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members, kids = defaultdict(list), defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        totals[node] = (sum(totals[k][0] for k in kids[node]) if kids[node] else 1, (len(members[node]) - 1) * words + sum(totals[k][1] for k in kids[node]))
    ends = {n: ",".join(str(c) for c in members[n] if len(rebuilt[c]) == len(n)) for n in members}
    return sorted(((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(kids[n]), *totals[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n in members), key=str)


def results(found):
    return sorted((tuple(r)[:8] for r in found.collect()), key=str)


def test_query_against_a_trie_by_hand(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(queries.QUERIES["op13_prefix_trie"](spark, folder)) == brute(rows)


def test_copies_nulls_and_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "STEP", 4)
    monkeypatch.setattr(trie, "IDS_PER_BLOCK", 3)
    rng = random.Random(3)
    rows = {(5, None): ("u", None), (5, 0): (None, "a b"), (6, 1): ("u", ""), (100, 0): ("u", "deep")}
    for c in range(60):
        for t in range(rng.randrange(1, 7)):
            rows.setdefault((c, t), (rng.choice("uu"), rng.choice(["a", "b c"])))
    rows.update({(7, t): ("u", "z z") for t in range(100, 170)})
    rows = [(*k, *v) for k, v in rows.items()] + [(None, 1, "u", "x")]
    conversations = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "conv_id AS a", "turn AS place", "turn AS node").repartition(5)
    assert results(prefix_trie(conversations)) == brute(rows)


def test_repeated_turns_and_empty_table(spark):
    assert prefix_trie(spark.createDataFrame([], COLUMNS)).count() == 0
    rows = [(1, 0, "u", "x"), (1, 0, "u", "x"), (1, 0, "u", "y")]
    found = prefix_trie(spark.createDataFrame(rows, COLUMNS)).collect()
    again = prefix_trie(spark.createDataFrame(rows[::-1], COLUMNS)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


@pytest.mark.parametrize("shape", ["path", "star", "comb", "random", "forest"])
def test_totals_of_trees_of_every_shape(spark, shape):
    rng, n = random.Random(7), 90
    parent = {0: None}
    for i in range(1, n):
        parent[i] = {"path": i - 1, "star": 0, "comb": i - 1 if i % 2 else max(0, i - 2), "random": rng.randrange(i), "forest": None if i % 9 == 0 else i - 1}[shape]
    value = {i: rng.randrange(-3, 9) for i in parent}
    want = dict(value)
    for i in sorted(parent, reverse=True):
        if parent[i] is not None:
            want[parent[i]] += want[i]
    tree = spark.createDataFrame([(i, p, value[i], 1) for i, p in parent.items()], "node long, parent long, v long, one long")
    got = {r.node: r.v for r in subtree_totals(tree, "v", "one").collect()}
    assert got == want


def test_ends_digest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS_PER_BLOCK", 7)
    rows = [(bytearray(b"n%d" % (i % 3)), i) for i in range(100)] + [(bytearray(b"m"), -4)]
    got = {bytes(r.node): r.ends_sha256 for r in ends_of(spark.createDataFrame(rows, "node binary, conv_id long").repartition(4)).collect()}
    want = {b"n%d" % k: hashlib.sha256(",".join(str(i) for i in range(100) if i % 3 == k).encode()).hexdigest() for k in range(3)}
    assert got == want | {b"m": hashlib.sha256(b"-4").hexdigest()}
