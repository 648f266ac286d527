"""Prefix trie of conversations, its subtree totals by parallel tree contraction."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchment.llm.common import id_crc32, shared_table
from parchment.operators.order import numbered

STEP = 1024  # turns whose prefixes one window makes
LEVELS = 4  # of windows, for STEP ** LEVELS turns in a conversation
IDS_PER_BLOCK = 1 << 16
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, a, b, words): two 64-bit halves of a digest of role and text, and the text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, words = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                role, text = (role or "").encode(), text or ""
                digest = hashlib.blake2b(len(role).to_bytes(8, "little") + role + text.encode(), digest_size=16).digest()
                a.append(int.from_bytes(digest[:8], "little", signed=True))
                b.append(int.from_bytes(digest[8:], "little", signed=True))
                words.append(sum(1 for _ in WORD.finditer(text)))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(words, pa.int64())], ["conv_id", "turn", "a", "b", "words"])

    rows = conversations.select(conversations[id_col].cast("long").alias("conv_id"), conversations[turn_col].alias("turn"), conversations[role_col].alias("role"), conversations[text_col].alias("text"))
    kind = rows.schema["turn"].dataType.simpleString()
    return rows.where("conv_id IS NOT NULL").mapInArrow(run, f"conv_id long, turn {kind}, a long, b long, words long")


def rebuilt(own: DataFrame, block: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, a, b, words) of rebuilt conversations, and (conv_id, n_turns) of all, turnless ones included.

    `own` has the turns with their place. Conversation c begins with the first crc32(c) % `most` turns of
    c - c % `block`, as far as there are so many, and goes on with its own turns after as many.
    """
    held = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    head = id_crc32(F.col("conv_id")) % most
    plan = held.select("conv_id", "n", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    bases = held.toDF("base", "base_n")
    plan = plan.join(bases, "base", "left").withColumn("lent", F.least("head", F.coalesce("base_n", F.lit(0))))
    plan = shared_table(plan.select("conv_id", "n", "head", "base", "lent"), "plan")
    first = own.where(F.col("place") < most - 1).select(F.col("conv_id").alias("base"), "place", "a", "b", "words")
    borrowed = plan.where("lent > 0").join(first, "base").where("place < lent").select("conv_id", F.col("place").alias("pos"), "a", "b", "words")
    rest = own.join(plan.select("conv_id", "head", "lent"), "conv_id").where("place >= head").select("conv_id", (F.col("place") - F.col("head") + F.col("lent")).alias("pos"), "a", "b", "words")
    sizes = plan.select("conv_id", (F.col("lent") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("n_turns"))
    return borrowed.unionByName(rest), sizes


def prefixes(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, pos, a, b, ...) with (a, b) of the whole prefix: XOR of all turns so far, each mixed with its place.

    Windows run over STEP turns, over the sums of STEP such stretches, and so on, so that a conversation of any
    length is spread over many of them.
    """
    mixed = rows.withColumns({"a": F.xxhash64("a", "b", "pos"), "b": F.xxhash64("b", "pos", "a", F.lit(1))})

    def scanned(df: DataFrame, place: str, level: int) -> DataFrame:
        of = F.floor(F.col(place) / STEP).cast("long")
        within = Window.partitionBy("conv_id", "_of").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn("_of", of)
        if level == LEVELS:
            return df.withColumns({x: F.bit_xor(x).over(Window.partitionBy("conv_id").orderBy(place)) for x in ("a", "b")}).drop("_of")
        local = df.withColumns({x: F.bit_xor(x).over(within) for x in ("a", "b")})
        sums = df.groupBy("conv_id", "_of").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).where("_of IS NOT NULL")
        longer = df.where(of > 0).select("conv_id").distinct()
        ahead = scanned(sums.join(longer, "conv_id", "left_semi").withColumnRenamed("_of", "_at"), "_at", level + 1)
        ahead = ahead.select("conv_id", (F.col("_at") + 1).alias("_of"), F.col("a").alias("_a"), F.col("b").alias("_b"))
        both = local.join(ahead, ["conv_id", "_of"], "left")
        return both.withColumns({x: F.col(x).bitwiseXOR(F.coalesce(f"_{x}", F.lit(0).cast("long"))) for x in ("a", "b")}).drop("_of", "_a", "_b")

    return scanned(mixed, "pos", 2)


def ends_of(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv_id): SHA-256 of the ascending decimal ids, comma-joined.

    Sorted ranges pack their ids into blocks of text, many tasks a node; what one task reads in order
    for a node are these blocks, and it keeps the digest's state only.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ids = batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()
            out, at = [], 0
            while at < len(ids):
                end = at + 1
                while end < len(ids) and end - at < IDS_PER_BLOCK and nodes[end] == nodes[at]:
                    end += 1
                out.append((nodes[at], ids[at], ",".join(map(str, ids[at:end]))))
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)] if out else [pa.array([], k) for k in (pa.binary(), pa.int64(), pa.string())], ["node", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            nodes, digests = [], []
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node == last:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    nodes.append(last), digests.append(state.hexdigest())
                last, state = node, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], ["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "ends_sha256"])

    blocks = members.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(pack, "node binary, first long, ids string")
    return blocks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def subtree_totals(tree: DataFrame, *values: str) -> DataFrame:
    """(node, total of each of `values`) over every node's subtree, itself included; `tree` has node, parent (null: a root) and the values.

    Parallel tree contraction. Every round rakes all leaves, adding them to their parents, and then compresses every
    chain of nodes with one child at once: pointers double until each chain node points at the first node
    below its chain, with the sum from itself to there; that node becomes the child of what stood above the chain and
    carries the chain's sum on its edge. A tree without unary nodes loses half its nodes with its leaves, so rounds are
    logarithmic in the size of the tree, whatever its shape. Then the rounds are taken back: a chain node's
    total is its sum and the total of the node below.

    No join has a node's many children on one key: children are only ever counted and summed by parent.
    """
    carry = [f"edge_{v}" for v in values]
    zero = F.lit(0).cast("long")
    live = tree.select("node", "parent", *(F.col(v).cast("long").alias(v) for v in values), *(zero.alias(c) for c in carry))
    live = shared_table(live, "live")
    done, rounds = [], []
    while not live.isEmpty():
        inner = live.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
        leaves = shared_table(live.join(inner, "node", "left_anti"), "leaves")
        done.append(leaves.select("node", *values))
        given = leaves.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(*(F.sum(F.col(v) + F.col(c)).alias(f"given_{v}") for v, c in zip(values, carry, strict=True)))
        live = live.join(inner, "node", "left_semi").join(given, "node", "left")
        live = shared_table(live.select("node", "parent", *((F.col(v) + F.coalesce(f"given_{v}", zero)).alias(v) for v in values), *carry), "live")
        kids = live.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n"), F.min("node").alias("to"), *(F.min(c).alias(f"to_{c}") for c in carry)).where("n = 1").drop("n")
        chain = live.where("parent IS NOT NULL").join(kids, "node")
        chain = shared_table(chain.select("node", "parent", "to", *((F.col(v) + F.col(f"to_{c}")).alias(v) for v, c in zip(values, carry, strict=True)), *carry), "chain")
        if chain.isEmpty():
            continue
        tops = chain.select("node", "parent", *carry).join(chain.select(F.col("to").alias("node")), "node", "left_anti")
        jumped = chain.select("node", "to", *values, F.lit(True).alias("moving"))
        while True:
            ahead = jumped.select(F.col("node").alias("to"), F.col("to").alias("_to"), *(F.col(v).alias(f"_{v}") for v in values))
            moved = jumped.where("moving").join(ahead, "to", "left")
            moved = moved.select("node", F.coalesce("_to", "to").alias("to"), *((F.col(v) + F.coalesce(f"_{v}", zero)).alias(v) for v in values), F.col("_to").isNotNull().alias("moving"))
            jumped = shared_table(moved.unionByName(jumped.where("NOT moving")), "jumped")
            if jumped.where("moving").isEmpty():
                break
        rounds.append(jumped.select("node", "to", *values))
        lifted = tops.join(jumped.select("node", "to", *values), "node").select(F.col("to").alias("node"), F.col("parent").alias("_parent"), *((F.col(v) + F.col(c)).alias(f"_{c}") for v, c in zip(values, carry, strict=True)))
        live = live.join(chain.select("node"), "node", "left_anti").join(lifted, "node", "left")
        live = shared_table(live.select("node", F.coalesce("_parent", "parent").alias("parent"), *values, *(F.coalesce(f"_{c}", c).alias(c) for c in carry)), "live")
    if not done:
        return live.select("node", *values)
    totals = done[0]
    for more in done[1:]:
        totals = totals.union(more)
    for chain in reversed(rounds):
        below = totals.select(F.col("node").alias("to"), *(F.col(v).alias(f"_{v}") for v in values))
        found = chain.join(below, "to").select("node", *((F.col(v) + F.col(f"_{v}")).alias(v) for v in values))
        totals = shared_table(totals.union(found), "totals")
    return totals


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 20, most: int = 4) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; and node, parent (keys).

    Conversations are rebuilt as `rebuilt` says; a node is a distinct sequence of first turns, known by a 128-bit
    hash of it and its depth. Turns stand in the order of `turn`, null first, and of their digests among
    equals. Null roles and texts are empty. Rows without a conversation's id belong to none.
    An empty table gives no node, not even a root. Other columns are ignored, whatever their names.
    """
    own = numbered(turns(conversations, id_col, turn_col, role_col, text_col), "turn", "a", "b", by=("conv_id",))
    rows, sizes = rebuilt(shared_table(own, "turns"), block, most)
    sizes = shared_table(sizes, "sizes")
    at = F.concat(*(F.unhex(F.lpad(F.hex(x), 16, "0")) for x in ("depth", "a", "b")))
    root = F.unhex(F.lit("0" * 48))
    steps = prefixes(rows).select("conv_id", (F.col("pos") + 1).alias("depth"), "a", "b", "words")
    steps = shared_table(steps.select("conv_id", "depth", "words", at.alias("node")), "steps")
    before = steps.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    steps = steps.join(before, ["conv_id", "depth"], "left").withColumn("parent", F.coalesce("parent", root))
    nodes = steps.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.count("*").alias("n_convs"), F.first("words").alias("words"))
    top = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(root.alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", F.lit(0).cast("long").alias("words"))
    nodes = shared_table(nodes.unionByName(top), "nodes")
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = shared_table(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    own_values = nodes.select("node", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = subtree_totals(own_values, "n_leaves", "saved_tokens")
    last = steps.join(sizes, "conv_id").where("depth = n_turns").select("node", "conv_id")
    members = last.union(sizes.where("n_turns = 0").select(root.alias("node"), "conv_id"))
    heads = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, "node").join(ends_of(members), "node", "left").join(heads, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "node", "parent")
