"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchment.llm.common import keep_only, shared_table

KEY = ["digest", "proof", "n_bytes"]
SLICES = 4096  # ranges of digests by which tasks share a run


def normalised(text) -> F.Column:
    """Text with every run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def merged(level: DataFrame, run) -> DataFrame:
    """A level's sorted runs merged into those that `run` names: one row per run and key, in order.

    A run's slice of digests goes whole to the task that has the other runs' same slice. In the
    order of the key and the id the first row of a key holds the smallest id.
    """
    order = ["run", "slice", *KEY]
    least = F.asc_nulls_last("keep_id")
    dealt = level.withColumn("run", run).repartition("run", "slice").sortWithinPartitions(*order, least)
    same = Window.partitionBy(*order).orderBy(least)
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = dealt.select(*order, "keep_id", F.sum("group_size").over(whole).alias("group_size"), F.row_number().over(same).alias("nth"))
    return met.where("nth = 1").drop("nth")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 64, fan_in: int = 4) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Each partition makes a run without repeats of (digest, smallest id, count), and runs are
    written in the order of digests. Those of partitions with one remainder by `runs` merge
    first. Then, in round k, run r takes the runs r + i * fan_in ** k: 64, 16, 4, 1 are left.
    Each merge reads its inputs in order and keeps one row per key; equality is verified on
    the SHA-256, a second hash of another family and the length at every level. A group of any size
    costs one small row per run that has it. Rows get their result by partition and digest,
    so that no task holds more of a group than its partition does.

    Null and empty texts are one group, equal to each other. Rows that share an id share its
    fate: all are kept or none. A group whose ids are all null keeps null. Other columns of
    `docs` are ignored, whatever their names. An empty table gives an empty result.
    """
    text = normalised(docs[text_col])
    rows = shared_table(
        docs.select(
            docs[id_col].alias("doc_id"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.xxhash64(text).alias("proof"),
            F.octet_length(text).alias("n_bytes"),
            F.spark_partition_id().alias("run"),
        ),
        "digests",
    )
    part = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % SLICES
    leaves = rows.groupBy("run", *KEY).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    leaves = shared_table(leaves.withColumn("slice", part.cast("int")).sortWithinPartitions("run", "slice", *KEY), "runs")
    level = merged(leaves, F.col("run") % runs)
    step = 1
    while step < runs:
        level = merged(level, F.col("run") - F.floor(F.col("run") / step).cast("int") % fan_in * step)
        step *= fan_in
    back = leaves.select("run", *KEY).join(level.drop("run", "slice"), KEY)
    return rows.join(back, ["run", *KEY]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that `exact_dedup` doesn't keep.

    Columns stay as they are, whatever their names. Rows with the id of a kept row stay, repeats
    included; of null and empty texts the smallest id stays. An empty table gives an empty one.
    """
    found = exact_dedup(docs, id_col, text_col)
    return keep_only(docs, found.where("kept").select(F.col("doc_id").alias(id_col)).distinct(), id_col)
