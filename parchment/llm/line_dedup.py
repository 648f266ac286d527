"""Line dedup by the number of distinct sites, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import shared_table


def line_hash(line) -> F.Column:
    return F.xxhash64(F.trim(line))


def remove_boilerplate(
    docs: DataFrame,
    min_sites: int = 10,
    near_low: float = 0.75,
    near_high: float = 1.35,
    lg_k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    most_broadcast: int = 1 << 20,
    rows_a_salt: int = 1 << 18,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_lines, n_removed, clean_text.

    A line (trimmed of spaces, not blank) that stands on `min_sites` distinct sites or more is
    boilerplate and goes. HyperLogLog sketches of the sites of each line hash are made in every
    partition and merged; estimates outside [near_low, near_high] x min_sites (over six
    standard errors at lg_k 10) decide, and lines within get exact distinct counts. Sketches are
    merged map-side first, so a line that stands everywhere costs a row per task.

    The hashes of boilerplate are written and counted: up to `most_broadcast` of them (8 bytes each) go to every task,
    so that occurrences of a common line aren't shuffled to one place. More of them are joined with salts, one for every
    `rows_a_salt` rows of the most common line, by which a line's occurrences are dealt out by document.

    A null text has no lines and stays null; an empty one has one blank line and stays. A null
    site counts as no site. Rows that share an id are cleaned alike, each by its own text. Other
    columns are ignored; an empty table gives no rows.
    """
    text = docs[text_col]
    rows = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), docs[site_col].alias("site"))
    lines = rows.select("doc_id", "site", F.explode(F.split("text", "\n", -1)).alias("line"))
    lines = lines.where(F.trim("line") != "").select("doc_id", F.xxhash64("site").alias("site_hash"), F.col("site").isNotNull().alias("sited"), line_hash(F.col("line")).alias("h"))
    sited = lines.where("sited")
    site = F.when(F.col("sited"), F.col("site_hash"))
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg(site, F.lit(lg_k))).alias("sites"), F.count("*").alias("n"))
    spread = spread.where(F.col("sites") >= near_low * min_sites)
    near = spread.where(F.col("sites") <= near_high * min_sites).select("h", "n")
    exact = sited.join(near, "h", "left_semi").select("h", "site_hash").distinct().groupBy("h").agg(F.count("*").alias("sites"))
    wide = near.join(exact.where(F.col("sites") >= min_sites).select("h"), "h", "left_semi")
    boilerplate = shared_table(spread.where(F.col("sites") > near_high * min_sites).select("h", "n").union(wide), "boilerplate")
    found, most = boilerplate.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    if found <= most_broadcast:
        common = lines.join(F.broadcast(boilerplate.select("h")), "h")
    else:
        salts = -(-most // rows_a_salt)
        salted = boilerplate.select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
        dealt = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        common = dealt.join(salted, ["h", "salt"])
    marked = common.groupBy("doc_id").agg(F.collect_set("h").alias("bad")).select(F.col("doc_id").alias("bad_id"), "bad")
    bad = F.coalesce("bad", F.array().cast("array<bigint>"))
    split = F.split("text", "\n", -1)
    kept = F.filter(split, lambda x: (F.trim(x) == "") | ~F.array_contains(bad, line_hash(x)))
    return rows.join(marked, rows["doc_id"].eqNullSafe(marked["bad_id"]), "left").select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(split) - F.size(kept)).alias("n_removed"),
        F.array_join(kept, "\n").alias("clean_text"),
    )
