"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchment.llm.common import shared_table

BUCKETS = 4096


def interleaved_shards(
    docs: DataFrame,
    shards: int = 8,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, law 'rows', shard, slot, grown_shard null.

    Within each source rows are shuffled by a seeded digest and ranked; the fractional rank
    (rank + phase of the source) / rows of the source puts every source evenly over [0, 1), so
    that cutting the order by fractional rank into equal counts gives every shard the mixture
    of the whole. The phase, a digest of the source's name, spreads small sources.

    No task ranks a source or the whole: rows are dealt by (source, first digest digits) and
    then by fractional rank, both even by construction, and ranks are local ones plus running
    counts of BUCKETS buckets. Equal texts carry no constraint here: each row is its own unit.

    A null source is a source of its own; a null text has size 1 and CRC 0. Rows that agree
    in everything are interchangeable. Other columns are ignored. An empty table gives no rows.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    bits = F.substring("h", 1, 3)
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), docs[source_col]), F.lit("")).alias("stratum"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(docs[id_col].cast("string"), F.lit("-"))).cast("binary")).alias("h"),
    ).withColumn("bucket", bits)

    in_source = Window.partitionBy("stratum")
    offsets = (
        rows.groupBy("stratum", "bucket")
        .agg(F.count("*").alias("n"))
        .select(
            "stratum",
            "bucket",
            (F.sum("n").over(in_source.orderBy("bucket")) - F.col("n")).alias("before"),
            F.sum("n").over(in_source).alias("n_source"),
        )
    )
    local = Window.partitionBy("stratum", "bucket").orderBy("h", "doc_id", "text_crc32", "size")
    phase = F.conv(F.substring(F.md5(F.col("stratum").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    ranked = shared_table(
        rows.withColumn("local", F.row_number().over(local) - 1)
        .join(offsets, ["stratum", "bucket"])
        .withColumn("frac", (F.col("before") + F.col("local") + phase) / F.col("n_source"))
        .select("doc_id", "size", "text_crc32", "stratum", "h", "frac", F.floor(F.col("frac") * BUCKETS).cast("int").alias("part")),
        "ranked",
    )
    parts = ranked.groupBy("part").agg(F.count("*").alias("n"))  # BUCKETS rows at most, for any input
    parts = parts.select(
        "part",
        (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy()).alias("n_all"),
    )
    order = Window.partitionBy("part").orderBy("frac", "stratum", "h", "doc_id", "text_crc32", "size")
    whole = (
        ranked.withColumn("local", F.row_number().over(order) - 1)
        .join(F.broadcast(parts), "part")
        .withColumn("rank", F.col("before") + F.col("local"))
        .withColumn("shard", F.floor(F.col("rank") * shards / F.col("n_all")).cast("int"))
    )
    return whole.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("rank") - F.ceil(F.col("shard") * F.col("n_all") / shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
