"""Queries of the operators over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm import language_id, quality
from parchment.llm.alignment import align_tokenizers
from parchment.llm.bpe import bpe_round_trip
from parchment.llm.chroma import align, sung
from parchment.llm.common import documents, id_crc32
from parchment.llm.exact_dedup import exact_dedup
from parchment.llm.jaccard import NgramJoin
from parchment.llm.line_dedup import remove_boilerplate
from parchment.llm.packing import pack
from parchment.llm.secrets import scan_secrets
from parchment.llm.sharding import interleaved_shards
from parchment.llm.substrings import BlockAnchors
from parchment.llm.trie import prefix_trie


def held_out(mod: int, rest: int) -> F.Column:
    return F.coalesce(id_crc32(F.col("doc_id")) % mod == rest, F.lit(False)).alias("held_out")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.train(docs)
    return language_id.identify(docs, model).select("doc_id", held_out(3, 1), "lang_pred", "score", "runner_up", "ambiguous")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NgramJoin(documents(spark, sf_dir)).components()


def op3_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings are the turns of `conversations`, sung; rec_id is conv_id * 4096 + turn. Another take of each id divisible by 20 is a query."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = turns.select((F.col("conv_id") * 4096 + F.col("turn")).alias("rec_id"), "text")
    takes = sung(turns.where("rec_id % 20 = 0"), "rec_id", "text", take=True)
    return align(sung(turns, "rec_id", "text"), takes)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    weights = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, weights).select("doc_id", held_out(5, 0), "score", "predicted")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved_shards(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole texts in windows of 50 that a document with a smaller id has as well are removed."""
    return BlockAnchors(documents(spark, sf_dir), window=50).removed().drop("spans")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in both vocabularies; a pair's count is over all documents."""
    return align_tokenizers(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for each distinct sequence of first turns of the rebuilt conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("node", "parent")


QUERIES = {
    f.__name__: f
    for f in (
        *(op1_language_id, op2_ngram_jaccard, op3_chroma, op4_quality, op5_bpe, op6_packing, op7_sharding, op8_line_dedup, op9_exact_dedup, op10_secrets),
        *(op11_substring_dedup, op12_tokenizer_alignment, op13_prefix_trie),
    )
}

ORACLE_SQL = {
    "op8_line_dedup": r"""
        WITH l AS (SELECT doc_id, source, trim(u.line, ' ') AS t FROM documents, unnest(string_split(text, chr(10))) AS u(line)),
        b AS (SELECT t FROM l WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 10),
        d AS (SELECT doc_id, text, string_split(text, chr(10)) AS a, coalesce((SELECT list(t) FROM b), []) AS bad FROM documents),
        k AS (SELECT doc_id, text, a, list_filter(a, lambda x: NOT list_contains(bad, trim(x, ' '))) AS kept FROM d)
        SELECT doc_id, CAST(coalesce(len(a), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(a) - len(kept), 0) AS INTEGER) AS n_removed,
               CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS clean_text FROM k""",
    "op9_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
}
