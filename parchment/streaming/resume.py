"""Resumable extraction: new answer files are processed once, results are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from parchment.config import DEFAULTS, Settings
from parchment.plans.extract import extract


def process_new(spark: SparkSession, answers_dir: str, lines: DataFrame, out_dir: str, checkpoint: str, settings: Settings = DEFAULTS) -> StreamingQuery:
    """Process all answer files (Parquet: doc_id, prompt_version, raw) that no earlier run did, then stop.

    The checkpoint remembers files, so a run after a failure goes on where the last one stopped;
    each batch writes its own folder anew, so a repeated batch leaves no doubles.
    """

    def batch(answers: DataFrame, number: int) -> None:
        documents, fields = extract(answers, lines, settings)
        documents.write.mode("overwrite").parquet(f"{out_dir}/documents/batch={number}")
        fields.write.mode("overwrite").parquet(f"{out_dir}/fields/batch={number}")

    stream = spark.readStream.schema("doc_id long, prompt_version string, raw string").parquet(answers_dir)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
