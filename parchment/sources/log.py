"""An append-only log of predictions, bucketed by key, in which the last record of a key counts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.sources.tables import written
from parchment.types import PREDICTION

COMPLETE, UP_TO = "parchment.complete", "parchment.compacted_to"
COMPACTED = -1  # the batch that holds what compaction kept


class PredictionLog:
    """Records of numbered batches in a table `{name}_g{generation}`, bucketed by key and partitioned by batch.

    A batch that is added again replaces itself, so that a run that was killed and repeated leaves each record once. Of a
    key's records the one of the highest batch counts, within a batch the one of the highest `seq` (the caller's number
    of the record in its batch). Readers by key need no shuffle of the log, however long it is, because its
    buckets are dealt by key.

    `compact` writes the last records to a new generation, which counts once its table is marked complete; until
    then, and where it is broken off, the old one does. Batches that went into a compaction are not taken again.

    A null key is one key among the last records, and never counts as done. An empty batch, added again, takes its
    records away. One writer at a time is assumed; readers may read on while a new batch is added.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64, columns: str = PREDICTION, database: str = "default"):
        if not re.fullmatch(r"[a-z][a-z0-9_]*", name):
            raise ValueError(f"not a table name: {name!r}")
        self.spark, self.name, self.buckets, self.columns, self.database = spark, name, buckets, columns, database

    def path(self, generation: int) -> str:
        return f"{self.database}.{self.name}_g{generation}"

    def generations(self) -> list[int]:
        rows = self.spark.sql(f"SHOW TABLES IN {self.database} LIKE '{self.name}_g*'").collect()  # two at most but for broken-off compactions
        found = (re.fullmatch(re.escape(self.name) + r"_g(\d+)", r["tableName"]) for r in rows)
        return sorted(int(x[1]) for x in found if x)

    def mark(self, generation: int, key: str) -> str | None:
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self.path(generation)}").where(F.col("key") == key).collect()
        return rows[0]["value"] if rows else None

    def current(self) -> int:
        """The newest complete generation; an empty first one is made where there is none."""
        whole = [g for g in self.generations() if self.mark(g, COMPLETE) == "true"]
        return max(whole) if whole else self.create(0, complete=True)

    def create(self, generation: int, complete: bool = False, up_to: int = COMPACTED) -> int:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.path(generation)}")
        self.spark.sql(
            f"CREATE TABLE {self.path(generation)} ({self.columns}, batch bigint) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (key) SORTED BY (key, seq) INTO {self.buckets} BUCKETS TBLPROPERTIES ('{COMPLETE}' = '{str(complete).lower()}', '{UP_TO}' = '{up_to}')"
        )
        return generation

    def insert(self, records: DataFrame, generation: int, batch: int) -> None:
        """One partition replaced; rows are dealt as buckets are, so that each has one file. They were written before, so
        that they may come from the log itself and that little can fail between the old partition and the new one."""
        columns = [x for x in self.spark.table(self.path(generation)).columns if x != "batch"]
        rows = written(records.select(*columns), "batch").repartition(self.buckets, "key")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.path(generation)} PARTITION (batch = {batch}) SELECT * FROM {{rows}}", rows=rows)

    def records(self) -> DataFrame:
        """All records of the log, older ones of a key included."""
        return self.spark.table(self.path(self.current()))

    def append(self, records: DataFrame, batch: int) -> bool:
        """Add a batch (from 0), or replace it; False, with nothing done, if a compaction has taken it in."""
        if batch < 0:
            raise ValueError("batches are numbered from 0")
        generation = self.current()
        if batch <= int(self.mark(generation, UP_TO)):
            return False
        self.insert(records, generation, batch)
        return True

    def last_batch(self) -> int:
        """The highest batch of the log, those in compactions included; -1 if there is none."""
        top = self.records().agg(F.max("batch")).first()[0]
        return max(int(self.mark(self.current(), UP_TO)), COMPACTED if top is None else top)

    def latest(self) -> DataFrame:
        """The last record of each key, grouped bucket by bucket."""
        log = self.records()
        rest = [x for x in log.columns if x != "key"]
        last = log.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("batch", "seq")).alias("last"))
        return last.select("key", *(F.col("last")[x].alias(x) for x in rest))

    def pending(self, samples: DataFrame, key: str = "key") -> DataFrame:
        """Samples without a record; only the samples are shuffled."""
        done = self.records().select(F.col("key").alias("_done")).hint("merge")
        return samples.join(done, samples[key] == done["_done"], "left_anti")

    def resume(self, samples: DataFrame, predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Records of all samples: what `predict` makes of those without one goes into the log first, as a batch after the last.

        So a run that was killed is repeated as it was: what the log has is not predicted again.
        """
        pending = self.pending(samples)
        if not pending.isEmpty():
            self.append(predict(pending), self.last_batch() + 1)
        wanted = samples.select(F.col("key").alias("_wanted")).hint("merge")
        last = self.latest()
        return last.join(wanted, last["key"] == wanted["_wanted"], "left_semi")

    def compact(self) -> int:
        """Keep the last record of each key only; returns the new generation. Older and broken-off ones go."""
        new = self.create(max(self.current(), *self.generations()) + 1, up_to=self.last_batch())
        self.insert(self.latest(), new, COMPACTED)
        self.spark.sql(f"ALTER TABLE {self.path(new)} SET TBLPROPERTIES ('{COMPLETE}' = 'true')")
        for generation in self.generations():
            if generation != new:
                self.spark.sql(f"DROP TABLE {self.path(generation)}")
        return new
