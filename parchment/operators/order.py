"""Places in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.sources.tables import written

PART_BITS = 33  # low bits of monotonically_increasing_id: the row's number within its partition


def numbered(df: DataFrame, *order: str | Column, by: tuple[str, ...] = (), name: str = "place") -> DataFrame:
    """`df` with each row's place (from 0) in `order`, within each value of the columns `by`.

    Rows are dealt by ranges of (by, order), sorted there and written with their number in the partition; the
    rows of each partition and `by` value are counted, and running sums of these counts, a row per
    partition and value, tell how many rows stand before a partition. So neither a hot `by` value nor a single
    task holds more than its share. Rows that are equal in `order` keep the order they came in, so that
    also a value that a third of all rows have is dealt out. Nulls come first, also in `by`. An empty table
    gives an empty one.
    """
    keys = [F.col(x).asc_nulls_first() for x in by] + [F.col(x).asc_nulls_first() if isinstance(x, str) else x for x in order]
    came = df.withColumn("_came", F.monotonically_increasing_id())
    dealt = came.repartitionByRange(*keys, "_came").sortWithinPartitions(*keys, "_came").drop("_came")
    rows = written(dealt.withColumn("_row", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumns({"_part": F.shiftright("_row", PART_BITS), "_nth": F.col("_row").bitwiseAND((1 << PART_BITS) - 1)}).drop("_row")
    sizes = rows.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_nth").alias("_first"))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", *by, (F.coalesce(F.sum("_n").over(ahead), F.lit(0)) - F.col("_first")).alias("_start"))
    starts = starts.toDF("_of_part", *(f"_of_{x}" for x in by), "_start")
    met = rows["_part"] == starts["_of_part"]
    for x in by:
        met = met & rows[x].eqNullSafe(starts[f"_of_{x}"])
    return rows.join(starts, met).select(*df.columns, (F.col("_start") + F.col("_nth")).alias(name))


def medians(df: DataFrame, value: str, by: tuple[str, ...] = (), name: str = "median", buckets: int = 1024) -> DataFrame:
    """(`by`, `name`): the exact median of `value` for each group, the mean of both middle values where their number is even.

    Selection by histograms: a group's range is cut into `buckets` equal parts, values are counted by part
    within tasks first, and the part with the middle one becomes the next range, until all its values are
    equal. So a round shuffles at most `buckets` small rows a group and task, and a group of any size is never in
    one place; two or three rounds do for values of like size, and each one splits off at least the
    smallest and the largest value. Nulls, NaN and infinite values are left out; a group without others has no row.
    """
    keys = list(by)
    v = F.col(value).cast("double")
    values = df.where(F.abs(v) < float("inf")).select(*keys, v.alias("_v"))
    whole = values.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).where("_n > 0")
    middle = F.array(*(F.struct(F.lit(i).alias("_side"), F.floor((F.col("_n") - 1 + i) / 2).alias("_rank")) for i in (0, 1)))
    state = written(whole.select(*keys, F.inline(middle), "_low", "_high").select(*keys, "_side", "_rank", "_low", "_high"), "ranges")
    while not (wide := state.where("_low < _high")).isEmpty():
        ranges = wide.toDF(*(f"_of_{x}" for x in keys), "_side", "_rank", "_low", "_high")
        met = (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))
        for x in keys:
            met = met & values[x].eqNullSafe(ranges[f"_of_{x}"])
        share = F.try_divide(F.col("_v") / 2 - F.col("_low") / 2, F.col("_high") / 2 - F.col("_low") / 2)  # halves, so that no range is too wide
        share = F.coalesce(share, F.when(F.col("_v") > F.col("_low"), 1.0).otherwise(0.0))  # of neighbours in a range that has no half
        part = F.least(F.floor(share * buckets), F.lit(buckets - 1)).alias("_part")
        held = values.join(F.broadcast(ranges) if not keys else ranges, met).groupBy(*keys, "_side", "_rank", part)
        counts = held.agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_side").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counts.withColumn("_before", before).where("_rank >= _before AND _rank < _before + _n")
        found = found.select(*keys, "_side", (F.col("_rank") - F.col("_before")).alias("_rank"), "_low", "_high")
        state = written(state.where("_low = _high").union(found), "ranges")
    return state.groupBy(*keys).agg(F.avg("_low").alias(name)).where(F.col(name).isNotNull())
