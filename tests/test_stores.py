"""The prediction log, the committed sink and the functions for SQL text."""

import os

import pytest
from pyspark.sql import functions as F
from test_functions import DATES, NUMBERS

from parchment.functions import sql
from parchment.functions.dates import parse_date
from parchment.functions.numbers import parse_number
from parchment.functions.search import best_windows
from parchment.sources import committed
from parchment.sources.log import PredictionLog

COLUMNS = "key string, value string, error string, seq bigint"


@pytest.fixture
def log(spark, request):
    held = PredictionLog(spark, f"log_{request.node.name[5:25]}", buckets=3, columns=COLUMNS)
    yield held
    for g in held.generations():
        spark.sql(f"DROP TABLE {held.path(g)}")


def rows(spark, *held):
    return spark.createDataFrame([(k, v, None, s) for k, v, s in held], COLUMNS)


def last(log):
    return {r["key"]: r["value"] for r in log.latest().collect()}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_last_record_of_a_key_counts(spark, log):
    assert last(log) == {}
    assert log.append(rows(spark, ("a", "a0", 0), ("b", "b0", 0), ("b", "b1", 1), (None, "n", 0)), 0)
    assert log.append(rows(spark, ("a", "a1", 0)), 1)
    assert last(log) == {"a": "a1", "b": "b1", None: "n"}
    assert log.append(rows(spark, ("b", "b2", 0), ("b", "b3", 1), ("c", "c", 0)), 0)  # the batch anew
    assert last(log) == {"a": "a1", "b": "b3", "c": "c"} and log.records().count() == 4
    assert log.append(rows(spark), 2) and len(last(log)) == 3
    with pytest.raises(ValueError, match="numbered"):
        log.append(rows(spark), -1)
    with pytest.raises(ValueError, match="table name"):
        PredictionLog(spark, "a; DROP")


def test_compaction_keeps_what_counts(spark, log):
    for i in range(3):
        log.append(rows(spark, ("a", f"a{i}", 0), (f"k{i}", "x", 0)), i)
    before = last(log)
    assert log.compact() == 1 and last(log) == before and log.records().count() == 4 and log.generations() == [1]
    assert not log.append(rows(spark, ("a", "old", 0)), 2) and last(log) == before
    assert log.append(rows(spark, ("a", "new", 0)), 3) and last(log)["a"] == "new"
    log.create(2)  # a compaction that was broken off
    assert log.current() == 1 and last(log)["a"] == "new"
    assert log.compact() == 3 and log.generations() == [3] and last(log)["a"] == "new"
    assert log.compact() == 4 and not log.append(rows(spark), 3)


def test_killed_run_goes_on_where_it_stopped(spark, log):
    samples = spark.createDataFrame([(f"s{i}",) for i in range(8)], "key string")
    asked = spark.sparkContext.accumulator(0)

    def predict(some, broken=False):
        def answer(key):
            asked.add(1)
            if broken and key > "s5":
                raise RuntimeError("killed")
            return key.upper()

        return some.withColumns({"value": F.udf(answer)("key"), "error": F.lit(None).cast("string"), "seq": F.lit(0).cast("bigint")})

    log.resume(samples.where("key < 's3'"), predict)
    with pytest.raises(Exception, match="killed"):
        log.resume(samples, lambda x: predict(x, broken=True))
    assert len(last(log)) == 3  # nothing of the broken batch
    before = asked.value
    done = {r["key"]: r["value"] for r in log.resume(samples, predict).collect()}
    assert done == {f"s{i}": f"S{i}" for i in range(8)} and asked.value - before == 5
    assert {r["key"]: r["value"] for r in log.resume(samples, predict).collect()} == done and log.records().count() == 8


def test_the_log_is_not_shuffled(spark, log):
    log.append(rows(spark, *((f"k{i}", "v", 0) for i in range(50))), 0)
    assert "Exchange" not in plan_of(log.latest())
    samples = spark.createDataFrame([(f"k{i}",) for i in range(40, 60)], "key string")
    plan = plan_of(log.pending(samples))
    assert plan.count("Exchange") == 1 and "Bucketed: true" in log.pending(samples)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert log.pending(samples).count() == 10


def test_runs_appear_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    nested = spark.range(20).select("id", F.struct(F.lit("x").alias("a"), F.array("id").alias("b")).alias("s"), F.create_map(F.lit("k"), "id").alias("m"), F.lit("2024-01-02").cast("date").alias("d"), F.lit(None).cast("double").alias("n"))
    with pytest.raises(FileNotFoundError):
        committed.read_committed(spark, path)
    committed.write_committed(nested.repartition(3), path, "one")
    committed.write_committed(nested.where("id < 5"), path, "two")
    assert committed.read_committed(spark, path).count() == 25 and committed.read_committed(spark, path, "two").count() == 5
    assert committed.read_committed(spark, path, "one").orderBy("id").collect() == nested.orderBy("id").collect()
    committed.write_committed(nested.where("id < 7"), path, "two")  # the run again
    assert committed.read_committed(spark, path).count() == 27
    committed.write_committed(nested.where("id < 2"), path, "all", mode="overwrite")
    assert committed.read_committed(spark, path).count() == 2
    committed.write_committed(nested.where("id < 0"), path, "none")
    assert committed.read_committed(spark, path, "none").schema.simpleString() == nested.schema.simpleString() and committed.read_committed(spark, path).count() == 2
    with pytest.raises(Exception, match="not a name"):
        committed.write_committed(nested, path, "../x")


def test_failed_jobs_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    good = spark.range(10)
    committed.write_committed(good, path, "good")
    bad = spark.range(0, 1000, 1, 4).withColumn("id", F.udf(lambda x: 1 // (x - 999) and x, "long")("id"))
    with pytest.raises(Exception, match="division"):
        committed.write_committed(bad, path, "bad")
    assert committed.read_committed(spark, path).count() == 10
    assert os.listdir(f"{path}/_runs") == ["good.json"]
    os.makedirs(f"{path}/data/dead-1")  # as a driver leaves it that died, and tasks that end after the abort
    assert committed.sweep(path) == 0 and committed.sweep(path, 0.0) >= 1 and committed.read_committed(spark, path).count() == 10
    assert all(x.startswith("good-") for x in os.listdir(f"{path}/data"))
    writer = committed.CommittedWriter({"path": path, "run": "x"}, good.schema, False)
    os.makedirs(f"{path}/{writer.attempt}")
    writer.abort([committed.Part(f"{writer.attempt}/a.parquet", 1, 1), None])
    assert len(os.listdir(f"{path}/data")) == 1 and committed.read_committed(spark, path).count() == 10


def test_sql_functions_read_as_column_functions(spark):
    sql.register(spark)
    odd = ["-", "()", "- 5", "1,2,3", "0,123", ",5", "٣", "5- ", "31.12.99", "1 may 70", "May 1, 1899", "2024/2/30", "x\t1.5"]
    texts = [x for x, _ in NUMBERS + DATES] + odd
    spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").createOrReplaceTempView("odd_texts")
    got = spark.sql("SELECT i, parse_number(x), parse_date(x) FROM odd_texts WHERE i >= 0 ORDER BY i")
    plain = spark.table("odd_texts").select("i", parse_number(F.col("x")), parse_date(F.col("x"))).orderBy("i")
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in plain.collect()]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert spark.sql("SELECT count(*) FROM odd_texts WHERE parse_number(x) > 1000").first()[0] > 0


def test_best_windows_from_sql(spark):
    sql.register(spark)
    page = ["acme trading", "main street 5", "total 12.50", "acme trading"]
    lines = [(d, 0, k, x, 10.0 * k, 10.0 * k + 8) for d in (1, 2) for k, x in enumerate(page[d - 1 :])]
    spark.createDataFrame(lines, "doc_id long, page int, line_no int, text string, y0 double, y1 double").createOrReplaceTempView("page_lines")
    wishes = [(1, 0, "acme trading main street"), (1, 0, "acme trading"), (2, 0, "main stret 5"), (2, 0, ""), (3, 0, "acme")]
    spark.createDataFrame(wishes, "doc_id long, page int, wanted string").createOrReplaceTempView("wishes")
    got = spark.sql("""
        SELECT b.* FROM best_windows(TABLE(
            SELECT doc_id, page, line_no, loose_text(text) AS text, y0, y1, CAST(NULL AS STRING) AS wanted FROM page_lines
            UNION ALL SELECT doc_id, page, NULL, NULL, NULL, NULL, loose_text(wanted) FROM wishes
        ) PARTITION BY (doc_id, page) ORDER BY line_no) AS b""")
    found = {(r["doc_id"], r["wanted"]): (r["line_no"], r["lines"], r["score"]) for r in got.collect()}
    assert set(found) == {(d, w) for d, _, w in wishes if w and d < 3}
    for (d, wanted), best in found.items():
        held = page[d - 1 :]
        assert best == best_windows([wanted], [held], [[10.0 * k for k in range(len(held))]], [[10.0 * k + 8 for k in range(len(held))]], 6)[0]
    assert found[1, "acme trading"] == (0, 1, 100.0)
