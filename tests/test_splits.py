"""Positions, which must be dense and unique on tables that no sampler sees whole, with further columns, too."""

import uuid

from pyspark import TaskContext
from pyspark.sql import functions as F

from retrievium.operators import splits
from retrievium.sources import connectors


def check(df, n, name):
    r = df.agg(F.count("*").alias("n"), F.count_distinct(name).alias("d"), F.min(name).alias("lo"), F.max(name).alias("hi")).first()
    assert (r.n, r.d, r.lo, r.hi) == (n, n, 0, n - 1)


def numbers(spark, n):
    return spark.range(0, n, 1, 16).select((F.col("id") * 7919 % n).alias("k"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("more"))


def test_positions_of_two_million_rows(spark):
    n = 2_000_000
    r = splits.dense_positions(numbers(spark, n), "k").agg(F.count("*").alias("n"), F.count_if(F.expr("pos <> k")).alias("wrong"), F.max("more")).first()
    assert (r.n, r.wrong) == (n, 0)


def test_batches_and_ids(spark):
    n = 200_000
    df = numbers(spark, n)
    b = splits.batches(df, "k", 1000)
    assert b.groupBy("batch").agg(F.count("*").alias("c"), F.max("more")).where("c <> 1000").count() == 0 and b.agg(F.max("batch")).first()[0] == n // 1000 - 1
    check(connectors.numbered(df, "k", "doc"), n, "original_id")
    old = df.select("k", F.concat(F.lit("d_"), F.col("more")).alias("doc_id"), "more")
    again = connectors.renumber(old, ["more", "k"])
    check(again.select("k", F.split_part("doc_id", F.lit("_"), F.lit(2)).cast("long").alias("i")), n, "i")


def test_positions_of_odd_tables(spark):
    empty = spark.createDataFrame([], "k string, v int")
    assert splits.dense_positions(empty, "k").count() == 0 and splits.batches(empty, "k", 3).count() == 0
    one = spark.createDataFrame([("b", 1)], "k string, v int")
    assert [r.pos for r in splits.dense_positions(one, "k").collect()] == [0]
    words = spark.createDataFrame([(w, None) for w in ("z", "", "ä", "Z", "\U0001f600", "￮", "a")], "k string, v int")
    got = [r.k for r in splits.dense_positions(words, "k").orderBy("pos").collect()]
    assert got == sorted((r.k for r in words.collect()), key=lambda w: w.encode())


def test_ranges_are_found_by_binary_search(spark):
    for n in (1, 2, 3, 7, 8, 9, 64):
        bounds = [10 * i for i in range(1, n + 1)]
        df = spark.range(0, 10 * n + 20)
        got = [r.p for r in df.select("id", splits.range_of(F.col("id"), bounds, df.schema["id"].dataType).alias("p")).orderBy("id").collect()]
        assert got == [min(i // 10, n) for i in range(10 * n + 20)]


def test_no_task_of_positions_reads_the_whole_table(spark, tmp_path):
    def noted(parts):
        n = 0
        for p in parts:
            n += len(p)
            yield p
        (tmp_path / uuid.uuid4().hex).write_text(f"{TaskContext.get().taskAttemptId()} {n}")

    df = spark.range(0, 8000, 1, 8).mapInPandas(noted, "id long")
    got = splits.dense_positions(df, "id").select(F.max("pos"), F.count("*")).first()
    by_task = {}
    for p in tmp_path.iterdir():
        task, n = map(int, p.read_text().split())
        by_task[task] = by_task.get(task, 0) + n
    assert tuple(got) == (7999, 8000) and max(by_task.values()) == 1000
