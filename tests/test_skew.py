import random

from conftest import rows
from pyspark.sql import functions as F

from astrolode.operators.skew import chunked_distinct, hottest, salted_join
from astrolode.storage import Scratch, numbered


def brute(data):
    out = {}
    for s, r, i in data:
        out.setdefault((s, r), set())
        if i is not None:
            out[s, r].add(i)
    return sorted(((*k, len(v)) for k, v in out.items()), key=repr)


def test_counts_across_chunks_of_any_size(spark):
    rng = random.Random(1)
    data = [(rng.choice([0, 0, 0, 1, 2, None]), rng.choice([0, 1]), rng.choice([*range(40), None])) for _ in range(3000)]
    df = spark.createDataFrame(data, "sector long, run int, item long").withColumn("__chunk", F.lit(9)).repartition(5)
    for size in (1, 7, 100, 10_000):
        assert rows(chunked_distinct(df, ["sector", "run"], "item", chunk_rows=size)) == brute(data)


def test_one_value_on_most_rows_is_spread(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), F.when(F.col("id") < 3000, 5).otherwise(F.col("id")).alias("v"))
    assert rows(chunked_distinct(df, ["k"], "v", chunk_rows=64)) == [(1, 1001)]


def test_empty(spark):
    df = spark.createDataFrame([], "k int, v long")
    assert rows(chunked_distinct(df, ["k"], "v")) == []


def test_numbered_is_dense_and_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartitionByRange(6, "v").sortWithinPartitions("v")
    assert [(r.v, r.row_no) for r in numbered(df, Scratch(spark, "t"), "n").orderBy("v").collect()] == [(i, i) for i in range(1000)]


def test_salted_join_equals_plain_join(spark):
    a = spark.createDataFrame([(1, i) for i in range(500)] + [(2, -1), (3, -2), (None, -3)], "k int, a int")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, b string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(salted_join(a, b, ["k"], how, rows_per_task=50)) == rows(a.join(b, ["k"], how))
    got = salted_join(a, b, ["k"], "left_anti", rows_per_task=50, condition=(F.col("a") > 100) & (F.col("b") == "y"))
    assert got.count() == 104


def test_thousands_of_hot_keys(spark, monkeypatch):
    a = spark.range(60_000).select((F.col("id") % 5000).alias("k"), F.col("id").alias("a")).unionAll(spark.createDataFrame([(None, -1), (9_999, -2)], "k long, a long"))
    b = spark.range(5001).select(F.col("id").alias("k"), (F.col("id") * 2).alias("b"))
    counts = a.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for most in (10_000, 700):  # all listed, or most of them joined
        hot = hottest(counts, ["k"], "n", rows_per_task=5, most=most)
        assert (hot.others is None) == (most == 10_000)
        split = hot.listed if hot.others is None else hot.listed.unionAll(hot.others)
        assert split.where("__parts = 3").count() == 5000
        for how in ("inner", "left", "left_anti"):
            assert rows(salted_join(a, b, ["k"], how, hot=hot)) == rows(a.join(b, ["k"], how))


def test_no_hot_key_needs_no_salt(spark):
    a, b = spark.range(50).withColumnRenamed("id", "k"), spark.range(9).withColumnRenamed("id", "k")
    assert "__salt" not in salted_join(a, b, ["k"])._jdf.queryExecution().toString()


def test_rows_are_not_moved_again_after_numbering(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    plan = chunked_distinct(df, ["k"], "v", chunk_rows=50)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("hashpartitioning") < plan.index("MapInArrow")  # from the top: states are exchanged, rows are not
    assert "hashpartitioning" not in plan[plan.index("MapInArrow") :]


def test_rows_with_null_keys_are_spread(spark):
    a = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("k"), F.col("id").alias("a"))
    b = spark.range(40).select(F.col("id").alias("k"), F.lit("x").alias("b")).unionAll(spark.createDataFrame([(None, "n")], "k long, b string"))
    for how in ("left", "left_anti", "inner", "left_semi"):
        assert rows(salted_join(a, b, ["k"], how)) == rows(a.join(b, ["k"], how))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [n for n in salted_join(a, b, ["k"], "left_anti").rdd.glom().map(len).collect() if n]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 2000 and len(sizes) > 1
