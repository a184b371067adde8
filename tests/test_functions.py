import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from astrolode.functions import agg, expr, windows


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("__pad"))
    return df.select(column.alias("v")).first().v


def test_scalars(spark):
    assert [one(spark, expr.as_int("x"), x=v) for v in ("0.5", "1.5", "-2.5", "abc", "", None)] == [0, 2, -2, None, None, None]
    assert one(spark, expr.replace_first("x", "[ab]", "*"), x="cabba") == "c*bba"
    assert one(spark, expr.ratio("a", "b"), a=1, b=0) is None and one(spark, expr.ratio("a", "b"), a=1, b=4) == 0.25
    assert one(spark, expr.blank_to_null("x"), x="  ") is None
    assert -(1 << 32) <= one(spark, expr.stable_id("x"), x=" Sol ") < 0 and one(spark, expr.stable_id("x"), x="sol") == one(spark, expr.stable_id("x"), x=" SOL")
    assert one(spark, expr.shrunk_ratio("o", "e"), o=0, e=80) == 0.2 and one(spark, expr.shrunk_ratio("o", "e"), o=500, e=80) == 1.0
    assert one(spark, expr.logistic("x"), x=-1e9) > 0 and one(spark, expr.logistic("x"), x=0.0) == 0.5
    assert [one(spark, expr.banded("x", [1, 5], ["a", "b", "c"]), x=v) for v in (0.0, 1.0, 4.9, 5.0)] == ["a", "b", "b", "c"]
    assert [one(spark, expr.stepped("x", 20, 100, 440), x=v) for v in (5.0, 119.9, 120.0, 999.0)] == [100, 100, 120, 440]
    assert one(spark, expr.title_words("x"), x="  the ring  OF fire ") == "The Ring of Fire"
    assert [one(spark, expr.without_prefix("x", "p"), x=v, p="Sol") for v in ("Sol", "Sol A 1", "Solar")] == ["", "A 1", "Solar"]


def test_space(spark):
    assert one(spark, expr.distance3(["x", 0.0, 0.0], [0.0, 3.0, 4.0]), x=0.0) == 5.0
    t, off = expr.along(["x", 1.0, 0.0], (0.0, 0.0, 0.0), (10.0, 0.0, 0.0))
    assert one(spark, t, x=5.0) == 0.5 and one(spark, off, x=5.0) == 1.0
    assert one(spark, expr.in_spheroid(["x", 0.0, 0.0], (0.0, 0.0, 0.0), (10.0, 0.0, 0.0), 10.0), x=4.0) and not one(spark, expr.in_spheroid(["x", 0.1, 0.0], (0.0, 0.0, 0.0), (10.0, 0.0, 0.0), 10.0), x=4.0)
    assert one(spark, expr.great_circle("a", 0.0, 0.0, 0.0, 1.0), a=90.0) == pytest.approx(math.pi / 2)
    wide = spark.range(1).select(expr.half_width(100.0, 100.0), expr.half_width(100.0, 200.0), expr.half_width(100.0, 90.0)).first()
    assert wide[0] == 0 == wide[2] and wide[1] == pytest.approx(math.sqrt(100**2 - 50**2))
    x, y, z = expr.galactic_xyz("p", 90.0, 0.0)
    assert one(spark, x, p=3261.56) == pytest.approx(-1.0) and one(spark, z, p=3261.56) == pytest.approx(0.0, abs=1e-12) and one(spark, y, p=3261.56) == 0


def test_addresses_round_trip(spark):
    rng = random.Random(4)
    data = []
    for _ in range(300):
        m = rng.randrange(8)
        x, y, z, n = rng.randrange(1 << (14 - m)), rng.randrange(1 << (13 - m)), rng.randrange(1 << (14 - m)), rng.randrange(1000)
        a = m | z << 3 | y << (17 - m) | x << (30 - 2 * m) | n << (44 - 3 * m)
        data.append((a, "abcdefgh"[m], x, y, z, n, (x >> (7 - m)) + 128 * (y >> (7 - m)) + 16384 * (z >> (7 - m))))
    df = spark.createDataFrame(data, "a long, m string, x long, y long, z long, n long, s long")
    got = df.select("a", expr.mass_code("a"), *expr.boxel_cell("a"), expr.boxel_number("a"), expr.sector_of("a"))
    assert rows(got) == sorted(data, key=repr)
    centre = df.select(expr.sector_at(*expr.boxel_centre("a")).alias("c"), "s")
    assert centre.where("c <> s").count() == 0
    assert one(spark, expr.boxel_letters("n"), n=27 + 676) == "BB-B"
    p = expr.name_parts("x")
    assert [one(spark, p[k], x="Koramm Dorarg UE-O c20-7") for k in p] == ["Koramm Dorarg", "UE-O", "c", 20, 7] and one(spark, p["sector"], x="Sol") is None


def test_aggregates(spark):
    df = spark.createDataFrame([("k", None, 1), ("k", "b", 2), ("k", "a", 3), ("k", "a", None), ("n", None, 1)], "k string, v string, o int")
    got = df.groupBy("k").agg(agg.min_by_held("v", "o"), agg.max_by_held("v", "o"), agg.count_tuples("v", "o"), agg.listed("v", "+"))
    assert rows(got) == [("k", "b", "a", 4, "a+b"), ("n", None, None, 1, "")]
    assert rows(agg.modal(df, ["k"], "v")) == [("k", "a", 2)]
    ties = spark.createDataFrame([("k", 1), ("k", 2)], "k string, v int")
    assert rows(agg.modal(ties, ["k"], "v")) == [("k", 1, 1)] and rows(agg.modal(ties, ["k"], "v", tie="high")) == [("k", 2, 1)]
    wild = spark.createDataFrame([("a", None), ("a", "x")], "k string, w string")
    assert rows(agg.wildcard_rollup(wild, ["k"], "w", F.count(F.lit(1)).alias("n"))) == [("a", "*", 2), ("a", "x", 1), ("a", None, 1)]


def test_windows(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "k string, v int")
    assert rows(windows.top_k(df, ["k"], 1, F.asc("v"))) == [("a", 1), ("b", 2)]
    assert rows(windows.only_unique(df, ["k"])) == [("b", 2)]
    assert rows(df.select("v", windows.before("v", ["k"], F.asc("v")).alias("b"))) == [(1, 0), (2, 0), (3, 1)]
    new = spark.createDataFrame([("x", None), ("y", 9), ("w", None)], "n string, id long")
    assert rows(windows.allocate(new, spark.createDataFrame([(11,)], "id long"), "id", ["n"])) == [("w", 12), ("x", 13), ("y", 9)]
    assert rows(windows.allocate(new.limit(0), spark.createDataFrame([], "id long"), "id", ["n"])) == []
