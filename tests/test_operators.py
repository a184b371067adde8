import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from astrolode.operators import graphs, joins, merging, runs

XYZ = ["x", "y", "z"]


def test_merge_policies_and_idempotence(spark):
    t = spark.createDataFrame([(1, "a", None, 5, 1), (2, "b", "q", 5, 1), (3, "c", "r", 5, 1), (None, "n", None, 5, 1)], "k int, v string, f string, x int, y int")
    s = spark.createDataFrame([(1, "A", "F", None, 9), (2, "b", "Q", 7, 9), (4, "d", None, 1, 1), (None, "m", None, 5, 1)], "k int, v string, f string, x int, y int")
    policy = {"f": merging.FILL, "x": merging.NEWEST, "y": merging.KEEP}
    m = merging.merge(t, s, ["k"], policy)
    assert rows(m) == sorted([(1, "A", "F", 5, 1, "updated"), (2, "b", "q", 7, 1, "updated"), (3, "c", "r", 5, 1, "same"), (4, "d", None, 1, 1, "inserted"), (None, "m", None, 5, 1, "updated")], key=repr)
    again = merging.merge(m.drop("change"), s, ["k"], policy)
    assert rows(merging.counts(again)) == [("same", 5)]
    assert rows(merging.merge(t, s, ["k"], insert=False).where("k = 4")) == []
    empty = t.limit(0)
    assert {r.change for r in merging.merge(empty, s, ["k"]).collect()} == {"inserted"} and {r.change for r in merging.merge(t, empty, ["k"]).collect()} == {"same"}


def test_soft_delete_guard_and_small_merges(spark):
    t = spark.createDataFrame([(1, True, "edsm"), (2, True, "spansh"), (3, False, None)], "k int, listed boolean, src string")
    s = spark.createDataFrame([(2, True, "edsm"), (1, True, "spansh")], "k int, listed boolean, src string")
    gone = merging.merge(t, s.where("k = 2").select("k", "listed"), ["k"], absent={"listed": F.lit(False)})
    assert rows(gone.select("k", "listed", "change")) == [(1, False, "absent"), (2, True, "same"), (3, False, "same")]
    guarded = merging.merge(t, s, ["k"], guard=merging.ranked_guard("src", ["spansh", "edsm"]))
    assert rows(guarded.select("k", "src")) == [(1, "spansh"), (2, "spansh"), (3, None)]
    assert rows(merging.insert_new(t, s.withColumn("k", F.col("k") + 3), ["k"]).select("k")) == [(1,), (2,), (3,), (4,), (5,)]
    assert rows(merging.delete_stale(t, s, ["k"]).select("k")) == [(1,), (2,)]
    assert rows(merging.update_from(t, s, ["k"], ["src"], only_null=True).select("k", "src")) == rows(t.select("k", "src"))
    assert rows(merging.last_wins(t, s.union(s.withColumn("src", F.lit("z"))), ["k"], ["src"]).select("k", "src")) == [(1, "z"), (2, "z"), (3, None)]
    moved = merging.migrate(spark.createDataFrame([("5", "x")], "a string, gone string"), spark.createDataFrame([], "b long, c string"), {"a": "b"})
    assert rows(moved) == [(5, None)]
    assert rows(merging.orphans(t, "k", s, "k").select("k")) == [(3,)] and rows(merging.repeated_keys(t.union(t.where("k = 1")), ["k"])) == [(1, 2)]
    assert merging.difference(t, t).count() == 0 and rows(merging.difference(t, t.where("k < 3")).select("k", "side")) == [(3, "a")]
    assert rows(merging.checksums(t)) == rows(merging.checksums(t.repartition(3))) != rows(merging.checksums(s))


def test_special_joins(spark):
    runs_ = spark.createDataFrame([(1, 0, 300), (1, 300, 5), (2, 10, 0)], "r int, s long, n long")
    points = spark.createDataFrame([(1, 0), (1, 299), (1, 300), (1, 305), (2, 10), (3, 1)], "r int, p long")
    assert rows(joins.in_run(points, runs_, row="r", at="p", start="s", length="n").select("r", "p", "s")) == [(1, 0, 0), (1, 299, 0), (1, 300, 300)]
    assert rows(joins.runs_in_window(runs_, start="s", length="n", low=290, high=302)) == [(1, 290, 10), (1, 300, 2)]
    a = spark.createDataFrame([("x", "p"), ("q", "y")], "m string, n string")
    b = spark.createDataFrame([("x", 1), ("p", 1), ("y", 2)], "k string, id int").groupBy("id").agg(F.min("k").alias("k1"), F.max("k").alias("k2"))
    assert rows(joins.any_of_keys(a, b, [(F.col("m"), "k2"), (F.col("n"), "k1")], row=["m", "id"]).select("m", "id")) == [("q", 2), ("x", 1)]
    names = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "n string, id int")
    assert rows(joins.by_unique_name(spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "n string"), names, "n", "id")) == sorted([("a", 1), ("b", None), ("c", None), (None, None)], key=repr)
    cells = spark.createDataFrame([("k", "s", 5, 1.0), ("k", "t", 50, 2.0), ("k", "*", 55, 3.0)], "k string, w string, n int, v double")
    got = joins.with_fallback(spark.createDataFrame([("k", "s"), ("k", "t"), ("k", "u"), ("z", "s")], "k string, w string"), cells, ["k"], "w", ["v"], F.col("n") >= 20)
    assert rows(got.select("k", "w", "v")) == [("k", "s", 3.0), ("k", "t", 2.0), ("k", "u", 3.0), ("z", "s", None)]


def test_nearest(spark):
    rng = random.Random(1)
    pts = [(i, *[rng.uniform(-50, 50) for _ in range(3)], i % 3) for i in range(200)]
    known = spark.createDataFrame(pts[:120], "id int, x double, y double, z double, lab int")
    asked = spark.createDataFrame([p[:4] for p in pts[120:]] + [(999, None, 0.0, 0.0)], "id int, x double, y double, z double")
    d = lambda p, q: sum((a - b) ** 2 for a, b in zip(p[1:4], q[1:4], strict=True)) ** 0.5
    want = []
    for p in pts[120:]:
        near = sorted((d(p, q), q[4]) for q in pts[:120] if d(p, q) <= 40)[:5]
        votes = {lab: sum(1 for _, x in near if x == lab) for _, lab in near}
        if votes:
            want.append((p[0], min(votes, key=lambda v: (-votes[v], v))))
    assert rows(joins.nearest_votes(asked, known, ident="id", xyz=XYZ, label="lab", radius=40.0)) == sorted(want, key=repr)
    centres = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 9.0, 0.0, 0.0)], "c int, cx double, cy double, cz double")
    got = joins.nearest_centre(spark.createDataFrame([(4.5, 0.0, 0.0), (8.0, 0.0, 0.0), (None, 0.0, 0.0)], "x double, y double, z double"), centres, xyz=XYZ, centre_xyz=["cx", "cy", "cz"], centre="c")
    assert rows(got.select("c", "distance")) == sorted([(1, 4.5), (2, 1.0), (None, None)], key=repr)
    with pytest.raises(ValueError):
        joins.nearest_centre(asked, centres, xyz=XYZ, centre_xyz=["cx", "cy", "cz"], centre="c", most=1)


def test_runs(spark):
    df = spark.createDataFrame([([[[3, 7], [2, 0]], [[5, 1]]],)], "rows array<array<array<int>>>")
    got = runs.decode_rows(df, "rows")
    assert rows(got) == [(0, 0, 0, 3, 7), (0, 1, 3, 2, 0), (1, 0, 0, 5, 1)]
    assert rows(runs.starts(got.drop("start"), "row_no", "run_no", "length").select("row_no", "run_no", "start")) == [(0, 0, 0), (0, 1, 3), (1, 0, 0)]
    cells = runs.expand(got, "start", "length")
    assert cells.count() == 10 and rows(runs.encode(cells, "row_no", "at", "value").select("row_no", "start", "length", "value")) == [(0, 0, 3, 7), (0, 3, 2, 0), (1, 0, 5, 1)]
    s = spark.createDataFrame([("a", 1), ("a", 2), ("a", 6), ("b", 1), ("b", 90), ("c", 4), ("c", None)], "k string, n int")
    assert rows(runs.gaps(s, ["k"], "n", least_filled=0.3)) == [("a", 3, 5)] and runs.gaps(s, ["k"], "n").count() == 2


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "d"), ("a", None), ("q", "q")], "a string, b string")
    n = spark.createDataFrame([("a", 1), ("b", None), ("c", None), ("d", None), ("x", 2)], "n string, l int")
    got = graphs.spread_labels(n, e, node="n", label="l", a="a", b="b")
    assert rows(got) == [("a", 1), ("b", 1), ("c", None), ("d", 2), ("x", 2)] or rows(got) == [("a", 1), ("b", 1), ("c", 1), ("d", 2), ("x", 2)]
    assert rows(graphs.reach(spark.createDataFrame([("a",)], "n string"), e, node="n", a="a", b="b", hops=2)) == [("a", 0), ("b", 1), ("c", 2)]


def test_routes(spark):
    stars = [(f"s{i:02d}", i * 9.0, 0.0, 0.0) for i in range(1, 10)] + [("off", 45.0, 400.0, 0.0), ("s05", 45.0, 0.0, 0.0)]
    df = spark.createDataFrame(stars, "name string, x double, y double, z double")
    route = graphs.fewest_hops(df, (0.0, 0.0, 0.0), (90.0, 0.0, 0.0), 20.0)
    at = [0.0] + [h["x"] for h in route] + [90.0]
    assert len(route) == 4 and all(0 < b - a <= 20 for a, b in zip(at, at[1:], strict=False))
    assert graphs.fewest_hops(df, (0.0, 0.0, 0.0), (90.0, 0.0, 0.0), 8.0, over=1) == []
    path = graphs.greedy_path(df, (0.0, 0.0, 0.0), (81.0, 0.0, 0.0), 20.0)
    assert [p["name"] for p in path] == ["s02", "s04", "s06", "s08", "s09"]
    assert graphs.greedy_path(df, (0.0, 0.0, 0.0), (90.0, 0.0, 0.0), 5.0) == []


def test_not_in_buckets_newer_and_returning(spark, tmp_path):
    from astrolode.storage import Scratch

    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    others = spark.createDataFrame([(1,), (None,)], "o int")
    assert rows(joins.not_in(a, "k", others, "o")) == [] and rows(joins.not_in(a, "k", others.limit(0), "o")) == rows(a) and rows(joins.not_in(a, "k", others.where("o = 1"), "o")) == [(2,)]
    df = spark.createDataFrame([(i % 5 if i else None, i) for i in range(40)], "k long, v long")
    step = lambda d: d.groupBy("k").agg(F.sum("v").alias("s"))
    for n in (1, 3, 7):
        assert rows(merging.in_buckets(step, [df], "k", n, Scratch(spark, "b"))) == rows(step(df))
    held = spark.createDataFrame([(1, 10), (2, 20)], "id int, t int").withColumn("t", F.col("t").cast("timestamp"))
    more = spark.createDataFrame([(1, 25), (3, 15), (4, 21), (4, 22)], "id int, t int").withColumn("t", F.col("t").cast("timestamp"))
    assert rows(merging.newer_only(held, more, ["id"], "t").select("id")) == [(4,), (4,)] and rows(merging.newer_only(held, more, ["id"], "t", back="6 seconds").select("id")) == [(3,), (4,), (4,)]
    assert merging.newer_only(held.limit(0), more, ["id"], "t").count() == 4
    table, new = merging.returning(held, more, ["id"])
    assert sorted(r.id for r in new.collect()) == [3, 4] and table.count() == 4


def test_word_prefixes_and_exact_positions(spark):
    from astrolode.functions import windows

    t = spark.createDataFrame([("a b c",), ("a bc",), ("b",), ("",), (None,)], "t string")
    p = spark.createDataFrame([("a",), ("a b",), ("c",), ("b c",), ("",)], "p string")
    assert rows(joins.by_word_prefix(t, "t", p, "p")) == sorted([("", ""), ("a b c", "a"), ("a b c", "a b"), ("a bc", "a")], key=repr)
    assert rows(joins.by_word_prefix(t, "t", p, "p", suffix=True)) == [("", ""), ("a b c", "b c"), ("a b c", "c")]
    v = spark.createDataFrame([("x", float(i)) for i in (5, 1, 3, 2)] + [("x", None), ("y", 7.0), ("z", None)], "k string, v double")
    assert rows(windows.percentiles(v, ["k"], "v", {"mid": 0.5, "low": 0.0, "q": 0.25})) == [("x", 2.5, 1.0, 1.75), ("y", 7.0, 7.0, 7.0)]
    for size, n in ((7, 3), (2, 5), (9, 3)):
        got = rows(windows.tiles(spark.range(size), n, [F.desc("id")], "tile"))
        want = rows(spark.range(size).selectExpr("id", f"ntile({n}) OVER (ORDER BY id DESC)"))
        assert got == want
    assert windows.percentiles(v.limit(0), ["k"], "v", {"m": 0.5}).count() == 0 and windows.tiles(spark.range(0), 3, ["id"], "t").count() == 0


def test_templates_and_bearings(spark):
    from astrolode.functions import expr

    assert expr.fill_template("{{A}} ${c}", {"A": "x {{B}}", "B": "y"}, {"c": "col"}) == "x y col"
    for bad in (("{{A}}", {"A": "{{A}}"}, {}), ("{{Z}}", {}, {}), ("${c}", {}, {"c": "a; drop"})):
        with pytest.raises(ValueError):
            expr.fill_template(*bad)
    steps = [(0, 1, "N"), (1, 1, "NE"), (1, 0, "E"), (0, -1, "S"), (-1, 0, "W"), (-1, 1, "NW"), (0, 0, None)]
    df = spark.createDataFrame(steps, "x int, z int, said string")
    assert df.where(~expr.compass("x", "z").eqNullSafe(F.col("said"))).count() == 0
