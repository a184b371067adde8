import math
import random

import numpy as np
from pyspark.sql import functions as F

from astrolode.functions.metrics import VantageTree, euclidean, great_circle
from astrolode.operators.proximity import apart, radius_pairs


def brute(points, radius, d):
    out = set()
    for k, i, *p in points:
        for m, j, *q in points:
            if k == 0 and i is not None and None not in p and None not in q and all(map(math.isfinite, p + q)) and d(p, q) <= radius:
                if m == 0 and j is not None and i < j:
                    out.add((i, 0, j, *q))
                elif m == 1:
                    out.add((i, 1, j, *q))
    return out


def clump(rng, n, spread, centres):
    out = []
    for i in range(n):
        c = rng.choice(centres)
        out.append((int(rng.random() < 0.3), i, *[round(v + rng.gauss(0, spread)) * 1.0 for v in c]))
    return out


def test_equals_brute_force_for_any_cells_and_blocks(spark):
    rng = random.Random(5)
    centres = [(0, 0, 0), (100, 50, -20), (30, 0, 10)]
    points = [p for p in clump(rng, 400, 12, centres) if True]
    points += [(0, 1000, None, 1.0, 2.0), (0, 1001, float("nan"), 0.0, 0.0), (1, 0, float("inf"), 0.0, 0.0), (0, None, 0.0, 0.0, 0.0), (0, 7, 0.0, 0.0, 0.0), (0, 8, 12.0, 0.0, 0.0), (0, 9, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(points, "kind int, id long, x double, y double, z double").withColumn("cell", F.lit("name clash"))
    want = brute(points, 12.0, lambda p, q: math.dist(p, q))
    for cell_rows, block in ((40, 1 << 16), (100, 25), (10_000, 60)):
        got = radius_pairs(df, 12.0, coordinates=["x", "y", "z"], cell_rows=cell_rows, block_rows=block).collect()
        assert len({tuple(r) for r in got}) == len(want) and {tuple(r) for r in got} == want


def test_great_circle(spark):
    rng = random.Random(6)
    points = [(int(i % 4 == 0), i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(300)]
    df = spark.createDataFrame(points, "kind int, id long, lat double, lon double")
    d = lambda p, q: float(great_circle(np.array(p), np.array(q)))
    got = {(r[0], r[1], r[2]) for r in radius_pairs(df, 900.0, coordinates=["lat", "lon"], metric="great_circle", cell_rows=30).collect()}
    assert got == {r[:3] for r in brute(points, 900.0, d)}


def test_empty_and_single(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0)], "kind int, id long, x double, y double, z double")
    assert radius_pairs(df, 5.0, coordinates=["x", "y", "z"]).count() == 0
    assert radius_pairs(df.limit(0), 5.0, coordinates=["x", "y", "z"]).count() == 0


def test_tree_with_equal_points():
    rng = np.random.default_rng(2)
    points = np.concatenate([np.zeros((200, 3)), rng.normal(size=(300, 3)), np.ones((100, 3))])
    q = rng.normal(size=(50, 3))
    tree = VantageTree(points)
    i, j, d = tree.within(q, 1.0)
    full = np.linalg.norm(q[:, None] - points[None], axis=2)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(full <= 1.0)), strict=True))
    assert np.allclose(tree.nearest(q)[1], full.min(1)) and (tree.nearest(q)[0] == full.argmin(1)).all()


def test_pivots_are_apart_and_near_every_point():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(0, 1, (2000, 3)), rng.normal(0, 300, (300, 3))])
    kept = apart(points, 24.0, euclidean)
    d = euclidean(kept[:, None], kept[None])
    assert (d[~np.eye(len(kept), dtype=bool)] >= 24).all()
    assert (euclidean(points[:, None], kept[None]).min(1) < 24).all() and len(apart(points[:1], 5.0, euclidean)) == 1
