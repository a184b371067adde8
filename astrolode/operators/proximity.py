"""All pairs of points within a distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import METRICS, VantageTree
from ..storage import Scratch

#: Points that a cell of the partition is meant to hold, the most pivots (they go to every task), and the most points
#: and queries that one task joins at once.
CELL_ROWS, MOST_PIVOTS, BLOCK_ROWS = 2048, 1 << 14, 1 << 16


def _columns(batch, names: list[str]) -> np.ndarray:
    return np.stack([np.asarray(batch[c].to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch[c].to_numpy(), float) for c in names], 1)


def _close(metric: str, a: np.ndarray, b: np.ndarray, d: np.ndarray, radius: float) -> np.ndarray:
    """The exact test; for Euclidean distances without the root, so that no rounding decides about exact ties."""
    if metric != "euclidean":
        return d <= radius
    x = a - b
    return np.einsum("ij,ij->i", x, x) <= radius * radius


def apart(pivots: np.ndarray, least: float, distance) -> np.ndarray:
    """Those of the pivots, in their order, that are at least that far from all taken before."""
    taken = pivots[:1]
    for at in range(1, len(pivots), 64):
        block = pivots[at : at + 64]
        block = block[(distance(block[:, None, :], taken[None, :, :]) >= least).all(1)]
        while len(block):
            one, block = block[:1], block[1:]
            taken = np.concatenate([taken, one])
            block = block[distance(block, one) >= least]
    return taken


def radius_pairs(points: DataFrame, radius: float, *, coordinates: list[str], metric: str = "euclidean", cell_rows: int = CELL_ROWS, most_pivots: int = MOST_PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All pairs of a point of kind 0 with a point of kind 0 or 1 at a distance of at most radius.

    points: kind (0 or 1), id (long) and the coordinates. Result: id (a point of kind 0), near_kind, near_id and the
    coordinates of the second point; of two points of kind 0 the smaller id comes first, and points with one id make
    no pair. A pair may come out repeatedly if an id has several places. Points with a null, infinite or NaN
    coordinate, or without id, have no place and are left out. metric: euclidean (any number of coordinates) or
    great_circle (latitude and longitude in degrees, radius in km).

    1. Pivots are drawn from the points by a hash; those within 2 r of another are left out, so that a dense heap is one
       cell, cut into blocks, rather than many cells whose points are guests of each other. A Voronoi partition gives
       each point to its nearest pivot. The draw decides about the balance of the cells only.
    2. A point q of cell i also goes, as a guest, to each cell j < i that may hold a point o within the radius r: from
       d(q, o) <= r and d(o, p_j) <= d(o, p_i) follows d(q, p_j) <= d(q, p_i) + 2 r. For the Euclidean metric, q must
       also be within r of the plane halfway between the pivots. Each pair thus meets in exactly one cell.
    3. A vantage-point tree over each cell's own points answers its points and guests. Cells that got too many points
       are cut into blocks of points against blocks of queries.
    """
    spark = points.sparkSession
    scratch = Scratch(spark, "near")
    finite = F.col("id").isNotNull()
    for c in coordinates:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    points = scratch.write(points.select(F.col("kind").cast("byte").alias("kind"), F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in coordinates]).where(finite), "points")
    n = points.count()
    every = max(1, n // min(most_pivots, max(1, n // cell_rows)))
    drawn = points.where(F.pmod(F.xxhash64(*coordinates), F.lit(every)) == 0).select(*coordinates).distinct().limit(2 * most_pivots).collect()
    distance = METRICS[metric]
    pivots = apart(np.array(sorted(tuple(r) for r in drawn) or [(0.0,) * len(coordinates)], float), 2 * radius, distance)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = VantageTree(pivots, distance)
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                batch = whole.slice(at, 8192)
                x = _columns(batch, coordinates)
                own, near = tree.nearest(x)
                q, j, d = tree.within(x, near + 2 * radius)
                keep = j < own[q]
                q, j, d = q[keep], j[keep], d[keep]
                if metric == "euclidean" and q.size:
                    plane = (d**2 - near[q] ** 2) / np.maximum(2 * distance(pivots[j], pivots[own[q]]), 1e-300)
                    keep = plane <= radius * (1 + 1e-6) + 1e-6
                    q, j = q[keep], j[keep]
                rows = np.concatenate([np.arange(len(x)), q])
                cells = pa.array(np.concatenate([own, j]).astype(np.int32))
                guest = pa.array(np.arange(len(rows)) >= len(x))
                yield pa.RecordBatch.from_arrays([cells, guest, *[c.take(pa.array(rows)) for c in batch.columns]], ["cell", "guest", *batch.schema.names])

    kinds = ", ".join(f"{c} double" for c in coordinates)
    placed = scratch.write(points.mapInArrow(assign, f"cell int, guest boolean, kind byte, id long, {kinds}"), "placed")
    sizes = placed.groupBy("cell").agg(F.sum((~F.col("guest")).cast("long")).alias("own"), F.count(F.lit(1)).alias("all")).where(F.col("all") > block_rows)
    cuts = F.broadcast(sizes.select("cell", F.greatest(F.lit(1), F.ceil(F.col("own") / block_rows)).cast("int").alias("ko"), F.ceil(F.col("all") / block_rows).cast("int").alias("kq")))
    salt = lambda seed, k: F.pmod(F.xxhash64(F.lit(seed), "id", *coordinates), k.cast("long")).cast("int")
    one = F.lit(1)
    cut = placed.join(cuts, "cell", "left").withColumns({"ko": F.coalesce("ko", one), "kq": F.coalesce("kq", one)})
    # a point is held by one block of points in each block of queries, and asks in one block of queries
    spread = cut.withColumns({"bo": salt(1, F.col("ko")), "bq": salt(2, F.col("kq"))})
    role = lambda o, q, holds, asks: F.struct(o.alias("o"), q.alias("q"), holds.alias("holds"), asks.alias("asks"))
    series = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    held = F.when(F.col("guest"), F.array().cast("array<struct<o:int,q:int,holds:boolean,asks:boolean>>")).otherwise(F.transform(series("kq"), lambda q: role(F.col("bo"), q, F.lit(True), q == F.col("bq"))))
    asked = F.transform(F.filter(series("ko"), lambda o: F.col("guest") | (o != F.col("bo"))), lambda o: role(o, F.col("bq"), F.lit(False), F.lit(True)))
    ready = spread.withColumn("r", F.explode(F.concat(held, asked))).select("cell", F.col("r.o").alias("bo"), F.col("r.q").alias("bq"), F.col("r.holds").alias("holds"), F.col("r.asks").alias("asks"), "guest", "kind", "id", *coordinates)

    def join(group: pa.Table) -> pa.Table:
        x, kind, ids = _columns(group, coordinates), group["kind"].to_numpy(), group["id"].to_numpy()
        holds, asks, guest = (group[c].to_numpy().astype(bool) for c in ("holds", "asks", "guest"))
        got = []
        for of in (0, 1):
            own = np.flatnonzero(holds & (kind == of))
            # guests and owners meet owners of kind 0; owners of kind 1 are met by guests of kind 0, for the owners have been
            ask = np.flatnonzero(asks & (guest & (kind == 0) if of else np.ones(len(x), bool)))
            if not own.size or not ask.size:
                continue
            tree = VantageTree(x[own], distance)
            for at in range(0, ask.size, 4096):
                part = ask[at : at + 4096]
                q, p, d = tree.within(x[part], radius)
                q, p = part[q], own[p]
                keep = _close(metric, x[q], x[p], d, radius)
                if of == 0:
                    keep &= (kind[q] == 1) | ((ids[q] != ids[p]) & (guest[q] | (ids[q] < ids[p])))
                q, p = q[keep], p[keep]
                if of == 0:  # the second of the pair: of kind 1, or the greater id
                    swap = (kind[q] == 0) & (ids[q] > ids[p])
                    q, p = np.where(swap, p, q), np.where(swap, q, p)
                    first, second = np.where(kind[q] == 1, p, q), np.where(kind[q] == 1, q, p)
                else:
                    first, second = q, p
                got.append((first, second))
        first, second = (np.concatenate(z) for z in zip(*got, strict=True)) if got else (np.empty(0, np.int64),) * 2
        return pa.table([pa.array(ids[first], pa.int64()), pa.array(kind[second], pa.int8()), pa.array(ids[second], pa.int64()), *[pa.array(x[second, i], pa.float64()) for i in range(len(coordinates))]], ["id", "near_kind", "near_id", *coordinates])

    return ready.groupBy("cell", "bo", "bq").applyInArrow(join, f"id long, near_kind byte, near_id long, {kinds}")
