"""Iteration over links: labels that spread, bounded reach, routes of the fewest hops, greedy paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import distance3, in_spheroid
from ..storage import Scratch
from .joins import cube_of, grid_pairs
from .skew import hottest, salted_join


def _both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("from"), F.col(b).alias("to"))
    return e.unionAll(e.select(F.col("to").alias("from"), F.col("from").alias("to"))).distinct()


def spread_labels(nodes: DataFrame, edges: DataFrame, *, node: str, label: str, a: str, b: str, passes: int = 12) -> DataFrame:
    """nodes with labels filled in from neighbours, as far as all labelled neighbours of a node agree.

    Each pass looks at the labels of the pass before; it ends when nothing changes or after ``passes``. Known labels
    never change; a node whose neighbours disagree gets none, and passes nothing on, until they agree.
    """
    scratch = Scratch(nodes.sparkSession, "labels")
    arcs = scratch.write(_both_ways(edges, a, b), "arcs")
    held = scratch.write(nodes.select(node, label), "held")
    for _ in range(passes):
        known = held.where(F.col(label).isNotNull()).select(F.col(node).alias("from"), label)
        told = salted_join(arcs, known, ["from"]).groupBy("to").agg(F.min(label).alias("__low"), F.max(label).alias("__high")).where("__low = __high")
        new = held.join(told.select(F.col("to").alias(node), "__low"), node, "left").select(node, F.coalesce(label, "__low").alias(label), (F.col(label).isNull() & F.col("__low").isNotNull()).alias("__new"))
        new = scratch.write(new, "held")
        changed = new.where("__new").count()
        held = new.drop("__new")
        if not changed:
            break
    return nodes.drop(label).join(held, node, "left").select(nodes.columns)


def reach(starts: DataFrame, edges: DataFrame, *, node: str, a: str, b: str, hops: int = 8) -> DataFrame:
    """node and the least number of hops (0 for starts) of every node within that many hops."""
    scratch = Scratch(starts.sparkSession, "reach")
    arcs = scratch.write(_both_ways(edges, a, b), "arcs")
    seen = scratch.write(starts.select(node).where(F.col(node).isNotNull()).distinct().withColumn("hops", F.lit(0)), "seen")
    for n in range(1, hops + 1):
        front = seen.where(F.col("hops") == n - 1).select(F.col(node).alias("from"))
        new = salted_join(arcs, front, ["from"], "left_semi").select(F.col("to").alias(node)).distinct().join(seen, node, "left_anti").withColumn("hops", F.lit(n))
        new = scratch.write(new, "new")
        if not new.limit(1).count():
            break
        seen = scratch.write(seen.unionByName(new), "seen")
    return seen


def fewest_hops(stars: DataFrame, start: Sequence[float], goal: Sequence[float], jump: float, *, name: str = "name", xyz: Sequence[str] = ("x", "y", "z"), over: int = 4, first_jump: float | None = None) -> list[dict]:
    """A route from start to goal of the fewest jumps of at most that length, over the stars; [] if none has that few.

    Breadth first by level: a level joins the stars not yet reached with the front by cubes of space. No route of n
    jumps leaves the spheroid of width n jumps around the two ends, so stars outside of it are left out, and those from
    which the goal is out of reach with the jumps that are left are not followed. n begins at the straight distance
    and is widened by up to ``over``. Of several ways to a star the nearest predecessor (then the lesser name) is kept;
    the last star is the one closest to the goal. Repeated names count once. The result is as long as the route; an empty
    one says that no route takes at most ``over`` jumps more than the straight line.
    """
    spark = stars.sparkSession
    scratch = Scratch(spark, "route")
    cols = list(xyz)
    direct = sum((g - s) ** 2 for s, g in zip(start, goal, strict=True)) ** 0.5
    floor = max(1, -(-int(direct * 1e6) // int(jump * 1e6)))
    total = (floor + over) * jump
    near = scratch.write(stars.select(name, *cols).where(in_spheroid(cols, start, goal, total)).groupBy(name).agg(*[F.min(c).alias(c) for c in cols]), "near")
    crowded = hottest(near.groupBy(*cube_of(cols, jump)).agg(F.count(F.lit(1)).alias("n")), ["__i", "__j", "__k"], "n")
    step = lambda df: df.select(F.col(name).alias("__from"), *[F.col(c).alias(f"__{c}") for c in cols])
    levels: list[DataFrame] = []
    front = spark.createDataFrame([("", *map(float, start))], f"{name} string, " + ", ".join(f"{c} double" for c in cols))
    left = near
    for n in range(1, floor + over + 1):
        reachable = (first_jump or jump) if n == 1 else jump
        if n > 1 or direct > reachable:
            pairs = grid_pairs(left, step(front), reachable, left_xyz=cols, right_xyz=[f"__{c}" for c in cols], hot=crowded if reachable == jump else None)
            new = pairs.groupBy(name, *cols).agg(F.min(F.struct("distance", "__from")).alias("by")).select(name, *cols, F.col("by.__from").alias("via"))
            new = scratch.write(new.where(distance3(cols, list(goal)) <= (floor + over - n) * jump), f"level{n}")
        else:
            return [{"name": None, "jump": 1, "distance": direct}]
        levels.append(new)
        last = new.orderBy(distance3(cols, list(goal)), name).limit(1).collect()
        if not last:
            return []
        if distance3_of(last[0], cols, goal) <= jump:
            hops, want = [], last[0][name]
            for k in range(n, 0, -1):
                row = levels[k - 1].where(F.col(name) == want).first()
                hops.append({"name": row[name], "jump": k, **{c: row[c] for c in cols}})
                want = row["via"]
            return hops[::-1]
        left = scratch.write(left.join(new.select(name), name, "left_anti"), "left")
        front = new.select(name, *cols)
    return []


def distance3_of(row, columns: Sequence[str], goal: Sequence[float]) -> float:
    return sum((row[c] - g) ** 2 for c, g in zip(columns, goal, strict=True)) ** 0.5


def greedy_path(stations: DataFrame, start: Sequence[float], goal: Sequence[float], reach_ly: float, *, name: str = "name", xyz: Sequence[str] = ("x", "y", "z"), least: float = 0.5, arrived: float = 1.0, most: int = 100) -> list[dict]:
    """Hops that each go to the place within reach that is closest to the goal, until arrived, stuck, or after ``most``.

    The candidates are filtered by a box and a sphere around the place reached, which prunes the scan.
    """
    at, out, cols = list(map(float, start)), [], list(xyz)
    while len(out) < most and sum((a - g) ** 2 for a, g in zip(at, goal, strict=True)) ** 0.5 > arrived:
        inside = F.lit(True)
        for c, a in zip(cols, at, strict=True):
            inside = inside & F.col(c).between(a - reach_ly, a + reach_ly)
        hop = distance3(cols, at)
        to_go = distance3(cols, list(goal))
        now = sum((a - g) ** 2 for a, g in zip(at, goal, strict=True)) ** 0.5
        best = stations.where(inside & (hop <= reach_ly) & (hop >= least) & (to_go < now)).orderBy(to_go, name).select(name, *cols).limit(1).collect()
        if not best:
            break
        at = [best[0][c] for c in cols]
        out.append({"name": best[0][name], "hop": len(out) + 1, **dict(zip(cols, at, strict=True))})
    return out


def components(edges: DataFrame, *, a: str, b: str, most: int = 60) -> DataFrame:
    """node and the least node that it is linked to, directly or not; both columns of one ordered type.

    Each turn takes the least label among neighbours and then the label of that label, so clusters of a wide span take
    few turns. Raises if labels still change after ``most`` turns.
    """
    scratch = Scratch(edges.sparkSession, "components")
    arcs = scratch.write(_both_ways(edges, a, b), "arcs")
    held = scratch.write(arcs.groupBy("from").agg(F.min("to").alias("low")).select(F.col("from").alias("node"), F.least("from", "low").alias("label")), "held")
    for _ in range(most):
        told = salted_join(arcs, held.select(F.col("node").alias("from"), "label"), ["from"]).groupBy("to").agg(F.min("label").alias("low"))
        near = held.join(told.select(F.col("to").alias("node"), "low"), "node").select("node", F.least("label", "low").alias("new"), F.col("label").alias("old"))
        near = scratch.write(near, "near")
        above = near.select(F.col("node").alias("new"), F.col("new").alias("above"))
        step = salted_join(near, above, ["new"], "left").select("node", F.least("new", "above").alias("label"), (F.least("new", "above") != F.col("old")).alias("moved"))
        step = scratch.write(step, "held")
        held = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return held
    raise RuntimeError(f"labels still change after {most} turns")
