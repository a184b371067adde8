"""Joins that are more than one equality."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import distance3
from ..storage import Scratch
from .skew import Hot, salted_join


def any_of_keys(left: DataFrame, right: DataFrame, pairs: list[tuple[Column, str]], *, row: list[str]) -> DataFrame:
    """Rows of left with each row of right that one of several equalities matches, once each.

    pairs: an expression of left and a column of right. ``row`` identifies the rows of both sides together. A condition
    with OR would compare all pairs; here each equality is a join of its own and repeats are dropped.
    """
    parts = [left.withColumn("__k", k).join(right, F.col("__k") == right[c]).drop("__k") for k, c in pairs]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(row)


def by_word_prefix(df: DataFrame, text: str, prefixes: DataFrame, prefix: str, *, suffix: bool = False) -> DataFrame:
    """df with every row of prefixes whose prefix, up to the end of one of its words, the text begins with (or ends with).

    A text is brought to each of its beginnings of whole words, the text itself included, so that the join is one on
    equal texts; no pair is compared that doesn't match. Null texts and prefixes match nothing.
    """
    words = F.split(F.col(text), " ")
    n = F.size(words)
    some = (lambda i: F.array_join(F.slice(words, n - i + 1, i), " ")) if suffix else (lambda i: F.array_join(F.slice(words, 1, i), " "))
    starts = df.where(F.col(text).isNotNull()).withColumn("__start", F.explode(F.transform(F.sequence(F.lit(1), n), some)))
    return starts.join(prefixes.withColumn("__start", F.col(prefix)), "__start").drop("__start")


def not_in(df: DataFrame, key: str, others: DataFrame, other: str) -> DataFrame:
    """The rows of df whose key is not among the others, with the rules of NOT IN.

    A null among the others leaves no row; without any others all rows stay; else rows with a null key go. The nulls are
    counted, and one row with the count is all that goes to every task.
    """
    told = others.agg(F.count(F.lit(1)).alias("__all"), F.count_if(F.col(other).isNull()).alias("__nulls"))
    known = others.select(F.col(other).alias("__other")).where("__other IS NOT NULL").distinct()
    rows = df.crossJoin(F.broadcast(told)).where((F.col("__all") == 0) | ((F.col("__nulls") == 0) & F.col(key).isNotNull())).drop("__all", "__nulls")
    return rows.join(known, F.col(key) == F.col("__other"), "left_anti")


def in_run(points: DataFrame, runs: DataFrame, *, row: str, at: str, start: str, length: str, cell: int = 256) -> DataFrame:
    """points with the run of the same row that covers them: start <= at < start + length; runs of a row may overlap.

    Runs are put into the cells of that width that they touch, so the join is one on equal (row, cell); a cell with very
    many points is spread over several tasks.
    """
    cells = runs.where(F.col(length) > 0).withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor((F.col(start) + F.col(length) - 1) / cell))))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(start) + F.col(length))
    return salted_join(points.withColumn("__cell", F.floor(F.col(at) / cell)), cells, [row, "__cell"]).where(inside).drop("__cell")


def runs_in_window(runs: DataFrame, *, start: str, length: str, low: int, high: int) -> DataFrame:
    """Runs that overlap [low, high), clipped to it."""
    end = F.col(start) + F.col(length)
    cut = runs.where((F.col(start) < high) & (end > low))
    return cut.withColumns({start: F.greatest(F.col(start), F.lit(low)), length: F.least(end, F.lit(high)) - F.greatest(F.col(start), F.lit(low))})


def cube_of(columns: list[str], edge: float) -> list[Column]:
    """The cube of space with that edge that a place lies in."""
    return [F.floor(F.col(c) / F.lit(edge)).alias(k) for k, c in zip(("__i", "__j", "__k"), columns, strict=True)]


def grid_pairs(left: DataFrame, right: DataFrame, radius: float, *, left_xyz: list[str], right_xyz: list[str], box: bool = False, hot: Hot | None = None) -> DataFrame:
    """Pairs within a radius (or within a box of that half width), with their distance.

    Space is cut into cubes with the radius as edge; the right side goes to its own and the 26 cubes around it. A cube
    with very many rows of the left side is spread over several tasks; hot: hottest() of the cubes, where it is known.
    The columns of both sides must have different names. Rows with a null coordinate make no pair.
    """
    cube = lambda c: F.floor(F.col(c) / F.lit(radius))
    axes = ["__i", "__j", "__k"]
    a = left.na.drop(subset=left_xyz).select("*", *cube_of(left_xyz, radius))
    b = right.na.drop(subset=right_xyz)
    for k, c in zip(axes, right_xyz, strict=True):
        b = b.withColumn(k, F.explode(F.sequence(cube(c) - 1, cube(c) + 1)))
    pairs = salted_join(a, b, axes, hot=hot).drop(*axes).withColumn("distance", distance3(left_xyz, right_xyz))
    if box:
        near = reduce(Column.__and__, [F.abs(F.col(p) - F.col(q)) < radius for p, q in zip(left_xyz, right_xyz, strict=True)])
        return pairs.where(near)
    return pairs.where(F.col("distance") <= radius)


def nearest_centre(df: DataFrame, centres: DataFrame, *, xyz: list[str], centre_xyz: list[str], centre: str, most: int = 100_000) -> DataFrame:
    """df with its nearest centre (the lowest of equally near ones) and the distance; centres must be at most ``most``.

    The centres go to every task as one sorted array column; each row looks through it once, without a cross join.
    Rows with a null coordinate get null.
    """
    listed = centres.na.drop(subset=centre_xyz).limit(most + 1).agg(F.array_sort(F.collect_list(F.struct(F.col(centre).alias("id"), *[F.col(c).cast("double").alias(k) for k, c in zip("xyz", centre_xyz, strict=True)]))).alias("__centres"))
    n = centres.limit(most + 1).count()
    if n > most:
        raise ValueError(f"{n} centres or more; use radius_pairs() for sets without a bound")
    d = lambda c: distance3(xyz, [c["x"], c["y"], c["z"]])
    best = F.array_min(F.transform("__centres", lambda c: F.struct(d(c).alias("distance"), c["id"].alias("id"))))
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in xyz])
    out = df.crossJoin(F.broadcast(listed)).withColumn("__best", F.when(known, best))
    return out.withColumns({centre: F.col("__best.id"), "distance": F.col("__best.distance")}).drop("__best", "__centres")


def by_unique_name(df: DataFrame, names: DataFrame, name: str, ident: str) -> DataFrame:
    """df with the id of its name, null where the name is unknown or belongs to several ids."""
    unique = names.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(ident).alias(ident), F.max(ident).alias("__high")).where(F.col(ident) == F.col("__high")).drop("__high")
    return df.join(unique, name, "left")


def with_fallback(df: DataFrame, cells: DataFrame, keys: list[str], wild: str, values: list[str], enough: Column, *, star: str = "*") -> DataFrame:
    """df with values of its own cell where that cell has enough support, else of the cell with star in place of wild.

    cells: keys, wild, values, unique by keys and wild. enough: a condition on the columns of cells.
    """
    own = cells.where(F.col(wild) != star).where(enough).select(*keys, wild, *[F.col(v).alias(f"__own_{v}") for v in values], F.lit(True).alias("__own"))
    rest = cells.where(F.col(wild) == star).select(*keys, *[F.col(v).alias(f"__all_{v}") for v in values])
    out = df.join(own, [*keys, wild], "left").join(rest, keys, "left")
    return out.withColumns({v: F.when(F.col("__own"), F.col(f"__own_{v}")).otherwise(F.col(f"__all_{v}")) for v in values}).drop("__own", *[f"__{p}_{v}" for p in ("own", "all") for v in values])


#: Known points and asked rows, at most, that a task compares at once.
VOTE_BLOCK = 1 << 15


def nearest_votes(unknown: DataFrame, known: DataFrame, *, ident: str, xyz: list[str], label: str, k: int = 5, radius: float | None = None, first: float | None = None, block: int = VOTE_BLOCK) -> DataFrame:
    """ident and the label that most of the k nearest known points have (the lowest of equal ones), however far they are.

    With a radius only points within it vote, and rows without any are absent.

    Known points at equal distances count in the order of their label. Where there are fewer than k known points, all of
    them vote. Rows and points without a finite place are left out. ident and label are numbers.
    """
    b = known.select(F.col(label).cast("long").alias("__label"), *[F.col(c).alias(f"__{c}") for c in xyz]).where("__label IS NOT NULL")
    near = _k_nearest(unknown.select(F.col(ident).cast("long").alias(ident), *xyz), b, ident=ident, xyz=xyz, k=k, first=radius or first, block=block, once=radius is not None)
    votes = near.groupBy(ident, "label").agg(F.count(F.lit(1)).alias("__n"))
    return votes.groupBy(ident).agg(F.min(F.struct((-F.col("__n")).alias("n"), "label")).alias("m")).select(F.col(ident).cast(unknown.schema[ident].dataType), F.col("m.label").cast(known.schema[label].dataType).alias(label))


def _k_nearest(asked: DataFrame, known: DataFrame, *, ident: str, xyz: list[str], k: int, first: float | None, block: int, once: bool = False) -> DataFrame:
    """ident and label of the k nearest known points (of all, if there are fewer) of each asked row.

    Known points are looked for in a ring that doubles from ``first``, by default half the edge of a cube that would hold
    k of them if they were spread evenly. A row with k of them within the ring is settled,
    for all others are farther away; only the rest goes on to the next ring, so a wide ring is met by rows of sparse
    regions alone. The asked rows go to the 27 cubes around them. Of one cube a row keeps its k nearest points only, so
    that a dense heap gives no more rows than an empty region; cubes with many points or rows are cut into blocks. once:
    nothing beyond the first ring is looked for.
    """
    scratch = Scratch(asked.sparkSession, "nearest")
    finite = lambda cols: reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in cols])
    near_xyz, axes = [f"__{c}" for c in xyz], ["__i", "__j", "__k"]
    known = scratch.write(known.where(finite(near_xyz)), "known")
    left = scratch.write(asked.where(finite(xyz)), "left")
    settled: list[DataFrame] = []
    enough = min(k, known.count())
    ring = first
    if not ring and enough:
        low, high = known.agg(F.array(*[F.min(c) for c in near_xyz]), F.array(*[F.max(c) for c in near_xyz])).first()
        room = 1.0
        for a, b in zip(low, high, strict=True):
            room *= max(b - a, 1e-3)
        ring = max((room * k / known.count()) ** (1 / 3) / 2, 1e-6)
    while enough and left.limit(1).count():
        cube = lambda c: F.floor(F.col(c) / F.lit(ring))  # noqa: B023, E731
        a = left
        for axis, c in zip(axes, xyz, strict=True):
            a = a.withColumn(axis, F.explode(F.sequence(cube(c) - 1, cube(c) + 1)))
        b = known.withColumns({axis: cube(c) for axis, c in zip(axes, near_xyz, strict=True)})
        both = b.select(*axes).distinct().join(a.select(*axes).distinct(), axes)  # no group has only one side
        a, b = (salted_join(x, both, axes, "left_semi") for x in (a, b))
        crowded = lambda df, name: df.groupBy(*axes).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name)).where(F.col(name) > 1)
        cuts = scratch.write(crowded(b, "ko").join(crowded(a, "kq"), axes, "full"), "cuts")  # one row for each ``block`` points or rows
        one, blocks = F.lit(1), ["__o", "__q"]
        spread = lambda c, n: F.pmod(F.xxhash64(*c), n.cast("long")).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        ko, kq = F.coalesce("ko", one), F.coalesce("kq", one)
        a = a.join(F.broadcast(cuts), axes, "left").withColumn("__q", spread([ident, *xyz], kq)).withColumn("__o", every(ko)).drop("ko", "kq")
        b = b.join(F.broadcast(cuts), axes, "left").withColumn("__o", spread(["__label", *near_xyz], ko)).withColumn("__q", every(kq)).drop("ko", "kq")
        found = a.groupBy(*axes, *blocks).cogroup(b.groupBy(*axes, *blocks)).applyInArrow(_nearest_of(ident, xyz, enough, ring), f"`{ident}` long, label long, distance double")
        ranked = found.select(ident, "label", F.row_number().over(W.partitionBy(ident).orderBy("distance", "label")).alias("__r")).where(F.col("__r") <= enough)
        near = scratch.write(ranked, "near")
        if once:
            return near
        full = near.where(F.col("__r") == enough).select(ident)
        settled.append(near.join(full, ident, "left_semi"))
        left = scratch.write(left.join(full, ident, "left_anti"), "left")
        ring *= 2
    return reduce(DataFrame.unionByName, settled) if settled else asked.sparkSession.createDataFrame([], f"`{ident}` long, label long")


def _nearest_of(ident: str, xyz: list[str], k: int, ring: float):
    """Of each row, the k nearest points of a block that lie within the ring; equally near ones by their label."""

    def nearest(rows: pa.Table, points: pa.Table) -> pa.Table:
        place = lambda t, cols: np.stack([np.asarray(t[c].to_numpy(), float) for c in cols], 1)
        q, p = place(rows, xyz), place(points, [f"__{c}" for c in xyz])
        ids, labels = rows[ident].to_numpy(), points["__label"].to_numpy()
        order = np.argsort(labels, kind="stable")
        p, labels = p[order], labels[order]
        got = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        step = max(1, (1 << 21) // max(1, len(p)))
        for at in range(0, len(q) if len(p) else 0, step):
            diff = [q[at : at + step, i, None] - p[None, :, i] for i in range(len(xyz))]
            d = np.sqrt(sum(x * x for x in diff))
            if d.shape[1] > k:  # the k-th distance, then all that tie with it, in the order of their labels
                limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                r, c = np.nonzero(d <= np.minimum(limit, ring))
            else:
                r, c = np.nonzero(d <= ring)
            near = d[r, c]
            by = np.lexsort((c, near, r))
            r, c, near = r[by], c[by], near[by]
            place_in_row = np.arange(r.size) - np.searchsorted(r, r)
            keep = place_in_row < k
            got.append((ids[at + r[keep]], labels[c[keep]], near[keep]))
        who, label, far = (np.concatenate(x) for x in zip(*got, strict=True))
        return pa.table({ident: pa.array(who, pa.int64()), "label": pa.array(label, pa.int64()), "distance": pa.array(far, pa.float64())})

    return nearest
