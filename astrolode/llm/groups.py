"""One group identifier for all records that are linked directly or indirectly."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hottest, in_order, salted_join
from ..storage import Scratch, numbered

_WALK = "start long, came long, at long, back long, rank long, least long, ended boolean, turn int"
_NUMBER = itertools.count()

#: The smaller end of an edge first.
_ORDERED = ["least(u, v) AS u", "greatest(u, v) AS v"]

#: Edges of a core that one task solves; a greater core is contracted first.
CORE_EDGES = 1 << 20

#: The core is what is left when less than one in so many vertices can be stripped or compressed.
STRIPPED = 8


def linked_groups(pairs: DataFrame, a: str, b: str, *, core_edges: int = CORE_EDGES) -> DataFrame:
    """name and group_id (the smallest name of the group by byte order) for every name in a or b.

    Names get integer codes in byte order. Then, by turns:

    1. vertices with one edge are stripped and point to their neighbour;
    2. chains of vertices with two edges are compressed: by list ranking (pointer doubling along both directions) each
       chain finds its two ends, is replaced by one edge between them, and its vertices point to an end; a ring points
       to its smallest vertex;
    3. what neither of them makes much smaller is the core. One task solves a core of at most core_edges edges; a
       greater one is contracted: each vertex points to the neighbour of least random rank, and the trees of pointers
       become the vertices of a graph that goes through the same steps.

    Last, labels go back to the removed vertices, in the reverse order of the steps: a pointer leads to a vertex that was
    removed later, or never. Null and empty names are left out and link nothing; a name linked only to itself, or to
    null, stands alone. Repeated and reversed pairs and other columns change nothing. A vertex with any share of the
    edges is aggregated before it moves, or salted. Tables of the steps are written to the shared folder; only counts
    reach the driver.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "groups")
    ends = pairs.select(F.nullif(F.col(a), F.lit("")).alias("a"), F.nullif(F.col(b), F.lit("")).alias("b"))
    names = numbered(in_order(ends.select(F.explode(F.array("a", "b")).alias("name")).where("name IS NOT NULL").distinct(), ["name"]), scratch, "names", "code")
    links = ends.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    coded = salted_join(links, names.select(F.col("name").alias("a"), F.col("code").alias("u")), ["a"]).select("u", "b")
    coded = salted_join(coded, names.select(F.col("name").alias("b"), F.col("code").alias("v")), ["b"]).selectExpr(*_ORDERED)
    edges = scratch.write(coded, "edges")

    spent: list[DataFrame] = []  # tables that are not read any more once all have their roots
    pointers: list[DataFrame] = []  # child, parent; a vertex is a child at most once, and its parent none before
    turn = 0
    while True:
        near = scratch.write(_neighbours(edges), "near")
        spent.append(near)
        n, ones, twos, ends_ = near.agg(F.count(F.lit(1)), F.count_if(F.col("degree") == 1), F.count_if(F.col("degree") == 2), F.sum("degree")).first()
        if not n:
            break
        turn += 1
        old = edges
        if (ones + twos) * STRIPPED < n:
            if ends_ // 2 <= core_edges:
                pointers.append(scratch.write(_solved(edges), "core"))
                break
            pointer = _contract(edges, turn, scratch)
            pointers.append(pointer)
            root = lambda c: pointer.select(F.col("child").alias(c), F.col("parent").alias(f"{c}0"))  # noqa: B023, E731
            moved = edges
            for c in ("u", "v"):
                moved = salted_join(moved, root(c), [c], "left").withColumn(c, F.coalesce(f"{c}0", c)).drop(f"{c}0")
            edges = scratch.write(moved.where("u <> v").selectExpr(*_ORDERED).distinct(), "edges")
        elif ones and (turn % 2 or not twos):  # by turns: a long path or a bushy tree both lose a good part every two turns
            leaves = near.where("degree = 1").select(F.col("vertex").alias("leaf"), F.least("vertex", "low").alias("u"), F.greatest("vertex", "low").alias("v"))
            cut = leaves.groupBy("u", "v").agg(F.max("leaf").alias("child"))  # of two ends of a lone edge the greater goes
            pointers.append(cut.select("child", (F.col("u") + F.col("v") - F.col("child")).alias("parent")))
            edges = scratch.write(edges.join(cut.select("u", "v"), ["u", "v"], "left_anti"), "edges")
        else:
            pointer, bridges, done = _chains(near, scratch)
            pointers.append(pointer)
            spent.append(done)
            chain = near.where("degree = 2")
            cut = chain.select("vertex", F.explode(F.array("low", "high")).alias("other")).select(F.least("vertex", "other").alias("u"), F.greatest("vertex", "other").alias("v")).distinct()
            edges = scratch.write(edges.join(cut, ["u", "v"], "left_anti").unionByName(bridges).distinct(), "edges")
        scratch.drop(old)

    if not pointers:
        labelled = names.select("name", F.col("code").alias("least"))
    else:
        rooted = pointers[-1].select(F.col("child").alias("code"), F.col("parent").alias("root"))
        for pointer in pointers[-2::-1]:
            above = rooted.select(F.col("code").alias("parent"), "root")
            down = salted_join(pointer, above, ["parent"], "left").select(F.col("child").alias("code"), F.coalesce("root", "parent").alias("root"))
            rooted = rooted.unionByName(down)
        rooted = scratch.write(rooted, "rooted")
        for table in [*spent, *pointers, edges]:
            scratch.drop(table)
        least = rooted.groupBy("root").agg(F.min("code").alias("least"), F.count(F.lit(1)).alias("n")).select("root", F.least("root", "least").alias("least"), "n")
        least = scratch.write(least, "least")
        members = salted_join(rooted, least.drop("n"), ["root"], hot=hottest(least, ["root"], "n")).select("code", "least")
        labelled = names.join(members.unionByName(least.select(F.col("root").alias("code"), "least")), "code", "left").select("name", F.coalesce("least", "code").alias("least"))
        sizes = least.groupBy("least").agg(F.sum("n").alias("n"))
        return salted_join(labelled, names.select(F.col("code").alias("least"), F.col("name").alias("group_id")), ["least"], hot=hottest(sizes, ["least"], "n")).select("name", "group_id")
    return labelled.join(names.select(F.col("code").alias("least"), F.col("name").alias("group_id")), "least").select("name", "group_id")


def _solved(edges: DataFrame) -> DataFrame:
    """Pointers of all vertices to the smallest vertex of their group, in one task; edges are of a bounded number."""

    def solve(table: pa.Table) -> pa.Table:
        vertex, ends = np.unique(np.concatenate([table["u"].to_numpy(), table["v"].to_numpy()]), return_inverse=True)
        u, v = ends[: table.num_rows], ends[table.num_rows :]
        label = np.arange(vertex.size)
        while True:
            low = np.minimum(label[u], label[v])
            if (low == label[u]).all() and (low == label[v]).all():
                break
            for at in (u, v, label[u], label[v]):
                np.minimum.at(label, at, low)
            while (label[label] != label).any():
                label = label[label]
        moved = label != np.arange(vertex.size)
        return pa.table({"child": vertex[moved], "parent": vertex[label[moved]]})

    return edges.groupBy(F.lit(0).alias("one")).applyInArrow(solve, "child long, parent long")


def _neighbours(edges: DataFrame) -> DataFrame:
    """vertex, degree, and the smallest and greatest neighbour."""
    arcs = edges.select(F.inline(F.array(F.struct(F.col("u").alias("vertex"), F.col("v").alias("other")), F.struct(F.col("v").alias("vertex"), F.col("u").alias("other")))))
    return arcs.groupBy("vertex").agg(F.count(F.lit(1)).alias("degree"), F.min("other").alias("low"), F.max("other").alias("high"))


def _chains(near: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pointers of all vertices with two edges, an edge between the ends of each chain, and the table that both read.

    A walk is named by the vertex it starts at and the neighbour it comes from; it stands at ``at`` after ``rank``
    steps, having come from ``back``. Each turn a walk goes on by the walk that starts where it stands, so ranks double.
    Walks that have reached an end are kept apart: they are still gone on by, but not written again.
    """
    chain = near.where("degree = 2")
    one = lambda came, to: F.struct(F.col("vertex").alias("start"), F.col(came).alias("came"), F.col(to).alias("at"), F.col("vertex").alias("back"), F.lit(1).cast("long").alias("rank"), F.least("vertex", to).alias("least"), F.lit(False).alias("ended"))
    folder, turn, before = scratch.path(f"walks{next(_NUMBER)}"), 0, None
    chain.select(F.inline(F.array(one("low", "high"), one("high", "low")))).write.parquet(f"{folder}/turn=0")
    while True:
        # walks that ended are read where they were written; of the others only the last turn's are
        held = near.sparkSession.read.schema(_WALK).parquet(folder).where(F.col("ended") | (F.col("turn") == turn))
        onward = held.select(F.col("start").alias("at"), F.col("came").alias("back"), F.col("at").alias("at2"), F.col("back").alias("back2"), F.col("rank").alias("rank2"), F.col("least").alias("least2"), F.col("ended").alias("ended2"))
        new = held.where(~F.col("ended")).join(onward, ["at", "back"], "left").select(
            "start", "came", F.coalesce("at2", "at").alias("at"), F.coalesce("back2", "back").alias("back"), (F.col("rank") + F.coalesce("rank2", F.lit(0))).alias("rank"),
            F.least("least", F.coalesce("least2", "least")).alias("least"), F.coalesce("ended2", F.lit(True)).alias("ended"),
        )
        turn += 1
        new.write.parquet(f"{folder}/turn={turn}")
        walks = near.sparkSession.read.schema(_WALK).parquet(folder).where(F.col("ended") | (F.col("turn") == turn))
        state = tuple(walks.where("NOT ended").agg(F.count(F.lit(1)), F.sum(F.col("least").cast("decimal(38,0)"))).first())
        if not state[0] or state == before:  # only rings go on for ever; their least vertices no longer change
            break
        before = state
    done = walks.groupBy("start").agg(F.min("at").alias("u"), F.max("at").alias("v"), F.bool_and("ended").alias("ended"), F.min("least").alias("least"))
    done = scratch.write(done, "ended")
    scratch.drop_folder(folder)
    pointer = done.select(F.col("start").alias("child"), F.when(F.col("ended"), F.col("u")).otherwise(F.col("least")).alias("parent")).where("child <> parent")
    return pointer, done.where("ended AND u <> v").select("u", "v").distinct(), done


def _contract(edges: DataFrame, turn: int, scratch: Scratch) -> DataFrame:
    """Pointers of vertices to the roots of trees: each vertex first points to the neighbour of least rank below its own."""
    rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("rank"), F.col(c).alias("id"))
    arcs = edges.select(F.inline(F.array(F.struct(F.col("u").alias("child"), rank("v").alias("to")), F.struct(F.col("v").alias("child"), rank("u").alias("to")))))
    best = arcs.groupBy("child").agg(F.min("to").alias("to")).where(F.col("to") < rank("child"))
    return _to_roots(scratch.write(best.select("child", F.col("to.id").alias("parent")), "hooks"), scratch)


def _to_roots(forest: DataFrame, scratch: Scratch) -> DataFrame:
    """Doubles pointers until each leads to a vertex that points nowhere."""
    while True:
        above = forest.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
        joined = salted_join(forest, above, ["parent"], "left")
        new = scratch.write(joined.select("child", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "forest")
        moved = new.where("moved").limit(1).count()
        scratch.drop(forest)
        forest = new.drop("moved")
        forest._astrolode_path = new._astrolode_path
        if not moved:
            return forest
