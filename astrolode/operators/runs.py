"""Runs of equal values, and gaps in numbered series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def decode_rows(df: DataFrame, rows: str, *, row: str = "row_no") -> DataFrame:
    """Of an array of rows of [length, value] runs: row, run_no, start, length, value; start is the exclusive prefix sum."""
    lines = df.select(F.posexplode(rows).alias(row, "__runs"))
    runs = lines.select(row, F.posexplode("__runs").alias("run_no", "__run"), "__runs")
    start = F.aggregate(F.slice("__runs", F.lit(1), F.col("run_no")), F.lit(0), lambda a, r: a + r[0])
    return runs.select(row, "run_no", start.alias("start"), F.col("__run")[0].alias("length"), F.col("__run")[1].alias("value"))


def starts(runs: DataFrame, row: str, order: str, length: str, start: str = "start") -> DataFrame:
    """Runs with the sum of the lengths before them in their row."""
    w = W.partitionBy(row).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return runs.withColumn(start, F.sum(length).over(w) - F.col(length))


def encode(df: DataFrame, row: str, at: str, value: str) -> DataFrame:
    """Successive positions with equal value as runs: row, start, length, value. A missing position ends a run."""
    order = W.partitionBy(row).orderBy(at)
    new = ~(F.lag(value).over(order).eqNullSafe(F.col(value)) & (F.lag(at).over(order) == F.col(at) - 1))
    islands = df.withColumn("__run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return islands.groupBy(row, "__run", value).agg(F.min(at).alias("start"), F.count(F.lit(1)).alias("length")).select(row, "start", "length", value)


def expand(runs: DataFrame, start: str, length: str, at: str = "at") -> DataFrame:
    """One row per position of each run; runs without length give none."""
    return runs.where(F.col(length) > 0).withColumn(at, F.explode(F.sequence(F.col(start), F.col(start) + F.col(length) - 1))).drop(start, length)


def gaps(df: DataFrame, keys: list[str], number: str, *, least_filled: float = 0.0) -> DataFrame:
    """Runs of missing numbers between the least and the greatest of each key: keys, first, last.

    Only keys with at least the given share of their numbers present are looked at. Gaps stay ranges: a wide gap costs
    one row, and exploding is left to the caller.
    """
    rows = df.where(F.col(number).isNotNull()).select(*keys, number).distinct()
    filled = rows.groupBy(*keys).agg(F.min(number).alias("__a"), F.max(number).alias("__b"), F.count(F.lit(1)).alias("__n"))
    dense = filled.where((F.col("__b") > F.col("__a")) & (F.col("__n") / (F.col("__b") - F.col("__a") + 1) >= least_filled)).select(*keys)
    following = F.lead(number).over(W.partitionBy(*keys).orderBy(number))
    stepped = rows.join(dense, keys, "left_semi").withColumn("__next", following).where(F.col("__next") > F.col(number) + 1)
    return stepped.select(*keys, (F.col(number) + 1).alias("first"), (F.col("__next") - 1).alias("last"))
