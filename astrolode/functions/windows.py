"""Window idioms: pick one, top k, shares, exclusive running sums, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.skew import in_order
from ..storage import Scratch, numbered


def pick_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order; Spark keeps one row per key and partition before it shuffles."""
    return top_k(df, keys, 1, *order)


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str | None = None) -> DataFrame:
    """The first k rows of each key; with ``rank``, their numbers from 1 are kept in a column of that name."""
    out = df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__rank") <= k)
    return out.withColumnRenamed("__rank", rank) if rank else out.drop("__rank")


def only_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key stands on no other row. Counted before the rows meet their count."""
    once = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")
    return df.join(once, keys, "left_semi")


def share(value: str, *keys: str) -> Column:
    """value over the sum of its partition."""
    return F.col(value).cast("double") / F.nullif(F.sum(value).over(W.partitionBy(*keys)).cast("double"), F.lit(0.0))


def before(value: str, keys: list[str], *order: Column) -> Column:
    """The sum of the rows before this one (0 at the first)."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.sum(value).over(w) - F.col(value)


def allocate(df: DataFrame, existing: DataFrame, ident: str, order: list[str]) -> DataFrame:
    """df with its null ids filled by successive numbers above the greatest id of either side, in the given order.

    The rows without an id are brought into the order and numbered exactly where they lie; no task sees all of them.
    """
    top = existing.select(F.max(ident).alias("m")).unionAll(df.select(F.max(ident))).select(F.coalesce(F.max("m"), F.lit(0)).alias("__top"))
    new = numbered(in_order(df.where(F.col(ident).isNull()), order, nulls_last=True), Scratch(df.sparkSession, "ids"), "new", "__no")
    given = new.crossJoin(F.broadcast(top)).withColumn(ident, F.col("__top") + F.col("__no") + 1).drop("__top", "__no")
    return df.where(F.col(ident).isNotNull()).unionByName(given)


def tiles(df: DataFrame, n: int, order: list[Column | str], name: str) -> DataFrame:
    """df with the number, from 1 to n, of the part of equal size that a row falls into in a total order (NTILE).

    The first parts hold one row more where n doesn't divide the rows. Rows are numbered where they lie.
    """
    placed = numbered(in_order(df, order), Scratch(df.sparkSession, "tiles"), "ordered", "__no")
    size, more = divmod(placed._astrolode_rows, n)
    no = F.col("__no")
    late = F.lit(more + 1) + F.floor((no - more * (size + 1)) / max(size, 1))
    return placed.withColumn(name, F.when(no < more * (size + 1), F.floor(no / (size + 1)) + 1).otherwise(late).cast("long")).drop("__no")


def percentiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """keys and, for each name, the exact percentile of the non-null values, interpolated between the two around it.

    Rows are put in the order of keys and value and numbered; a key's percentiles lie at known numbers, so no task needs
    the values of a key together, whatever share of the rows it holds.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__value"))
    placed = numbered(in_order(rows, [*keys, "__value"]), Scratch(df.sparkSession, "order"), "ordered", "__no")
    spans = placed.groupBy(*keys).agg(F.min("__no").alias("__first"), F.count(F.lit(1)).alias("__n"))
    asked = spans.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("name"), (F.lit(float(f)) * (F.col("__n") - 1)).alias("at")) for k, f in fractions.items()])).alias("a"), "__first")
    asked = asked.select("__first", F.col("a.name").alias("name"), F.col("a.at").alias("at"), F.explode(F.array_distinct(F.array(F.floor("a.at"), F.ceil("a.at")))).alias("place"))
    asked = asked.select("name", "at", "place", (F.col("__first") + F.col("place")).alias("__no"))
    share = F.when(F.ceil("at") == F.floor("at"), 1.0).when(F.col("place") == F.floor("at"), F.ceil("at") - F.col("at")).otherwise(F.col("at") - F.floor("at"))
    return placed.join(asked, "__no").groupBy(*keys).agg(*[F.sum(F.when(F.col("name") == k, F.col("__value") * share)).alias(k) for k in fractions])
