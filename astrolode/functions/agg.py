"""Aggregates whose rules differ between engines, under one name each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import C, _c


def min_by_held(value: C, *order: C) -> Column:
    """The value of the least order among rows whose value is not null; null orders are passed over."""
    key = F.struct(*[_c(o) for o in order]) if len(order) > 1 else _c(order[0])
    return F.min_by(_c(value), F.when(_c(value).isNotNull(), key))


def max_by_held(value: C, *order: C) -> Column:
    """The value of the greatest order among rows whose value is not null."""
    key = F.struct(*[_c(o) for o in order]) if len(order) > 1 else _c(order[0])
    return F.max_by(_c(value), F.when(_c(value).isNotNull(), key))


def count_tuples(*columns: C) -> Column:
    """Distinct combinations, those with nulls included."""
    return F.count_distinct(F.struct(*[_c(c) for c in columns]))


def listed(value: C, separator: str = ", ") -> Column:
    """Distinct non-null texts in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(_c(value))), separator)


def in_order_of(value: C, *order: C) -> Column:
    """All values as an array, in the order of the keys, then of the value."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*[_c(o).alias(f"o{i}") for i, o in enumerate(order)], _c(value).alias("v")))), lambda s: s["v"])


def modal(df: DataFrame, keys: list[str], value: str, *, name: str = "mode", tie: str = "low") -> DataFrame:
    """The most frequent non-null value per key, the lowest or highest of equally frequent ones, and its count.

    Values are counted before they move; a hot key costs as many rows as it has distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    if tie == "high":
        return counts.groupBy(*keys).agg(F.max(F.struct("__n", value)).alias("m")).select(*keys, F.col(f"m.{value}").alias(name), F.col("m.__n").alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("__n")).alias("c"), value)).alias("m")).select(*keys, F.col(f"m.{value}").alias(name), (-F.col("m.c")).alias("n"))


def first_by_priority(df: DataFrame, keys: list[str], columns: list[str], priority: str, tie: str) -> DataFrame:
    """Per key and column, the non-null value of the lowest priority, by the tie-break among equals."""
    return df.groupBy(*keys).agg(*[min_by_held(c, priority, tie).alias(c) for c in columns])


def wildcard_rollup(df: DataFrame, keys: list[str], wild: str, *aggregates: Column, star: str = "*") -> DataFrame:
    """Aggregates per keys and wild, and per keys alone with star in place of wild; a null in wild is not the star."""
    return (
        df.groupingSets([[F.col(c) for c in [*keys, wild]], [F.col(c) for c in keys]], *[F.col(c) for c in [*keys, wild]])
        .agg(F.grouping(wild).alias("__all"), *aggregates)
        .withColumn(wild, F.when(F.col("__all") == 1, star).otherwise(F.col(wild)))
        .drop("__all")
    )
