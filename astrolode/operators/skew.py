"""Results per key where a few keys hold most rows.

``chunked_distinct`` numbers the rows of a global order exactly and works on chunks of equal size, whatever keys they
hold; the ordered states of the chunks are merged at the end. ``salted_join`` spreads the hot keys of a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import Scratch, numbered

#: Hot keys that are sent to every task; beyond these, hot keys are joined. Parts for rows with null keys.
MOST_LISTED, NULL_PARTS = 10_000, 64


def in_order(df: DataFrame, order: list[Column | str], *, nulls_last: bool = False) -> DataFrame:
    """df in range partitions of about equal size, sorted in each; equal rows may be spread over several of them."""
    by = [F.col(c).asc_nulls_last() if nulls_last and isinstance(c, str) else c for c in order]
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("short")
    return df.withColumn("__spread", spread).repartitionByRange(*by, "__spread").drop("__spread").sortWithinPartitions(*by)


def chunked_distinct(df: DataFrame, keys: list[str], item: str, *, chunk_rows: int = 1 << 17, name: str = "n") -> DataFrame:
    """Number of distinct non-null values of item for each combination of keys, by exact offset chunking.

    1. Rows are put in the order of keys and item; a tie-break lets even the copies of one row fill several partitions.
    2. Rows are counted per partition; with the prefix sums of these counts each row gets its number in the order.
    3. Each task reduces the rows that it reads, as they lie in order, to a state for each key and chunk of chunk_rows
       successive numbers: where it begins, the distinct values, the least and the greatest. Rows are not moved again.
    4. A value that goes over the border of two states is counted by both. The states of a key, in the order of their
       beginnings, are merged: one is taken off where a state begins with the value that the one before ended with.

    A task reads a part of a file, whatever share of the rows one key or one value holds; a key that holds n rows has
    n / chunk_rows states to merge, and a few more where files are parted. Null keys are keys of their own; a key with
    only null items gets 0. Empty input gives no rows. Columns other than keys and item are ignored.
    """
    scratch = Scratch(df.sparkSession, "chunks")
    rows = df.select(*keys, F.col(item).alias("__item"))
    chunked = numbered(in_order(rows, [*keys, "__item"]), scratch, "ordered", "__no")
    kind = chunked.schema["__item"].dataType.simpleString()
    key_kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunked.select(*keys).schema)
    names = [*keys, "__no", "__n", "__first", "__last"]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last state, which the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            states = _states(batch.select([*keys, "__item", "__no"]), keys, chunk_rows)
            held = states if held is None else _joined(held, states, keys, chunk_rows)
            if held.num_rows > 1:
                yield held.slice(0, held.num_rows - 1).select(names)
                held = held.slice(held.num_rows - 1)
        if held is not None:
            yield held.select(names)

    states = chunked.mapInArrow(reduce, f"{key_kinds}, __no long, __n long, __first {kind}, __last {kind}")
    ordered = W.partitionBy(*keys).orderBy("__no")
    # a state with only null items comes before all others of its key
    same = (F.lag("__last").over(ordered) == F.col("__first")).cast("long")
    return states.withColumn("__same", F.coalesce(same, F.lit(0))).groupBy(*keys).agg(F.sum(F.col("__n") - F.col("__same")).cast("long").alias(name))


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two columns differ; nulls are equal to each other."""
    unlike = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(unlike, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _states(batch: pa.RecordBatch, keys: list[str], chunk_rows: int) -> pa.RecordBatch:
    """One state for each run of rows with the same keys, in one chunk, with successive numbers; __end: the number after it."""
    n = batch.num_rows
    no, item = batch["__no"].to_numpy(), batch["__item"]
    new = np.ones(n, bool)
    new[1:] = (np.diff(no) != 1) | (np.diff(no // chunk_rows) != 0)
    for k in keys:
        new[1:] |= _differs(batch[k].slice(1), batch[k].slice(0, n - 1))
    first = new.copy()
    first[1:] |= _differs(item.slice(1), item.slice(0, n - 1))
    held = pc.is_valid(item).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    counts = np.add.reduceat((first & held).astype(np.int64), starts)
    nulls = np.add.reduceat((~held).astype(np.int64), starts)  # they come first
    least = item.take(pa.array(np.minimum(starts + nulls, ends - 1)))
    return pa.RecordBatch.from_arrays(
        [*[batch[k].take(pa.array(starts)) for k in keys], pa.array(no[starts]), pa.array(counts), least, item.take(pa.array(ends - 1)), pa.array(no[ends - 1] + 1)],
        [*keys, "__no", "__n", "__first", "__last", "__end"],
    )


def _joined(held: pa.RecordBatch, states: pa.RecordBatch, keys: list[str], chunk_rows: int) -> pa.RecordBatch:
    """The state held and those of the next rows, as one where the first of them goes on with it."""
    a, b = held.to_pylist()[0], states.slice(0, 1).to_pylist()[0]
    if a["__end"] == b["__no"] and a["__no"] // chunk_rows == b["__no"] // chunk_rows and all(a[k] == b[k] for k in keys):
        one = a | {"__n": a["__n"] + b["__n"] - (a["__last"] is not None and a["__last"] == b["__first"]), "__last": b["__last"], "__end": b["__end"]}
        if a["__first"] is None:
            one["__first"] = b["__first"]
        held, states = pa.RecordBatch.from_pylist([one], schema=states.schema), states.slice(1)
    return pa.Table.from_batches([held, states]).combine_chunks().to_batches()[0]


@dataclass(frozen=True)
class Hot:
    """Keys with very many rows and the parts (``__parts``) to split them into: a listed few, and all others."""

    listed: DataFrame | None = None
    others: DataFrame | None = None


def hot_keys(df: DataFrame, on: list[str], *, rows_per_task: int = 100_000) -> Hot:
    """All keys with over rows_per_task rows. df is read once to count them."""
    return hottest(df.groupBy(*on).agg(F.count(F.lit(1)).alias("__rows")), on, "__rows", rows_per_task=rows_per_task)


def hottest(counts: DataFrame, on: list[str], rows: str, *, rows_per_task: int = 100_000, most: int = MOST_LISTED) -> Hot:
    """hot_keys() of counts that are known already: one row per key, and its number of rows.

    The ``most`` keys with the most rows are listed, and the list is sent to every task. If there are more, each of the
    others has at most a ``most``-th of all rows.
    """
    spark = counts.sparkSession
    over = counts.where(F.col(rows) > rows_per_task).select(*on, F.ceil(F.col(rows) / rows_per_task).cast("int").alias("__parts"))
    top = over.orderBy(F.desc("__parts"), *on).limit(most + 1).collect()
    if not top:
        return Hot()
    listed = spark.createDataFrame(top[:most], over.schema)
    if len(top) <= most:
        return Hot(listed)
    return Hot(listed, Scratch(spark, "hot").write(over.join(F.broadcast(listed.select(*on)), on, "left_anti")))


def _parted(df: DataFrame, on: list[str], hot: Hot) -> DataFrame:
    """df with __parts, null for keys that are not hot. Only rows whose key isn't listed are joined by key."""
    out = df.join(F.broadcast(hot.listed), on, "left")
    if hot.others is None:
        return out
    rest = out.where("__parts IS NULL").drop("__parts").join(hot.others, on, "left")
    return out.where("__parts IS NOT NULL").unionByName(rest)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", *, spread: Column | None = None, rows_per_task: int = 100_000, condition: Column | None = None, hot: Hot | None = None) -> DataFrame:
    """left join right on equal columns, where some keys may hold a large share of left.

    Rows of every key with over rows_per_task rows are spread over several tasks by a hash, and the rows of right with
    these keys are repeated for each; without such keys it is a plain join. ``how`` is inner, left, left_semi or
    left_anti. condition may use columns of both sides whose names differ. Rows with null keys match nothing; where they
    stay, they are spread as well. hot: the
    result of hottest(), where counts are at hand; else left is read once more, at once, to count its keys.
    """
    hot = hot_keys(left.na.drop(subset=on), on, rows_per_task=rows_per_task) if hot is None else hot
    keys, spread = on, F.xxhash64(*left.columns) if spread is None else spread
    stays = how in ("left", "left_anti")  # rows with null keys stay; a join would send all of them to one task
    alone = reduce(Column.__or__, [F.col(c).isNull() for c in on]) if stays else F.lit(False)
    nulls = F.pmod("__spread", F.lit(NULL_PARTS))
    if hot.listed is not None:
        salt = F.when(alone, nulls).otherwise(F.coalesce(F.pmod("__spread", F.col("__parts").cast("long")), F.lit(0)))
        left = _parted(left.withColumn("__spread", spread), on, hot).withColumn("__salt", salt.cast("int")).drop("__spread", "__parts")
        right = _parted(right, on, hot).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
        keys = [*on, "__salt"]
    elif stays:
        left = left.withColumn("__spread", spread).withColumn("__salt", F.when(alone, nulls).otherwise(0).cast("int")).drop("__spread")
        right = right.withColumn("__salt", F.lit(0))
        keys = [*on, "__salt"]
    if condition is None:
        return left.join(right, keys, how).drop("__salt")
    right = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    equal = condition
    for c in keys:
        equal = equal & (left[c] == right[f"__r_{c}"])
    return left.join(right, equal, how).drop("__salt", *[f"__r_{c}" for c in keys])
