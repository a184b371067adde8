"""Merges with change detection on plain tables: new rows, changed rows, and what a source no longer holds.

Parquet has no MERGE. A merge is one full join on the key that yields the new table together with the kind of change
of each row; a second merge of the same source changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch

#: How a column takes a new value: overwrite; keep what is held and fill nulls; newest value that is not null; never change.
OVERWRITE, FILL, NEWEST, KEEP = "overwrite", "fill", "newest", "keep"

INSERTED, UPDATED, SAME, ABSENT = "inserted", "updated", "same", "absent"


def merge(target: DataFrame, source: DataFrame, keys: list[str], policy: dict[str, str] | None = None, *, guard: Column | None = None, insert: bool = True, absent: dict[str, Column] | None = None, change: str = "change") -> DataFrame:
    """The rows after the merge, each with its change: inserted, updated, same or absent.

    Both sides must be unique by keys; keys are compared with nulls equal. policy: by column (default overwrite). guard:
    a condition on the columns of target (t.x) and source (s.x) without which a matched row stays as it is. absent:
    what columns of rows that the source lacks are set to (a soft delete); they count as absent only if that changes
    them. insert=False updates matched rows only. Columns of the source that the target lacks are ignored.
    """
    columns = target.columns
    policy = {c: OVERWRITE for c in columns if c in source.columns and c not in keys} | (policy or {})
    t = target.withColumn("__t", F.lit(True)).alias("t")
    s = source.withColumn("__s", F.lit(True)).alias("s")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
    both = t.join(s, on, "full" if insert else "left")
    held, told = F.col("__t").isNotNull(), F.col("__s").isNotNull()
    allowed = held & told & (F.coalesce(guard, F.lit(False)) if guard is not None else F.lit(True))
    out, differs = {}, F.lit(False)
    for c in columns:
        old = F.col(f"t.{c}")
        if c in keys:
            out[c] = F.when(held, old).otherwise(F.col(f"s.{c}"))
            continue
        if c not in source.columns:
            out[c] = old
            continue
        new = F.col(f"s.{c}")
        rule = {OVERWRITE: new, FILL: F.coalesce(old, new), NEWEST: F.coalesce(new, old), KEEP: old}[policy.get(c, OVERWRITE)]
        value = F.when(~held, new).when(allowed, rule).otherwise(old)
        out[c] = value
        differs = differs | (allowed & ~old.eqNullSafe(rule))
    gone = F.lit(False)
    for c, value in (absent or {}).items():
        lone = held & ~told
        gone = gone | (lone & ~F.col(f"t.{c}").eqNullSafe(value))
        out[c] = F.when(lone, value).otherwise(out.get(c, F.col(f"t.{c}")))
    kind = F.when(~held, INSERTED).when(differs, UPDATED).when(gone, ABSENT).otherwise(SAME)
    return both.select(*[out[c].alias(c) for c in columns], kind.alias(change))


def counts(merged: DataFrame, change: str = "change") -> DataFrame:
    """Rows by kind of change, of one pass over the merged rows."""
    return merged.groupBy(change).agg(F.count(F.lit(1)).alias("n"))


def insert_new(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target and those rows of source whose key it lacks."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def delete_stale(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of target whose key the source still holds."""
    return target.join(source.select(*keys), keys, "left_semi")


def update_from(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str], *, only_null: bool = False) -> DataFrame:
    """target with the columns of source where the key matches; with only_null, where the target's value is null."""
    s = source.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    joined = target.join(s, keys, "left")
    new = {c: F.when(F.col("__hit") & (F.col(c).isNull() if only_null else F.lit(True)), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(new).select(*target.columns)


def last_wins(target: DataFrame, source: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert of a batch that may hold several rows for a key: the last by order replaces what is held."""
    last = source.groupBy(*keys).agg(F.max_by(F.struct(*source.columns), F.struct(*[F.col(o) for o in order])).alias("r")).select("r.*")
    return target.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*target.columns))


def ranked_guard(column: str, order: list[str]) -> Column:
    """Whether the source's rank is at least as good as the target's; unknown values rank last."""
    place = lambda side: F.coalesce(F.array_position(F.lit(order), F.col(f"{side}.{column}")).cast("int"), F.lit(0))
    rank = lambda side: F.when(place(side) == 0, len(order) + 1).otherwise(place(side))
    return rank("s") <= rank("t")


def migrate(old: DataFrame, new: DataFrame, renamed: dict[str, str] | None = None) -> DataFrame:
    """The rows of an old table in the columns of a new one, by name; columns that are new are null."""
    for a, b in (renamed or {}).items():
        if a in old.columns and b not in old.columns:
            old = old.withColumnRenamed(a, b)
    kinds = dict(new.dtypes)
    return old.select(*[(F.col(c).try_cast(kinds[c]) if c in old.columns else F.lit(None).cast(kinds[c])).alias(c) for c in new.columns])


# --- audits --------------------------------------------------------------------------------------------------------


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand on several rows, and on how many; empty if the keys are unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows of child whose reference is set and has no parent."""
    keys = parent.select(F.col(parent_column).alias(column)).distinct()
    return child.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


def broken_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule, in one pass: rule and n. A null condition is no breach, as in a CHECK."""
    out = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    return out.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules])))


def checksums(df: DataFrame) -> DataFrame:
    """Per column its non-null values and a sum of hashes, which doesn't depend on the order of rows."""
    one = lambda c: F.sum(F.pmod(F.xxhash64(F.col(c)), F.lit(1 << 31))).alias(c)
    sums = df.agg(*[one(c) for c in df.columns], *[F.count(c).alias(f"__n_{c}") for c in df.columns])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__n_{c}").alias("held"), F.col(c).alias("sum")) for c in df.columns])))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of only one side, with the side: 'a' or 'b'. Repeats count."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionAll(b.exceptAll(a).withColumn("side", F.lit("b")))


def newer_only(target: DataFrame, source: DataFrame, keys: Sequence[str], at: str, *, back: str = "0 seconds") -> DataFrame:
    """Rows of source later than the newest row of target (less an overlap), whose keys target doesn't hold yet.

    The newest time is one row, which bounds what is read of source; an empty target bounds nothing.
    """
    newest = target.agg(F.max(at).alias("__newest"))
    late = source.crossJoin(F.broadcast(newest)).where(F.col("__newest").isNull() | (F.col(at) > F.col("__newest") - F.expr(f"INTERVAL {back}"))).drop("__newest")
    return late.join(target.select(*keys), list(keys), "left_anti")


def in_buckets(step: Callable[..., DataFrame], tables: Sequence[DataFrame], key: str, n: int, scratch: Scratch) -> DataFrame:
    """step(*tables) worked out for one bucket of the key after another, each written before the next begins.

    For steps whose rows depend on rows of the same key only: the result is that of the whole, with a part of the memory
    and disk at a time. Rows with a null key are a bucket of their own. The hash spreads keys whose low bits say
    something, as the mass code in an address does. n is chosen by the size of the tables; it never changes the result.
    """
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(n))
    parts = []
    for i in range(n + 1):
        mine = (lambda df: df.where(F.col(key).isNull())) if i == n else (lambda df, i=i: df.where(F.col(key).isNotNull() & (bucket == i)))
        parts.append(scratch.write(step(*[mine(t) for t in tables]), f"bucket{i}"))
    return reduce(DataFrame.unionByName, parts)


def returning(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """target with the rows whose keys it lacks, and those rows: an INSERT that returns what it inserted."""
    new = rows.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti").select(*target.columns)
    return target.unionByName(new), new
