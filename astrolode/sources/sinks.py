"""Writing tables: built aside and swapped, clustered, ordered, checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def swap_in(df: DataFrame, path: str, *, expected: int | None = None) -> int:
    """Write a table beside the old one, check it, and take its place by renames; returns its rows.

    Readers see the old table or the new one. If the count differs from ``expected``, the old one stays.
    """
    spark = df.sparkSession
    new, old = f"{path}.new", f"{path}.old"
    fs, p = _fs(spark, path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs.delete(jpath(new), True)
    df.write.parquet(new)
    rows = spark.read.schema(df.schema).parquet(new).count()
    if expected is not None and rows != expected:
        fs.delete(jpath(new), True)
        raise ValueError(f"{rows} rows were written, {expected} expected; {path} is unchanged")
    fs.delete(jpath(old), True)
    if fs.exists(p):
        fs.rename(p, jpath(old))
    fs.rename(jpath(new), p)
    fs.delete(jpath(old), True)
    return rows


def clustered(df: DataFrame, by: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Range partitions sorted within, so that row groups cover narrow ranges of ``by`` and filters skip the others."""
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return ranged.sortWithinPartitions(*by)


def ordered_file(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """One sorted, densely compressed file; for curated inputs and dimensions."""
    df.orderBy(*[F.col(c).asc_nulls_last() for c in by]).coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(path)


def same_content(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows with the same repeats, by counts and sums of hashes in one pass each."""
    sums = lambda df: tuple(df.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(seed), *sorted(df.columns)).cast("decimal(38,0)")) for seed in (1, 2)]).first())
    return sorted(a.columns) == sorted(b.columns) and sums(a) == sums(b)


def catalogue_of(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and views of a database with their columns: table_name, column_name, data_type, position."""
    rows = [(t.name, c.name, c.dataType, i) for t in spark.catalog.listTables(database) for i, c in enumerate(spark.catalog.listColumns(f"{database}.{t.name}" if database and not t.isTemporary else t.name))]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, position int")


def attach(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Make the Parquet tables of another folder readable as views ``prefix_name``; nothing can be written through them."""
    fs, p = _fs(spark, folder)
    names = []
    for status in sorted(fs.listStatus(p), key=lambda s: s.getPath().getName()):
        name = status.getPath().getName()
        if name.endswith(".parquet"):
            spark.read.parquet(status.getPath().toString()).createOrReplaceTempView(f"{prefix}_{name[:-8]}")
            names.append(f"{prefix}_{name[:-8]}")
    return names


def copy_in_batches(df: DataFrame, path: str, key: str, batches: int) -> DataFrame:
    """Copy a table in batches by ranges of a number, and hold sums of hashes of each column against the source's.

    Each batch is written by itself, so a copy that fails is gone on with the next one missing. Returns column, source
    and copy sums and whether they agree.
    """
    spark = df.sparkSession
    fs, _ = _fs(spark, path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    low, high = df.agg(F.min(key), F.max(key)).first()
    step = -(-(high - low + 1) // batches) if low is not None else 1
    for i in range(batches if low is not None else 0):
        part = f"{path}/batch={i:05d}"
        if not fs.exists(jpath(f"{part}/_SUCCESS")):
            inside = F.col(key).between(low + i * step, low + (i + 1) * step - 1)
            df.where(inside if i else inside | F.col(key).isNull()).write.mode("overwrite").parquet(part)
    copy = spark.read.schema(df.schema).parquet(*[f"{path}/batch={i:05d}" for i in range(batches)]) if low is not None else df.limit(0)
    sums = lambda d, name: d.agg(*[F.sum(F.xxhash64(c).cast("decimal(38,0)")).alias(c) for c in df.columns]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias(name)) for c in df.columns])))
    return sums(df, "source").join(sums(copy, "copy"), "column").withColumn("same", F.col("source").eqNullSafe(F.col("copy")))
