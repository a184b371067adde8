"""Readers of feeds. What can't be read is null or dropped, never an error.

Schemas are given; json_inferred() and csv_inferred() find them, over all of the data unless a share is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(spark: SparkSession, path: str | list[str], schema: str | T.StructType, *, bad: str | None = None) -> DataFrame:
    """One object per line, compressed or not. Malformed lines are dropped, or kept as text in a column named ``bad``."""
    if bad is None:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*fields.fields, T.StructField(bad, T.StringType())])
    parsed = F.from_json("value", wide, {"columnNameOfCorruptRecord": bad})
    return spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("r")).select("r.*")


def json_inferred(spark: SparkSession, path: str | list[str], *, share: float = 1.0) -> DataFrame:
    """JSON lines whose schema is found in a first pass over that share of the lines; fields that differ become texts."""
    return spark.read.option("samplingRatio", share).option("mode", "DROPMALFORMED").json(path)


def csv_inferred(spark: SparkSession, path: str | list[str], *, separator: str = ",", share: float = 1.0) -> DataFrame:
    """A CSV with a header whose types are found in a first pass over that share of the rows."""
    reader = spark.read.option("header", "true").option("sep", separator).option("inferSchema", "true").option("samplingRatio", share)
    return reader.csv(path)


def json_document(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """A file that is one array of objects (or one object), read as a whole; for large ones use json_array_lines()."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)


def json_array_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A file that is one array with an object on each line, split like a text: brackets and commas at the ends of lines
    are taken off. Such dumps of any size are read in parallel. Lines that are no object are dropped."""
    line = F.regexp_replace(F.trim("value"), r"^\[|[,\]\s]+$", "")
    line = F.when(F.endswith(line, F.lit("}")), line).otherwise(F.concat(line, F.lit("")))
    rows = spark.read.text(path).select(line.alias("value")).where(F.col("value").startswith("{"))
    parsed = rows.select(F.from_json("value", schema).alias("r")).where("r IS NOT NULL")
    return parsed.select("r.*").na.drop("all")


def stations_of(systems: DataFrame, lists: Sequence[str], inner: Sequence[tuple[str, str]], *, keep: Sequence[str], item: str) -> DataFrame:
    """One row per element of lists at the top and of lists within the elements of other lists.

    lists: array columns; inner: (array column, its field that is an array of the same kind). Null arrays count as empty.
    """
    top = [F.coalesce(F.col(c), F.array()) for c in lists]
    within = lambda f: lambda e: F.coalesce(e[f], F.array())
    deep = [F.flatten(F.transform(F.coalesce(F.col(a), F.array()), within(f))) for a, f in inner]
    return systems.select(*keep, F.explode(F.concat(*top, *deep)).alias(item))


def csv_texts(spark: SparkSession, path: str | list[str], columns: dict[str, str], *, separator: str = ",", quote: str = '"', comment: str | None = None) -> DataFrame:
    """A CSV with a header, all columns as texts, then tried as the given types: name -> type, or name -> 'type AS new'.

    Blank texts and unreadable values are null. Columns of the file that are not named are not parsed into types.
    """
    reader = spark.read.option("header", "true").option("sep", separator).option("quote", quote).option("mode", "PERMISSIVE")
    raw = (reader.option("comment", comment) if comment else reader).csv(path)
    out = []
    for name, kind in columns.items():
        kind, _, alias = kind.partition(" AS ")
        value = F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))
        out.append((value if kind == "string" else value.try_cast(kind)).alias(alias or name))
    return raw.select(*out)


def tsv(spark: SparkSession, path: str | list[str], columns: dict[str, str], *, comment: str = "#") -> DataFrame:
    """Tab-separated without quotes, comment lines skipped."""
    return csv_texts(spark, path, columns, separator="\t", quote="", comment=comment)


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 7) -> DataFrame:
    """n rows drawn by a seeded hash of a key: the same for the same rows, however they are partitioned."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def reconcile(df: DataFrame, key: str, stated: int) -> dict[str, int]:
    """What was read against what the source says it has: rows, distinct keys, stated and missing."""
    rows, keys = df.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    return {"rows": rows, "keys": keys, "stated": stated, "missing": max(0, stated - keys)}


def resumed(spark: SparkSession, path: str, schema: str, folder: str, *, rows: int) -> int:
    """Load the next ``rows`` lines of a dump of one object per line into a table, after those loaded before; the number loaded.

    Lines are numbered by their place in the file, from counts per split of it; how many were loaded is read back from the names of the parts in
    ``folder``, each of which appears as a whole. A call after a failure goes on where the last whole part ended; 0 says
    that all is loaded.
    """
    parts = f"{folder}/parts"
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(parts).getFileSystem(spark._jsc.hadoopConfiguration())
    held = [s.getPath() for s in fs.listStatus(jpath(parts))] if fs.exists(jpath(parts)) else []
    whole = [p.getName() for p in held if fs.exists(jpath(p, "_SUCCESS"))]
    skip = max((int(n.split("-")[2]) for n in whole), default=0)
    for p in held:
        if p.getName() not in whole:
            fs.delete(p, True)
    text = spark.read.text(path).select("value", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    offset, offsets = 0, []
    for part, n in sorted(tuple(r) for r in text.groupBy("__part").agg(F.count(F.lit(1))).collect()):  # one number per split of the file
        offsets.append((part, offset))
        offset += n
    if not offset:
        return 0
    first = F.broadcast(spark.createDataFrame(offsets, "__part int, __first long"))
    lines = text.join(first, "__part").withColumn("__no", F.col("__first") + F.col("__at")).where((F.col("__no") >= skip) & (F.col("__no") < skip + rows))
    n = lines.count()
    if not n:
        return 0
    line = F.regexp_replace(F.trim("value"), r"^\[|[,\]\s]+$", "")
    parsed = lines.where(line.startswith("{")).select(F.from_json(line, schema).alias("r")).where("r IS NOT NULL").select("r.*")
    parsed.write.parquet(f"{parts}/rows-{skip:012d}-{skip + n:012d}")
    return n
