"""Tables written between the steps of an operator.

A step that is read more than once, or whose lineage must be cut, is written as Parquet into the folder that all
executors share (``spark.checkpoint.dir``). Such a table outlives the executors that wrote it, is column-pruned when it
is read back, and takes a fraction of the room of serialized rows.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDERS: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or of the context's checkpoint directory.

    Where neither is set, a local session gets a temporary folder of its own; on a cluster this is an error, since a
    folder of one machine can't be read by the others.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="astrolode-")
    atexit.register(shutil.rmtree, folder, True)
    sc.setCheckpointDir("file://" + folder)
    return "file://" + folder


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one run of an operator, below one folder of the shared root.

    They stay until ``drop`` or ``clear`` is called, or until the Python process ends: results are lazy and may read
    them at any later time.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/astrolode-{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _FOLDERS.append(self.root)
        atexit.register(self._at_exit)

    def _at_exit(self) -> None:
        try:
            self.clear()
        except Exception:  # the gateway may be gone by now
            if self.root.startswith("file:"):
                shutil.rmtree(re.sub("^file:/*", "/", self.root), True)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str = "step") -> DataFrame:
        """Write df as a table and return the table read back, with the same columns and types."""
        self._n += 1
        path = self.path(f"{self._n:03d}-{name}")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._astrolode_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that write() returned and that nothing reads any more."""
        path = getattr(df, "_astrolode_path", None)
        if path:
            _delete(self.spark, path)

    def drop_folder(self, path: str) -> None:
        """Delete a folder below path() that nothing reads any more."""
        _delete(self.spark, path)

    def clear(self) -> None:
        _delete(self.spark, self.root)


def numbered(df: DataFrame, scratch: Scratch, name: str, position: str = "row_no") -> DataFrame:
    """Write df, whose partitions are in order, and read it back with the exact position of each row (from 0).

    Rows are counted per written file; the running sum of these counts (one number per file, kept by the driver) plus
    the row's index in its file is its position. Reading needs no further shuffle.
    """
    table = scratch.write(df, name)
    order = lambda c: F.struct(F.regexp_extract(c, r"part-(\d+)", 1).cast("int"), F.regexp_extract(c, r"-c(\d+)", 1).cast("int"))
    counts = table.groupBy(F.col("_metadata.file_name").alias("__file")).agg(F.count(F.lit(1)).alias("n"))
    held = counts.select("__file", "n", order("__file").alias("o")).collect()
    offset, offsets = 0, []
    for row in sorted(held, key=lambda r: tuple(r["o"])):
        offsets.append((row["__file"], offset))
        offset += row["n"]
    index = df.sparkSession.createDataFrame(offsets, "__file string, __offset long")
    rows = table.select(*table.columns, F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    out = rows.join(F.broadcast(index), "__file").select(*table.columns, (F.col("__offset") + F.col("__at")).alias(position))
    out._astrolode_path = table._astrolode_path
    out._astrolode_rows = offset
    return out


def file_system(spark: SparkSession, path: str):
    """The file system that a path lies in, wherever that is, and the class of its paths."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    return jpath(path).getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def listed(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, in order; nothing if it isn't there."""
    fs, jpath = file_system(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(jpath(path))) if fs.exists(jpath(path)) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that appears with its whole content, by renaming; an older one is replaced."""
    fs, jpath = file_system(spark, path)
    out = fs.create(jpath(path + ".new"), True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(jpath(path), False)
    if not fs.rename(jpath(path + ".new"), jpath(path)):
        raise OSError(f"can't write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small file; None if it isn't there."""
    fs, jpath = file_system(spark, path)
    return spark.read.text(path, wholetext=True).first()[0] if fs.exists(jpath(path)) else None
