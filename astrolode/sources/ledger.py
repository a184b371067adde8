"""What was loaded when: a manifest of feeds, roles bound to the feed that was staged last, windows, and a run log."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import file_system, read_text, write_text

MANIFEST = "role string, table_name string, source string, bytes long, rows long, is_delta boolean, loaded_at timestamp"


def fingerprint(path: str, spark: SparkSession | None = None) -> dict[str, object]:
    """Size, time of change and a hash of all of a file's content.

    With a session the file may lie in any file system that Spark reads; its lines are hashed where they are read, so a
    change of one line or of their number shows, though not of their order alone. Without one it is a local file, read
    in blocks.
    """
    if spark is None:
        stat = os.stat(path)
        with open(path, "rb") as f:
            return {"bytes": stat.st_size, "changed": int(stat.st_mtime), "hash": hashlib.file_digest(f, "sha256").hexdigest()[:16]}
    fs, jpath = file_system(spark, path)
    status = fs.getFileStatus(jpath(path))
    n, total = spark.read.text(path).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("value").cast("decimal(38,0)")), F.lit(0))).first()
    return {"bytes": status.getLen(), "changed": status.getModificationTime() // 1000, "hash": f"{n}:{total}"}


def needs_load(path: str, state: str, least_bytes: int = 1, spark: SparkSession | None = None) -> bool:
    """Whether a file differs from what is noted in the state file; files below least_bytes are refused.

    With a session both may lie in any file system that Spark reads.
    """
    now = fingerprint(path, spark)
    if now["bytes"] < least_bytes:
        raise ValueError(f"{path} has {now['bytes']} bytes; at least {least_bytes} were expected")
    text = read_text(spark, state) if spark else Path(state).read_text() if os.path.exists(state) else None
    return text is None or json.loads(text) != now


def note_load(path: str, state: str, spark: SparkSession | None = None) -> None:
    """Note a file as loaded, by a rename that is all or nothing."""
    text = json.dumps(fingerprint(path, spark))
    if spark:
        write_text(spark, state, text)
        return
    part = f"{state}.part"
    Path(part).write_text(text)
    os.replace(part, state)


class Manifest:
    """An append-only table of loads in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, f"{folder}/manifest"

    def add(self, role: str, table: str, source: str, size: int, rows: int, is_delta: bool, at: dt.datetime) -> None:
        self.spark.createDataFrame([(role, table, source, size, rows, is_delta, at)], MANIFEST).write.mode("append").parquet(self.path)

    def latest(self) -> DataFrame:
        """The last load of each role."""
        held = self.spark.read.schema(MANIFEST).parquet(self.path)
        return held.groupBy("role").agg(F.max_by(F.struct(*held.columns), F.struct("loaded_at", "table_name")).alias("r")).select("r.*")

    def bind(self, role: str, tables: str) -> DataFrame:
        """Make the table that a role was last loaded into known as a view of the role's name."""
        row = self.latest().where(F.col("role") == role).first()
        if row is None:
            raise LookupError(f"nothing was loaded for {role}")
        df = self.spark.read.parquet(f"{tables}/{row['table_name']}")
        df.createOrReplaceTempView(role)
        return df


#: Width in days of the windows that a feed offers, as far as their names say so.
_DAYS = {"day": 1, "week": 7, "month": 31}


def window_days(window: str) -> int | None:
    """7 for '7days' or '1week'; None for a full dump."""
    m = re.fullmatch(r"(\d+)(day|week|month)s?", window)
    return int(m.group(1)) * _DAYS[m.group(2)] if m else None


def window_for_gap(windows: Sequence[str], gap_days: float) -> str:
    """The narrowest window that is at least as wide as the gap, else the full dump."""
    fit = sorted((d, w) for w in windows if (d := window_days(w)) is not None and d >= gap_days)
    return fit[0][1] if fit else next(w for w in windows if window_days(w) is None)


def window_within(windows: Sequence[str], most_days: float) -> str:
    """The widest window of at most that many days, else the narrowest there is."""
    sized = sorted((d, w) for w in windows if (d := window_days(w)) is not None)
    fit = [w for d, w in sized if d <= most_days]
    return fit[-1] if fit else sized[0][1]


def gap_in_days(df: DataFrame, column: str, now: dt.datetime) -> float | None:
    """Days between the latest value of a time column and now; None for an empty table."""
    last = df.agg(F.max(F.unix_seconds(column))).first()[0]
    return None if last is None else (now.replace(tzinfo=now.tzinfo or dt.UTC).timestamp() - last) / 86400


STEPS = "run_id string, script string, step_no int, kind string, table_name string, rows_before long, rows_after long, inserted long, updated long, orphaned long, seconds double, noted_at timestamp"


class RunLog:
    """Steps of runs, appended to a table in a folder; report() has the latest run of each script beside its median."""

    def __init__(self, spark: SparkSession, folder: str, script: str, run_id: str):
        self.spark, self.path, self.script, self.run_id, self.steps = spark, f"{folder}/run_steps", script, run_id, []

    def note(self, kind: str, table: str, *, before: int | None = None, after: int | None = None, inserted: int | None = None, updated: int | None = None, orphaned: int | None = None, seconds: float = 0.0, at: dt.datetime | None = None) -> None:
        self.steps.append((self.run_id, self.script, len(self.steps) + 1, kind, table, before, after, inserted, updated, orphaned, float(seconds), at or dt.datetime.now(dt.UTC)))

    def close(self) -> None:
        if self.steps:
            self.spark.createDataFrame(self.steps, STEPS).coalesce(1).write.mode("append").parquet(self.path)
            self.steps = []

    @staticmethod
    def report(spark: SparkSession, folder: str) -> DataFrame:
        s = spark.read.schema(STEPS).parquet(f"{folder}/run_steps")
        runs = s.groupBy("script", "run_id").agg(F.sum("seconds").alias("seconds"), F.max("noted_at").alias("ended"), F.sum("inserted").alias("inserted"), F.sum("updated").alias("updated"))
        return runs.groupBy("script").agg(F.max_by("run_id", "ended").alias("run_id"), F.max_by("seconds", "ended").alias("seconds"), F.median("seconds").alias("usual"), F.count(F.lit(1)).alias("runs"), F.max_by("inserted", "ended").alias("inserted"), F.max_by("updated", "ended").alias("updated"))
