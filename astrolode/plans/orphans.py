"""Problem 2: references of catalogue entries and reports to systems and points of interest that do not exist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.references import dangling
from .tables import table

#: child table, its id, the referring column, its time, the target table (whose key has the same name).
REFERENCES = [("system_catalog", "entry_id", "system_id", "loaded_at", "system_known"), ("body_poi", "report_id", "system_id", "reported_at", "system_known"), ("body_poi", "report_id", "poi_id", "reported_at", "poi")]


def found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per reference without a live target: child_field, child_id, ref_month, reason."""
    refs = [
        table(spark, folder, child, key, column, at).select(F.lit(f"{child}.{column}").alias("child_field"), F.col(key).alias("child_id"), F.lit(target).alias("target"), F.col(column).cast("long").alias("key"), F.col(at).alias("at"))
        for child, key, column, at, target in REFERENCES
    ]
    parents = [
        table(spark, folder, target, key, "first_seen", "removed_at").select(F.lit(target).alias("target"), F.col(key).cast("long").alias("key"), F.col("first_seen").alias("live_from"), F.col("removed_at").alias("live_to"))
        for target, key in sorted({(r[4], r[2]) for r in REFERENCES})
    ]
    return dangling(reduce(DataFrame.unionAll, refs), reduce(DataFrame.unionAll, parents))


def per_month(spark: SparkSession, folder: str) -> DataFrame:
    """Number of dead references per field, month and reason."""
    return found(spark, folder).groupBy("child_field", "ref_month", "reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p2_found": found, "p2_per_month": per_month}

_FOUND = " UNION ".join(
    f"""
        SELECT DISTINCT '{child}.{column}' AS child_field, c.{key} AS child_id, strftime(c.{at}, '%Y-%m') AS ref_month,
          CASE WHEN c.{column} NOT IN (SELECT {column} FROM {target} WHERE {column} IS NOT NULL) THEN 'missing'
               WHEN NOT EXISTS (SELECT 1 FROM {target} p WHERE p.{column} = c.{column} AND p.first_seen <= c.{at}) THEN 'late' ELSE 'deleted' END AS reason
        FROM {child} c WHERE c.{column} IS NOT NULL AND NOT EXISTS (
          SELECT 1 FROM {target} p WHERE p.{column} = c.{column} AND p.first_seen <= c.{at} AND (p.removed_at IS NULL OR p.removed_at > c.{at}))"""
    for child, key, column, at, target in REFERENCES
)
SQL = {"p2_found": _FOUND, "p2_per_month": f"SELECT child_field, ref_month, reason, count(*) AS n FROM ({_FOUND}) GROUP BY ALL"}
