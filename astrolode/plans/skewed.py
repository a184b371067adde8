"""Problem 5: results per sector and run, although a few sectors hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import chunked_distinct
from .tables import table

KEY = ["sector_id", "run_id"]


def sector_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct systems of each sector and run."""
    return chunked_distinct(table(spark, folder, "system_known", *KEY, "system_id"), KEY, "system_id", name="systems")


def wrong_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Sectors and runs whose stated number of systems is null or differs from the number found; absent counts as 0.

    Of several rows for one pair in sector_known all must be right. A null key is compared like any other.
    """
    said = table(spark, folder, "sector_known", *KEY, "systems").groupBy(*KEY).agg(
        F.min("systems").alias("low"), F.max("systems").alias("high"), F.bool_or(F.col("systems").isNull()).alias("unknown")
    )
    found = sector_counts(spark, folder).select(F.col("sector_id").alias("s"), F.col("run_id").alias("r"), F.col("systems").alias("n"))
    both = said.join(found, F.col("sector_id").eqNullSafe(F.col("s")) & F.col("run_id").eqNullSafe(F.col("r")), "full")
    n = F.coalesce("n", F.lit(0))
    wrong = F.coalesce("unknown", F.lit(False)) | (F.coalesce("low", F.lit(0)) != n) | (F.coalesce("high", F.lit(0)) != n)
    in_said = F.col("unknown").isNotNull()
    return both.where(wrong).select(F.when(in_said, F.col("sector_id")).otherwise(F.col("s")).alias("sector_id"), F.when(in_said, F.col("run_id")).otherwise(F.col("r")).alias("run_id"))


QUERIES = {"p5_found": wrong_counts, "p5_sector_counts": sector_counts}

SQL = {
    "p5_found": """
        WITH found AS (SELECT sector_id, run_id, count(DISTINCT system_id) AS n FROM system_known GROUP BY ALL)
        SELECT DISTINCT coalesce(k.sector_id, f.sector_id) AS sector_id, coalesce(k.run_id, f.run_id) AS run_id
        FROM sector_known k FULL JOIN found f ON k.sector_id = f.sector_id AND k.run_id = f.run_id
        WHERE (k.sector_id IS NOT NULL AND k.systems IS NULL) OR coalesce(k.systems, 0) <> coalesce(f.n, 0)""",
    "p5_sector_counts": "SELECT sector_id, run_id, count(DISTINCT system_id) AS systems FROM system_known GROUP BY ALL",
}
