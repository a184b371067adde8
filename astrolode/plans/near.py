"""Problem 1: for each located system, the other systems and the carriers within 12 light years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.proximity import radius_pairs
from ..operators.skew import salted_join
from ..storage import Scratch
from .tables import table

RADIUS_LY = 12.0
XYZ = ["x", "y", "z"]


def found(spark: SparkSession, folder: str, radius: float = RADIUS_LY) -> DataFrame:
    """Distinct pairs system_id, near_kind ('system' or 'carrier'), near_key (the larger id as text, or a callsign)."""
    systems = table(spark, folder, "system_exobio", "system_id", "system", *XYZ).na.drop(subset=XYZ)
    carriers = table(spark, folder, "carrier_position", "callsign", "system", *XYZ).where("callsign IS NOT NULL").distinct()
    own = carriers.na.drop(subset=XYZ).select("callsign", *XYZ)
    named = systems.select("system", *XYZ).where("system IS NOT NULL").distinct()
    lent = salted_join(carriers.where("x IS NULL OR y IS NULL OR z IS NULL").select("callsign", "system"), named, ["system"]).select("callsign", *XYZ)
    scratch = Scratch(spark, "pairs")
    # no -0.0: equal places must be equal keys
    carriers = scratch.write(own.unionAll(lent).select("callsign", *[(F.col(c) + F.lit(0.0)).alias(c) for c in XYZ]), "carriers")
    # many carriers lie at one place: places are joined, callsigns are put in at the end
    places = carriers.select(*XYZ).distinct().select(F.lit(1).alias("kind"), F.lit(0).alias("id"), *XYZ)
    points = systems.select("system_id", *[(F.col(c) + F.lit(0.0)).alias(c) for c in XYZ]).distinct().select(F.lit(0).alias("kind"), F.col("system_id").alias("id"), *XYZ)
    pairs = scratch.write(radius_pairs(points.unionAll(places), radius, coordinates=XYZ))  # read twice
    twins = pairs.where("near_kind = 0").select(F.col("id").alias("system_id"), F.lit("system").alias("near_kind"), F.col("near_id").cast("string").alias("near_key"))
    by_place = pairs.where("near_kind = 1").select("id", *XYZ)
    ships = salted_join(carriers, by_place, XYZ, spread=F.xxhash64("callsign")).select(F.col("id").alias("system_id"), F.lit("carrier").alias("near_kind"), F.col("callsign").alias("near_key"))
    return twins.unionAll(ships).distinct()


QUERIES = {"p1_found": found}

SQL = {
    "p1_found": """
        WITH s AS (SELECT DISTINCT system_id, system, x, y, z FROM system_exobio WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
        c AS (SELECT callsign, x, y, z FROM carrier_position WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL
              UNION SELECT callsign, s.x, s.y, s.z FROM carrier_position c JOIN s USING (system) WHERE c.x IS NULL OR c.y IS NULL OR c.z IS NULL),
        p AS (SELECT system_id, 'system' AS kind, system_id AS other, NULL AS sign, x, y, z FROM s UNION SELECT NULL, 'carrier', NULL, callsign, x, y, z FROM c),
        g AS (SELECT *, floor(x / 12) AS gx, floor(y / 12) AS gy, floor(z / 12) AS gz FROM p),
        a AS (SELECT system_id, x, y, z, gx + i AS gx, gy + j AS gy, gz + k AS gz FROM g, range(-1, 2) ri(i), range(-1, 2) rj(j), range(-1, 2) rk(k) WHERE system_id IS NOT NULL)
        SELECT DISTINCT a.system_id, g.kind AS near_kind, coalesce(g.sign, CAST(g.other AS VARCHAR)) AS near_key
        FROM a JOIN g USING (gx, gy, gz)
        WHERE (g.kind = 'carrier' OR a.system_id < g.other) AND (a.x - g.x) ** 2 + (a.y - g.y) ** 2 + (a.z - g.z) ** 2 <= 144""",
}
