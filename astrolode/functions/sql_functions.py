"""The column functions under names of their own in SQL; Spark inlines them into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "distance3(ax DOUBLE, ay DOUBLE, az DOUBLE, bx DOUBLE, by DOUBLE, bz DOUBLE) RETURNS DOUBLE": "sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by) + (az - bz) * (az - bz))",
    "sector_of_cell(x BIGINT, y BIGINT, z BIGINT) RETURNS BIGINT": "x + y * 128 + z * 16384",
    "sector_at(x DOUBLE, y DOUBLE, z DOUBLE) RETURNS BIGINT": "CAST(floor((x + 49985) / 1280) AS BIGINT) + 128 * CAST(floor((y + 40985) / 1280) AS BIGINT) + 16384 * CAST(floor((z + 24105) / 1280) AS BIGINT)",
    "mass_code_of(address BIGINT) RETURNS STRING": "substring('abcdefgh', CAST(address & 7 AS INT) + 1, 1)",
    "stable_id(name STRING) RETURNS BIGINT": "-(pmod(xxhash64(lower(trim(name))), 4294967296L) + 1)",
    "laplace(k DOUBLE, n DOUBLE) RETURNS DOUBLE": "(k + 1) / (n + 2)",
    "cell_x(sector BIGINT) RETURNS BIGINT": "sector & 127",
    "cell_y(sector BIGINT) RETURNS BIGINT": "shiftright(sector, 7) & 127",
    "cell_z(sector BIGINT) RETURNS BIGINT": "shiftright(sector, 14)",
    "sector_of_address(address BIGINT) RETURNS BIGINT": "sector_of_cell(shiftright(shiftright(address, CAST(30 - 2 * (address & 7) AS INT)) & (shiftleft(1L, CAST(14 - (address & 7) AS INT)) - 1), CAST(7 - (address & 7) AS INT)), shiftright(shiftright(address, CAST(17 - (address & 7) AS INT)) & (shiftleft(1L, CAST(13 - (address & 7) AS INT)) - 1), CAST(7 - (address & 7) AS INT)), shiftright(shiftright(address, 3) & (shiftleft(1L, CAST(14 - (address & 7) AS INT)) - 1), CAST(7 - (address & 7) AS INT)))",
    "sector_id_of(address BIGINT, x DOUBLE, y DOUBLE, z DOUBLE) RETURNS BIGINT": "coalesce(sector_of_address(address), sector_at(x, y, z))",
    "plain_name(name STRING) RETURNS STRING": "nullif(trim(regexp_replace(name, '\\\\s+', ' ')), '')",
    "system_id_of(address BIGINT, name STRING) RETURNS BIGINT": "coalesce(address, stable_id(plain_name(name)))",
    "in_strip(x DOUBLE, z DOUBLE) RETURNS BOOLEAN": "coalesce(floor((x + 49985) / 1280) BETWEEN 38 AND 40 OR floor((z + 24105) / 1280) BETWEEN 18 AND 19, false)",
    "axis_distance(x DOUBLE, z DOUBLE) RETURNS DOUBLE": "least(abs(x), abs(z))",
    "logistic(x DOUBLE) RETURNS DOUBLE": "1 / (1 + exp(-greatest(least(x, 50D), -50D)))",
    "ladder_rung(low DOUBLE, top DOUBLE, k INT) RETURNS FLOAT": "CAST(CAST(CAST(low AS FLOAT) AS DOUBLE) + k * ((top - CAST(CAST(low AS FLOAT) AS DOUBLE)) / 7) AS FLOAT)",
    "shrunk_ratio(o DOUBLE, e DOUBLE) RETURNS DOUBLE": "least(round((o + 20) / (e + 20), 4), 1D)",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
