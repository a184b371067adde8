"""Derivations and reads of the galaxy catalogue over its tables: dimensions, systems, names, places, nearest, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import agg, expr, windows
from ..operators import graphs, joins, merging, runs
from ..operators.skew import salted_join
from .registry import Book
from .tables import table

query = Book()
S = SparkSession
XYZ = ["x", "y", "z"]
#: A fixed place for queries around a ship.
SHIP = (-8143.65625, -2103.71875, 12369.75)
_AT = "(-8143.65625, -2103.71875, 12369.75)"
_D = "sqrt((x - -8143.65625) ** 2 + (y - -2103.71875) ** 2 + (z - 12369.75) ** 2)"
#: The latest row of each system that is still there.
_LIVE = "live AS (SELECT * FROM system_known WHERE removed_at IS NULL QUALIFY row_number() OVER (PARTITION BY system_id ORDER BY run_id DESC, first_seen DESC, poi_id NULLS LAST, body_count NULLS LAST) = 1)"


def live_systems(spark: S, folder: str) -> DataFrame:
    k = table(spark, folder, "system_known").where("removed_at IS NULL")
    return windows.pick_first(k, ["system_id"], F.desc("run_id"), F.desc("first_seen"), F.asc_nulls_last("poi_id"), F.asc_nulls_last("body_count"))


# --- keys and names ------------------------------------------------------------------------------------------------
@query("""SELECT DISTINCT system_id, substr('abcdefgh', CAST(system_id & 7 AS INTEGER) + 1, 1) AS code,
          ((system_id >> CAST(30 - 2 * (system_id & 7) AS INTEGER)) & ((1::BIGINT << CAST(14 - (system_id & 7) AS INTEGER)) - 1)) >> CAST(7 - (system_id & 7) AS INTEGER) AS sx,
          ((system_id >> CAST(17 - (system_id & 7) AS INTEGER)) & ((1::BIGINT << CAST(13 - (system_id & 7) AS INTEGER)) - 1)) >> CAST(7 - (system_id & 7) AS INTEGER) AS sy,
          ((system_id >> 3) & ((1::BIGINT << CAST(14 - (system_id & 7) AS INTEGER)) - 1)) >> CAST(7 - (system_id & 7) AS INTEGER) AS sz,
          system_id >> CAST(44 - 3 * (system_id & 7) AS INTEGER) AS number FROM system_known WHERE system_id > 0""")
def address_parts(spark: S, folder: str) -> DataFrame:
    """Mass code, sector cell and index out of the bits of an address."""
    k = table(spark, folder, "system_known", "system_id").where("system_id > 0").distinct()
    x, y, z = expr.boxel_cell("system_id")
    down = 7 - expr.mass_index("system_id")
    cell = lambda v: F.call_function("shiftright", v, down)
    return k.select("system_id", expr.mass_code("system_id").alias("code"), cell(x).alias("sx"), cell(y).alias("sy"), cell(z).alias("sz"), expr.boxel_number("system_id").alias("number"))


@query("""SELECT record_id, sector, cube, mass, CASE WHEN sub = '' THEN NULL ELSE CAST(sub AS INTEGER) END AS sub, CAST(number AS INTEGER) AS number FROM (
            SELECT record_id, unnest(regexp_extract(name, '^(.+) ([A-Z][A-Z]-[A-Z]) ([a-h])(?:(\\d+)-)?(\\d+)(?: .*)?$', ['sector', 'cube', 'mass', 'sub', 'number'])) FROM spansh_galaxy_body) WHERE sector <> ''""")
def name_grammar(spark: S, folder: str) -> DataFrame:
    """Parts of systematic names at the head of body names."""
    b = table(spark, folder, "spansh_galaxy_body", "record_id", "name")
    system = F.regexp_replace("name", r"^(.+ [A-Z][A-Z]-[A-Z] [a-h](?:\d+-)?\d+)( .*)$", "$1")
    return b.select("record_id", *[v.alias(k) for k, v in expr.name_parts(system).items()]).where("sector IS NOT NULL")


@query(f"""WITH {_LIVE} SELECT DISTINCT l.sector_id, CAST(floor((x + 49985) / 1280) AS BIGINT) + 128 * CAST(floor((y + 40985) / 1280) AS BIGINT) + 16384 * CAST(floor((z + 24105) / 1280) AS BIGINT) AS cell
           FROM live l WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL""")
def sector_cells(spark: S, folder: str) -> DataFrame:
    return live_systems(spark, folder).na.drop(subset=XYZ).select("sector_id", expr.sector_at(*XYZ).alias("cell")).distinct()


@query("""SELECT DISTINCT system, lower(trim(regexp_replace(system, '\\s+', ' ', 'g'))) AS clean, string_split(system, ' ')[1] AS head, split_part(system, ' ', 2) AS second, regexp_replace(system, '[aeiou]', '*') AS masked,
          strpos(system, ' ') AS blank_at, CASE WHEN starts_with(system, 'S') THEN substr(system, 2) ELSE left(system, 3) END AS cut FROM system_exobio""")
def clean_names(spark: S, folder: str) -> DataFrame:
    """String idioms: squeeze, split, first match only, position, substring."""
    s = table(spark, folder, "system_exobio", "system").distinct()
    return s.select(
        "system", F.lower(F.trim(F.regexp_replace("system", r"\s+", " "))).alias("clean"), F.element_at(F.split("system", " "), 1).alias("head"), F.split_part("system", F.lit(" "), F.lit(2)).alias("second"),
        expr.replace_first("system", "[aeiou]", "*").alias("masked"), F.instr("system", " ").cast("long").alias("blank_at"),
        F.when(F.startswith("system", F.lit("S")), F.substring("system", 2, 1 << 20)).otherwise(F.left("system", F.lit(3))).alias("cut"),
    )


@query("""WITH b AS (SELECT DISTINCT b.record_id, b.name, s.system FROM spansh_galaxy_body b JOIN (SELECT DISTINCT system_id, system FROM system_exobio) s ON b.system_id64 = s.system_id)
          SELECT record_id, system, CASE WHEN name = system THEN '' WHEN starts_with(name, system || ' ') THEN substr(name, length(system) + 2) ELSE name END AS body FROM b""")
def body_designations(spark: S, folder: str) -> DataFrame:
    """Body names without the name of their system."""
    s = table(spark, folder, "system_exobio", "system_id", "system").distinct()
    b = table(spark, folder, "spansh_galaxy_body", "record_id", "system_id64", "name").join(s, F.col("system_id64") == F.col("system_id"))
    return b.select("record_id", "system", expr.without_prefix("name", "system").alias("body")).distinct()


# --- staging: texts to types ---------------------------------------------------------------------------------------
@query("""SELECT record_id, update_time, TRY_CAST(update_time AS TIMESTAMPTZ) IS NOT NULL OR TRY_CAST(update_time AS DATE) IS NOT NULL AS readable, try_cast(substr(update_time, 1, 4) AS INTEGER) AS y FROM spansh_galaxy_body""")
def typed_times(spark: S, folder: str) -> DataFrame:
    """Times in several notations; what can't be read is null rather than an error."""
    b = table(spark, folder, "spansh_galaxy_body", "record_id", "update_time")
    return b.select("record_id", "update_time", (F.col("update_time").try_cast("timestamp").isNotNull() | F.col("update_time").try_cast("date").isNotNull()).alias("readable"), F.substring("update_time", 1, 4).try_cast("int").alias("y"))


# --- dimensions ----------------------------------------------------------------------------------------------------
@query(f"""WITH {_LIVE} SELECT sector_id, count(*) AS systems, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z, min(x) AS low_x, max(x) AS high_x, round((max(x) - min(x) + max(y) - min(y) + max(z) - min(z)) / 6, 4) AS radius,
           bool_or(max_cell <> min_cell) AS crosses FROM (SELECT *, min(floor((x + 49985) / 1280)) OVER (PARTITION BY sector_id) AS min_cell, max(floor((x + 49985) / 1280)) OVER (PARTITION BY sector_id) AS max_cell FROM live) GROUP BY sector_id""")
def sectors(spark: S, folder: str) -> DataFrame:
    """Box, centre and mean extent of each sector, and whether it crosses cells."""
    cell = F.floor((F.col("x") + 49985) / 1280)
    ranges = sum(((F.max(c) - F.min(c)) for c in XYZ[1:]), F.max("x") - F.min("x"))
    return live_systems(spark, folder).groupBy("sector_id").agg(
        F.count(F.lit(1)).alias("systems"), *[F.round(F.avg(c), 4).alias(c) for c in XYZ], F.min("x").alias("low_x"), F.max("x").alias("high_x"), F.round(ranges / 6, 4).alias("radius"), (F.max(cell) != F.min(cell)).alias("crosses")
    )


@query(f"""WITH {_LIVE}, v AS (SELECT sector_id, region_id, count(*) AS n FROM live WHERE region_id IS NOT NULL GROUP BY ALL),
           m AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY sector_id ORDER BY n DESC, region_id) = 1)
           SELECT l.system_id, coalesce(l.region_id, m.region_id) AS region FROM live l LEFT JOIN m USING (sector_id)""")
def region_of_systems(spark: S, folder: str) -> DataFrame:
    """A system's own region, else the most frequent one of its sector; sectors that hold very many systems are salted."""
    live = live_systems(spark, folder).select("system_id", "sector_id", "region_id")
    voted = agg.modal(live, ["sector_id"], "region_id", name="voted").drop("n")
    return salted_join(live, voted, ["sector_id"], "left", spread=F.xxhash64("system_id")).select("system_id", F.coalesce("region_id", "voted").alias("region"))


@query("SELECT poi_class, count(*) AS kinds, count(*) FILTER (removed_at IS NULL) AS live, string_agg(poi, ', ' ORDER BY poi) FILTER (needs_landing) AS on_ground FROM poi GROUP BY 1")
def poi_classes(spark: S, folder: str) -> DataFrame:
    p = table(spark, folder, "poi")
    ground = F.array_join(agg.in_order_of(F.when(F.col("needs_landing"), F.col("poi")), "poi"), ", ")
    return p.groupBy("poi_class").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("removed_at").isNull()).alias("live"), F.nullif(ground, F.lit("")).alias("on_ground"))


# --- several sources into one --------------------------------------------------------------------------------------
@query("""WITH u AS (SELECT system_id, 1 AS pri, run_id AS tie, x, y, z, region_id FROM system_known UNION ALL SELECT system_id, 2, 0, x, y, z, NULL FROM system_exobio)
          SELECT system_id, arg_min(x, (pri, tie, x)) AS x, arg_min(y, (pri, tie, y)) AS y, arg_min(z, (pri, tie, z)) AS z, arg_min(region_id, (pri, tie, region_id)) AS region_id, min(pri) AS best FROM u GROUP BY 1""")
def merged_systems(spark: S, folder: str) -> DataFrame:
    """Of two feeds, each column's first value that is set by the priority of the feeds; ties by the value itself."""
    a = table(spark, folder, "system_known", "system_id", "run_id", *XYZ, "region_id").withColumn("pri", F.lit(1))
    b = table(spark, folder, "system_exobio", "system_id", *XYZ).withColumns({"pri": F.lit(2), "run_id": F.lit(0)})
    u = a.unionByName(b, allowMissingColumns=True)
    return u.groupBy("system_id").agg(*[agg.min_by_held(c, "pri", "run_id", c).alias(c) for c in [*XYZ, "region_id"]], F.min("pri").alias("best"))


@query("""SELECT * FROM (SELECT record_id, system_id64, body_id, name, sub_type, update_time FROM spansh_galaxy_body)
          QUALIFY row_number() OVER (PARTITION BY system_id64, body_id ORDER BY update_time DESC, record_id, name, sub_type) = 1""")
def latest_bodies(spark: S, folder: str) -> DataFrame:
    b = table(spark, folder, "spansh_galaxy_body", "record_id", "system_id64", "body_id", "name", "sub_type", "update_time")
    return windows.pick_first(b, ["system_id64", "body_id"], F.desc_nulls_last("update_time"), F.asc("record_id"), F.asc_nulls_last("name"), F.asc_nulls_last("sub_type"))


@query("""WITH s AS (SELECT * FROM spansh_galaxy_body WHERE type = 'Star' QUALIFY row_number() OVER (PARTITION BY system_id64 ORDER BY dist_to_arrival_ls NULLS LAST, sub_type NULLS LAST, solar_masses IS NULL, body_id, record_id, name) = 1)
          SELECT system_id64, body_id, name FROM s""")
def primary_stars(spark: S, folder: str) -> DataFrame:
    """One primary per system by ordered rules."""
    b = table(spark, folder, "spansh_galaxy_body", "system_id64", "body_id", "name", "type", "dist_to_arrival_ls", "sub_type", "solar_masses", "record_id").where("type = 'Star'")
    first = windows.pick_first(b, ["system_id64"], F.asc_nulls_last("dist_to_arrival_ls"), F.asc_nulls_last("sub_type"), F.col("solar_masses").isNull().asc(), F.asc("body_id"), F.asc("record_id"), F.asc("name"))
    return first.select("system_id64", "body_id", "name")


@query("""WITH n AS (SELECT poi_id, count(DISTINCT system_id) AS systems FROM body_poi WHERE poi_id IS NOT NULL AND system_id IS NOT NULL GROUP BY 1)
          SELECT b.system_id, b.poi_id FROM (SELECT DISTINCT system_id, poi_id FROM body_poi WHERE system_id IS NOT NULL AND poi_id IS NOT NULL) b JOIN n USING (poi_id)
          QUALIFY row_number() OVER (PARTITION BY b.system_id ORDER BY n.systems, b.poi_id) = 1""")
def rarest_poi(spark: S, folder: str) -> DataFrame:
    """The rarest point of interest of each system; the number of systems of each goes to all tasks, for poi has 260 rows."""
    pairs = table(spark, folder, "body_poi", "system_id", "poi_id").dropna().distinct()
    n = pairs.groupBy("poi_id").agg(F.count(F.lit(1)).alias("systems"))
    return windows.pick_first(pairs.join(n, "poi_id"), ["system_id"], F.asc("systems"), F.asc("poi_id")).select("system_id", "poi_id")


@query("""SELECT source, strftime(reported_at, '%Y-%m') AS month, count(DISTINCT report_id) AS reports, count(DISTINCT report_id) FILTER (date_diff('second', reported_at, received_at) > 2592000) AS late FROM body_poi GROUP BY ALL""")
def reports_by_month(spark: S, folder: str) -> DataFrame:
    b = table(spark, folder, "body_poi", "report_id", "source", "reported_at", "received_at")
    late = F.unix_seconds("received_at") - F.unix_seconds("reported_at") > 30 * 86400
    return b.groupBy("source", F.date_format("reported_at", "yyyy-MM").alias("month")).agg(F.count_distinct("report_id").alias("reports"), F.count_distinct(F.when(late, F.col("report_id"))).alias("late"))


@query("""WITH e AS (SELECT DISTINCT system_id, poi_id, source FROM body_poi WHERE system_id IS NOT NULL)
          SELECT e.system_id, string_agg(DISTINCT p.poi_class, '+' ORDER BY p.poi_class) AS classes, count(DISTINCT e.poi_id) AS kinds, bool_or(e.source = 'canonn') AS by_canonn FROM e JOIN poi p USING (poi_id) GROUP BY 1""")
def phenomena(spark: S, folder: str) -> DataFrame:
    """Kinds of each system joined in order, with flags of who reported them."""
    e = table(spark, folder, "body_poi", "system_id", "poi_id", "source").where("system_id IS NOT NULL").distinct()
    e = e.join(table(spark, folder, "poi", "poi_id", "poi_class"), "poi_id")
    return e.groupBy("system_id").agg(agg.listed("poi_class", "+").alias("classes"), F.count_distinct("poi_id").alias("kinds"), F.bool_or(F.col("source") == "canonn").alias("by_canonn"))


# --- gaps, boxels, predictions -------------------------------------------------------------------------------------
@query("""WITH known AS (SELECT DISTINCT sector_id, cube_id, mass_code, coalesce(sub_cube_id, -1) AS sub, boxel_index FROM system_known WHERE cube_id IS NOT NULL AND boxel_index IS NOT NULL),
          beside AS (SELECT *, lead(boxel_index) OVER one AS following, count(*) OVER whole AS held, max(boxel_index) OVER whole - min(boxel_index) OVER whole AS steps FROM known
                     WINDOW one AS (PARTITION BY sector_id, cube_id, mass_code, sub ORDER BY boxel_index), whole AS (PARTITION BY sector_id, cube_id, mass_code, sub))
          SELECT sector_id, cube_id, mass_code, sub, unnest(range(boxel_index + 1, following))::INTEGER AS missing FROM beside WHERE 2 * held > steps""")
def boxel_gaps(spark: S, folder: str) -> DataFrame:
    """Numbers that are missing between those known, in boxels of which half is known."""
    keys = ["sector_id", "cube_id", "mass_code", "sub"]
    k = table(spark, folder, "system_known", "sector_id", "cube_id", "mass_code", "sub_cube_id", "boxel_index").where("cube_id IS NOT NULL")
    found = runs.gaps(k.withColumn("sub", F.coalesce("sub_cube_id", F.lit(-1))), keys, "boxel_index", least_filled=0.5)
    return found.select(*keys, F.explode(F.sequence("first", "last")).alias("missing"))


@query("""WITH known AS (SELECT DISTINCT system_id64, body_id FROM spansh_galaxy_body), span AS (SELECT system_id64, min(body_id) AS low, max(body_id) AS high, count(*) AS held FROM known GROUP BY 1)
          SELECT system_id64, missing FROM span, unnest(range(low, high + 1)) u(missing) WHERE held * 3 >= high - low + 1 EXCEPT SELECT system_id64, body_id FROM known""")
def body_gaps(spark: S, folder: str) -> DataFrame:
    """Bodies that are missing between those known, in systems of which a third is known."""
    found = runs.gaps(table(spark, folder, "spansh_galaxy_body", "system_id64", "body_id").distinct(), ["system_id64"], "body_id", least_filled=1 / 3)
    return found.select("system_id64", F.explode(F.sequence("first", "last")).alias("missing"))


@query(f"""WITH {_LIVE}, k AS (SELECT DISTINCT system_id, sector_id, cube_id, mass_code FROM live), s AS (SELECT DISTINCT system_id64 FROM spansh_galaxy_body)
           SELECT mass_code, count(*) AS systems, count(s.system_id64) AS scanned, round((count(s.system_id64) + 1) / (count(*) + 2e0), 6) AS rate FROM k LEFT JOIN s ON s.system_id64 = k.system_id GROUP BY mass_code""")
def scanned_share(spark: S, folder: str) -> DataFrame:
    k = live_systems(spark, folder).select("system_id", "mass_code")
    s = table(spark, folder, "spansh_galaxy_body", "system_id64").distinct().select(F.col("system_id64").alias("system_id"), F.lit(1).alias("hit"))
    return k.join(s, "system_id", "left").groupBy("mass_code").agg(F.count(F.lit(1)).alias("systems"), F.count("hit").alias("scanned"), F.round(expr.laplace(F.count("hit"), F.count(F.lit(1))), 6).alias("rate"))


@query("""WITH b AS (SELECT DISTINCT record_id, sub_type, CAST(least(greatest(floor(surface_temp_k / 20) * 20, 100), 440) AS INTEGER) AS band, signal_biology > 0 AS bio FROM spansh_galaxy_body WHERE is_landable AND surface_temp_k IS NOT NULL),
          c AS (SELECT CASE WHEN grouping(band) = 1 THEN -1 ELSE band END AS band, sub_type, count(*) AS n, count(*) FILTER (bio) AS k FROM b GROUP BY GROUPING SETS ((sub_type, band), (sub_type)))
          SELECT sub_type, band, n, k, round((k + 1) / (n + 2e0), 6) AS p FROM c""")
def biology_odds(spark: S, folder: str) -> DataFrame:
    """Odds by kind of body and 20-K band, and by kind alone."""
    b = table(spark, folder, "spansh_galaxy_body", "record_id", "sub_type", "is_landable", "surface_temp_k", "signal_biology").where("is_landable AND surface_temp_k IS NOT NULL")
    b = b.select("record_id", "sub_type", expr.stepped("surface_temp_k", 20, 100, 440).cast("string").alias("band"), (F.col("signal_biology") > 0).alias("bio")).distinct()
    rolled = agg.wildcard_rollup(b, ["sub_type"], "band", F.count(F.lit(1)).alias("n"), F.count_if(F.col("bio")).alias("k"), star="-1")
    return rolled.select("sub_type", F.col("band").cast("int").alias("band"), "n", "k", F.round(expr.laplace("k", "n"), 6).alias("p"))


@query("""WITH seen AS (SELECT best_species AS name, count(DISTINCT system_id) AS n FROM system_exobio WHERE best_species IS NOT NULL GROUP BY 1),
          held AS (SELECT regexp_extract(name, '^[^ ]*') AS genus, sum(n) AS all_of, list({'down': -n, 'name': name} ORDER BY -n, name) AS kinds FROM seen GROUP BY 1),
          frequent AS (SELECT genus, all_of, list_filter(kinds, lambda k: -k.down * 20 >= all_of)[:3] AS kinds FROM held)
          SELECT genus, array_to_string(list_transform(kinds, lambda k: format('{} {}%', k.name, -k.down * 100 // all_of)), ', ') AS likely FROM frequent WHERE len(kinds) > 0""")
def likely_species(spark: S, folder: str) -> DataFrame:
    """The three most frequent species of a genus with a share of 5 % or more, as a text."""
    s = table(spark, folder, "system_exobio", "system_id", "best_species").where("best_species IS NOT NULL").distinct()
    n = s.groupBy("best_species").agg(F.count(F.lit(1)).alias("n")).withColumn("genus", F.split_part("best_species", F.lit(" "), F.lit(1)))
    n = n.withColumn("total", F.sum("n").over(W.partitionBy("genus"))).where("n * 20 >= total")
    top = windows.top_k(n, ["genus"], 3, F.desc("n"), F.asc("best_species"), rank="r")
    text = F.concat_ws(" ", "best_species", F.concat(F.floor(F.col("n") * 100 / F.col("total")).cast("string"), F.lit("%")))
    return top.withColumn("text", text).groupBy("genus").agg(F.array_join(agg.in_order_of("text", "r"), ", ").alias("likely"))


# --- nearest, boxes, corridors -------------------------------------------------------------------------------------
@query(f"SELECT system_id, system, round({_D}, 4) AS ly FROM (SELECT DISTINCT system_id, system, x, y, z FROM system_exobio WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL) ORDER BY {_D}, system_id LIMIT 25")
def nearest_systems(spark: S, folder: str) -> DataFrame:
    """The nearest 25 to a place."""
    s = table(spark, folder, "system_exobio", "system_id", "system", *XYZ).na.drop(subset=XYZ).distinct()
    return s.withColumn("d", expr.distance3(XYZ, SHIP)).orderBy("d", "system_id").limit(25).select("system_id", "system", F.round("d", 4).alias("ly"))


@query(f"SELECT DISTINCT system_id, round({_D}, 4) AS ly FROM system_exobio WHERE x BETWEEN -8143.65625 - 250 AND -8143.65625 + 250 AND y BETWEEN -2103.71875 - 250 AND -2103.71875 + 250 AND z BETWEEN 12369.75 - 250 AND 12369.75 + 250 AND {_D} <= 250")
def box_and_sphere(spark: S, folder: str) -> DataFrame:
    """Systems within 250 ly: the box reaches the scan, the sphere does the rest."""
    s = table(spark, folder, "system_exobio", "system_id", *XYZ).where(expr.in_box(XYZ, SHIP, 250.0))
    return s.withColumn("d", expr.distance3(XYZ, SHIP)).where("d <= 250").select("system_id", F.round("d", 4).alias("ly")).distinct()


@query("""WITH c AS (SELECT DISTINCT callsign, x, y, z, ((x - -8000) * 2000 + (y - -2000) * 0 + (z - 12000) * 1000) / 5e6 AS t FROM carrier_position WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL)
          SELECT callsign, round(t, 6) AS t, round(sqrt((x - -8000 - t * 2000) ** 2 + (y - -2000) ** 2 + (z - 12000 - t * 1000) ** 2), 4) AS off FROM c
          WHERE t BETWEEN 0 AND 1 AND (x - -8000 - t * 2000) ** 2 + (y - -2000) ** 2 + (z - 12000 - t * 1000) ** 2 <= 900.0 ** 2""")
def cylinder(spark: S, folder: str) -> DataFrame:
    """Carriers within 900 ly of a line, and how far along it."""
    c = table(spark, folder, "carrier_position", "callsign", *XYZ).na.drop(subset=XYZ).distinct()
    t, off2 = expr.along(XYZ, (-8000.0, -2000.0, 12000.0), (-6000.0, -2000.0, 13000.0))
    c = c.withColumns({"t": t, "o": off2}).where("t BETWEEN 0 AND 1 AND o <= 900.0 * 900.0")
    return c.select("callsign", F.round("t", 6).alias("t"), F.round(F.sqrt("o"), 4).alias("off"))


@query("""SELECT DISTINCT system_id FROM system_exobio WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND
          sqrt((x - -8000) ** 2 + (y - -2000) ** 2 + (z - 12000) ** 2) + sqrt((x - -6000) ** 2 + (y - -2000) ** 2 + (z - 13000) ** 2) <= 2600""")
def spheroid(spark: S, folder: str) -> DataFrame:
    """Systems whose detour between two places is at most 2600 ly."""
    s = table(spark, folder, "system_exobio", "system_id", *XYZ).na.drop(subset=XYZ)
    return s.where(expr.in_spheroid(XYZ, (-8000.0, -2000.0, 12000.0), (-6000.0, -2000.0, 13000.0), 2600.0)).select("system_id").distinct()


@query("""WITH s AS (SELECT DISTINCT system_id, system, x, y, z FROM system_exobio WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
          c AS (SELECT callsign, system, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM carrier_position WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY ALL)
          SELECT c.callsign, s.system_id, round(sqrt((s.x - c.x) ** 2 + (s.y - c.y) ** 2 + (s.z - c.z) ** 2), 4) AS ly FROM c JOIN s ON abs(c.x - s.x) < 20 AND abs(c.y - s.y) < 20 AND abs(c.z - s.z) < 20
          QUALIFY row_number() OVER (PARTITION BY c.callsign ORDER BY (s.x - c.x) ** 2 + (s.y - c.y) ** 2 + (s.z - c.z) ** 2, s.system_id) = 1""")
def nearest_in_band(spark: S, folder: str) -> DataFrame:
    """For each carrier the nearest system within a 20-ly box, by cubes of space."""
    s = table(spark, folder, "system_exobio", "system_id", *XYZ).na.drop(subset=XYZ).distinct().select("system_id", *[F.col(c).alias(f"s{c}") for c in XYZ])
    c = table(spark, folder, "carrier_position", "callsign", "system", *XYZ).na.drop(subset=XYZ).groupBy("callsign", "system").agg(*[F.avg(k).alias(k) for k in XYZ])
    pairs = joins.grid_pairs(c, s, 20.0, left_xyz=XYZ, right_xyz=["sx", "sy", "sz"], box=True)
    return windows.pick_first(pairs, ["callsign"], F.asc("distance"), F.asc("system_id")).select("callsign", "system_id", F.round("distance", 4).alias("ly"))


@query("""WITH c AS (SELECT region_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM system_known WHERE region_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY 1),
          s AS (SELECT DISTINCT system_id, x, y, z FROM system_exobio WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL)
          SELECT system_id, region_id, round(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2), 3) AS ly FROM s CROSS JOIN c QUALIFY row_number() OVER (PARTITION BY system_id ORDER BY (x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2, region_id) = 1""")
def nearest_region_centre(spark: S, folder: str) -> DataFrame:
    """The nearest of the 42 region centres, without a cross join."""
    c = table(spark, folder, "system_known", "region_id", *XYZ).dropna().groupBy("region_id").agg(*[F.avg(k).alias(f"c{k}") for k in XYZ])
    s = table(spark, folder, "system_exobio", "system_id", *XYZ).na.drop(subset=XYZ).distinct()
    out = joins.nearest_centre(s, c, xyz=XYZ, centre_xyz=["cx", "cy", "cz"], centre="region_id")
    return out.select("system_id", "region_id", F.round("distance", 3).alias("ly"))


@query("""WITH k AS (SELECT system_id, min(x) AS x, min(y) AS y, min(z) AS z, min(region_id) AS region_id FROM system_known WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY 1),
          n AS (SELECT a.system_id, b.region_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM k a, k b WHERE a.region_id IS NULL AND b.region_id IS NOT NULL),
          v AS (SELECT system_id, h.region_id, count(*) AS n FROM (SELECT system_id, unnest(min({'d': d, 'region_id': region_id}, 5)) AS h FROM n GROUP BY 1) GROUP BY ALL)
          SELECT system_id, min({'n': -n, 'region_id': region_id}).region_id AS region_id FROM v GROUP BY 1""")
def neighbour_votes(spark: S, folder: str) -> DataFrame:
    """Regions of all located unlabelled systems by the majority of the five nearest labelled ones, however far."""
    k = table(spark, folder, "system_known", "system_id", *XYZ, "region_id").na.drop(subset=XYZ).groupBy("system_id").agg(*[F.min(c).alias(c) for c in XYZ], F.min("region_id").alias("region_id"))
    return joins.nearest_votes(k.where("region_id IS NULL"), k.where("region_id IS NOT NULL"), ident="system_id", xyz=XYZ, label="region_id")


@query(f"""WITH {_LIVE}, s AS (SELECT sector_id, mass_code, count(*) AS n FROM live WHERE x BETWEEN -8143.65625 - 1920 AND -8143.65625 + 1920 AND y BETWEEN -2103.71875 - 1920 AND -2103.71875 + 1920 AND z BETWEEN 12369.75 - 1920 AND 12369.75 + 1920 GROUP BY ALL)
           SELECT sector_id, sum(n)::BIGINT AS systems, string_agg(coalesce(mass_code, '?') || ':' || n, ' ' ORDER BY coalesce(mass_code, '?')) AS by_mass FROM s GROUP BY sector_id""")
def adjacent_sectors(spark: S, folder: str) -> DataFrame:
    """Sectors of the block around a place with their systems by mass code."""
    n = live_systems(spark, folder).where(expr.in_box(XYZ, SHIP, 1920.0)).groupBy("sector_id", F.coalesce("mass_code", F.lit("?")).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("sector_id").agg(F.sum("n").alias("systems"), F.array_join(agg.in_order_of(F.concat_ws(":", "m", F.col("n").cast("string")), "m"), " ").alias("by_mass"))


@query(f"""WITH {_LIVE} SELECT CAST(floor((x + 49985) * 83 / 8192) AS INTEGER) AS cx, CAST(floor((z + 24105) * 83 / 8192) AS INTEGER) AS cz, count(*) AS n FROM live WHERE x IS NOT NULL AND z IS NOT NULL GROUP BY 1, 2""")
def density_grid(spark: S, folder: str) -> DataFrame:
    cell = lambda c, o: F.floor((F.col(c) + F.lit(o)) * 83 / 8192).cast("int")
    return live_systems(spark, folder).na.drop(subset=["x", "z"]).groupBy(cell("x", 49985.0).alias("cx"), cell("z", 24105.0).alias("cz")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_LIVE}, g AS (SELECT DISTINCT CAST(floor((z + 24105) * 83 / 4096) AS INTEGER) AS zr, CAST(floor((x + 49985) * 83 / 4096) AS INTEGER) AS xc FROM live WHERE x IS NOT NULL AND z IS NOT NULL),
           r AS (SELECT zr, xc, xc - row_number() OVER (PARTITION BY zr ORDER BY xc) AS island FROM g) SELECT zr, min(xc) AS start, count(*) AS length FROM r GROUP BY zr, island""")
def raster_runs(spark: S, folder: str) -> DataFrame:
    """Occupied cells of the region raster as runs."""
    cell = lambda c, o: F.floor((F.col(c) + F.lit(o)) * 83 / 4096).cast("int")
    g = live_systems(spark, folder).na.drop(subset=["x", "z"]).select(cell("z", 24105.0).alias("zr"), cell("x", 49985.0).alias("xc")).distinct().withColumn("v", F.lit(1))
    return runs.encode(g, "zr", "xc", "v").select("zr", "start", "length")


# --- settled state -------------------------------------------------------------------------------------------------
@query("""WITH e AS (SELECT DISTINCT system_id, system FROM system_exobio), k AS (SELECT DISTINCT system_id FROM system_known WHERE removed_at IS NULL), b AS (SELECT DISTINCT system_id FROM body_poi WHERE system_id IS NOT NULL),
          a AS (SELECT DISTINCT system_a AS system FROM system_catalog_alias), c AS (SELECT DISTINCT system_id FROM system_catalog WHERE system_id IS NOT NULL)
          SELECT e.system_id, k.system_id IS NOT NULL AS known, b.system_id IS NOT NULL AS reported, a.system IS NOT NULL AS has_alias, c.system_id IS NOT NULL AS catalogued
          FROM e LEFT JOIN k USING (system_id) LEFT JOIN b USING (system_id) LEFT JOIN a ON a.system = e.system LEFT JOIN c ON c.system_id = e.system_id""")
def status_bundle(spark: S, folder: str) -> DataFrame:
    """Flags from four lookups, each distinct before it is joined."""
    flag = lambda df, key, name: df.where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    e = table(spark, folder, "system_exobio", "system_id", "system").distinct()
    e = e.join(flag(table(spark, folder, "system_known", "system_id", "removed_at").where("removed_at IS NULL").select("system_id"), "system_id", "known"), "system_id", "left")
    e = e.join(flag(table(spark, folder, "body_poi", "system_id"), "system_id", "reported"), "system_id", "left")
    e = e.join(flag(table(spark, folder, "system_catalog_alias", "system_a").withColumnRenamed("system_a", "system"), "system", "has_alias"), "system", "left")
    e = e.join(flag(table(spark, folder, "system_catalog", "system_id"), "system_id", "catalogued"), "system_id", "left")
    return e.select("system_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("known", "reported", "has_alias", "catalogued")])


#: Links that places are followed over, and passes in which ids spread over aliases, at most.
PLACE_HOPS, ALIAS_PASSES = 8, 12


@query(f"""WITH RECURSIVE e AS (SELECT system_a AS a, system_b AS b FROM system_catalog_alias WHERE system_a <> system_b), w AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)),
          r(name, hops) AS (SELECT DISTINCT system, 0 FROM system_exobio UNION SELECT w.b, r.hops + 1 FROM r JOIN w ON w.a = r.name WHERE r.hops < {PLACE_HOPS})
          SELECT name, min(hops) AS hops FROM r WHERE name IS NOT NULL GROUP BY name""")
def alias_reach(spark: S, folder: str) -> DataFrame:
    """Names within eight links of a known system's name."""
    pairs = table(spark, folder, "system_catalog_alias", "system_a", "system_b")
    return graphs.reach(table(spark, folder, "system_exobio", "system").withColumnRenamed("system", "name"), pairs, node="name", a="system_a", b="system_b", hops=PLACE_HOPS)


@query("""WITH u AS (SELECT system AS name, min(system_id) AS id FROM system_exobio GROUP BY 1 HAVING count(DISTINCT system_id) = 1),
          e AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT system_a AS a, system_b AS b FROM system_catalog_alias UNION ALL SELECT system_b, system_a FROM system_catalog_alias) WHERE a <> b),
          l0 AS MATERIALIZED (SELECT name, u.id FROM (SELECT DISTINCT a AS name FROM e) n LEFT JOIN u USING (name)), """ + ", ".join(f"""
          l{n} AS MATERIALIZED (SELECT l.name, coalesce(l.id, CASE WHEN lo = hi THEN lo END) AS id FROM l{n - 1} l LEFT JOIN (SELECT e.b AS name, min(k.id) AS lo, max(k.id) AS hi FROM e JOIN l{n - 1} k ON k.name = e.a WHERE k.id IS NOT NULL GROUP BY 1) t USING (name))""" for n in range(1, ALIAS_PASSES + 1)) + f" SELECT name, id FROM l{ALIAS_PASSES}")
def agreed_labels(spark: S, folder: str) -> DataFrame:
    """Ids that spread over aliases where all neighbours agree, until nothing changes, in twelve passes at most."""
    pairs = table(spark, folder, "system_catalog_alias", "system_a", "system_b")
    named = table(spark, folder, "system_exobio", "system", "system_id").groupBy(F.col("system").alias("name")).agg(F.min("system_id").alias("id"), F.max("system_id").alias("hi")).where("id = hi").drop("hi")
    nodes = pairs.where("system_a <> system_b").select(F.explode(F.array("system_a", "system_b")).alias("name")).distinct().join(named, "name", "left")
    return graphs.spread_labels(nodes, pairs, node="name", label="id", a="system_a", b="system_b", passes=ALIAS_PASSES)


# --- merges --------------------------------------------------------------------------------------------------------
@query("""WITH t AS (SELECT poi_id, poi, poi_class, poi_family FROM poi WHERE poi_id % 5 <> 0), s AS (SELECT poi_id, poi, CASE WHEN poi_id % 3 = 0 THEN 'changed' ELSE poi_class END AS poi_class, poi_family FROM poi WHERE poi_id % 7 <> 0)
          SELECT coalesce(t.poi_id, s.poi_id) AS poi_id, CASE WHEN s.poi_id IS NULL THEN t.poi ELSE s.poi END AS poi, CASE WHEN s.poi_id IS NULL THEN t.poi_class ELSE s.poi_class END AS poi_class, CASE WHEN t.poi_id IS NULL THEN s.poi_family ELSE coalesce(t.poi_family, s.poi_family) END AS poi_family,
          CASE WHEN t.poi_id IS NULL THEN 'inserted' WHEN s.poi_id IS NULL THEN 'same' WHEN t.poi IS DISTINCT FROM s.poi OR t.poi_class IS DISTINCT FROM s.poi_class THEN 'updated' ELSE 'same' END AS change FROM t FULL JOIN s ON t.poi_id = s.poi_id""")
def merge_changes(spark: S, folder: str) -> DataFrame:
    """A merge with change detection; poi_family is only filled."""
    p = table(spark, folder, "poi", "poi_id", "poi", "poi_class", "poi_family")
    s = p.where("poi_id % 7 <> 0").withColumn("poi_class", F.when(F.col("poi_id") % 3 == 0, "changed").otherwise(F.col("poi_class")))
    return merging.merge(p.where("poi_id % 5 <> 0"), s, ["poi_id"], {"poi_family": merging.FILL})


@query("""WITH t AS (SELECT poi_id, poi, removed_at IS NULL AS is_listed FROM poi), s AS (SELECT poi_id, poi, true AS is_listed FROM poi WHERE poi_class <> 'hulk')
          SELECT poi_id, t.poi, CASE WHEN s.poi_id IS NULL THEN false ELSE true END AS is_listed, CASE WHEN s.poi_id IS NULL THEN CASE WHEN t.is_listed THEN 'absent' ELSE 'same' END WHEN t.is_listed THEN 'same' ELSE 'updated' END AS change FROM t LEFT JOIN s USING (poi_id)""")
def merge_soft_delete(spark: S, folder: str) -> DataFrame:
    """Rows that the source no longer holds are unlisted, not deleted."""
    t = table(spark, folder, "poi", "poi_id", "poi", "poi_class", "removed_at")
    s = t.where("poi_class <> 'hulk'").select("poi_id", "poi", F.lit(True).alias("is_listed"))
    return merging.merge(t.select("poi_id", "poi", F.col("removed_at").isNull().alias("is_listed")), s, ["poi_id"], absent={"is_listed": F.lit(False)})


@query("""WITH t AS (SELECT poi_id, sources FROM poi WHERE poi_id % 2 = 0), s AS (SELECT poi_id, CASE WHEN poi_id % 4 = 0 THEN 'canonn' ELSE 'edsm' END AS sources FROM poi),
          rk AS (SELECT * FROM (VALUES ('canonn', 1), ('canonn+edsm', 2), ('edsm', 3)) v(n, r))
          SELECT s.poi_id, CASE WHEN t.poi_id IS NULL OR coalesce(rs.r, 4) <= coalesce(rt.r, 4) THEN s.sources ELSE t.sources END AS sources FROM s LEFT JOIN t USING (poi_id) LEFT JOIN rk rs ON rs.n = s.sources LEFT JOIN rk rt ON rt.n = t.sources""")
def merge_by_priority(spark: S, folder: str) -> DataFrame:
    """A row changes only if the source is at least as good as the one it has."""
    p = table(spark, folder, "poi", "poi_id", "sources")
    s = p.select("poi_id", F.when(F.col("poi_id") % 4 == 0, "canonn").otherwise("edsm").alias("sources"))
    return merging.merge(p.where("poi_id % 2 = 0"), s, ["poi_id"], guard=merging.ranked_guard("sources", ["canonn", "canonn+edsm", "edsm"])).drop("change")


@query("SELECT entry_id AS k, count(*) AS n FROM system_catalog GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT report_id, count(*) FROM body_poi GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark: S, folder: str) -> DataFrame:
    a = merging.repeated_keys(table(spark, folder, "system_catalog", "entry_id"), ["entry_id"]).withColumnRenamed("entry_id", "k")
    return a.unionByName(merging.repeated_keys(table(spark, folder, "body_poi", "report_id"), ["report_id"]).withColumnRenamed("report_id", "k"))


@query("""SELECT 'candidates' AS rule, count(*) FILTER (NOT candidate_bodies >= unmapped_bodies) AS n FROM system_exobio UNION ALL SELECT 'place', count(*) FILTER (NOT abs(x) < 40000) FROM system_exobio""")
def broken_rules(spark: S, folder: str) -> DataFrame:
    e = table(spark, folder, "system_exobio", "candidate_bodies", "unmapped_bodies", "x")
    return merging.broken_rules(e, {"candidates": F.col("candidate_bodies") >= F.col("unmapped_bodies"), "place": F.abs("x") < 40000})


QUERIES, SQL = query.queries, query.sql
