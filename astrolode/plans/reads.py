"""Reads over the derived tables: what lies near a place, what is expected where, and what a system holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import agg, expr, windows
from ..operators import joins, merging
from ..operators.skew import salted_join
from ..storage import Scratch
from . import derive
from .derive import _BODY, _FACTOR, _PLACE, _POOL, bodies
from .galaxy import SHIP, XYZ
from .registry import Book
from .tables import table

query = Book()
S = SparkSession
_X, _Y, _Z = SHIP
#: Distance of x, y, z from the ship, in SQL.
_LY = f"sqrt((x - ({_X})) ** 2 + (y - ({_Y})) ** 2 + (z - ({_Z})) ** 2)"


def _places(spark: S, folder: str) -> DataFrame:
    """Located systems that are not removed, one row each."""
    k = table(spark, folder, "system_known", "system_id", *XYZ, "mass_code", "region_id", "body_count", "removed_at").where("removed_at IS NULL").na.drop(subset=XYZ)
    return k.groupBy("system_id").agg(*[F.min(c).alias(c) for c in XYZ], F.min("mass_code").alias("mass"), F.min("region_id").alias("region_id"), F.min("body_count").alias("body_count"))


# --- targets -------------------------------------------------------------------------------------------------------
@query(f"""WITH {_POOL}, {_PLACE.replace("place AS", "spot AS")}, score AS (SELECT TRY_CAST(target AS BIGINT) AS system_id, round(least(coalesce(rate, 0) * coalesce(strict, 1), 1) * p_exist, 6) AS worth FROM pool p LEFT JOIN rate r ON r.mass IS NOT DISTINCT FROM p.mass AND r.band = p.band LEFT JOIN factor f ON f.region_id = p.region_id),
           listed AS (SELECT system_id, 'predicted' AS origin, worth FROM score WHERE system_id IS NOT NULL UNION ALL SELECT DISTINCT system_id, 'reported', 2e0 FROM body_poi WHERE system_id IS NOT NULL)
           SELECT system_id, min(origin) AS origin, max(worth) AS worth, round({_LY}, 3) AS ly FROM listed JOIN spot USING (system_id) WHERE NOT EXISTS (SELECT 1 FROM system_exobio e WHERE e.system_id = listed.system_id)
           GROUP BY system_id, x, y, z ORDER BY worth DESC, {_LY}, system_id LIMIT 40""")
def top_targets(spark: S, folder: str) -> DataFrame:
    """Reported and predicted systems in one ranking by worth, then distance, without those that are settled."""
    p = derive.predicted_systems(spark, folder).select(F.col("target").try_cast("long").alias("system_id"), F.lit("predicted").alias("origin"), F.col("score").alias("worth")).where("system_id IS NOT NULL")
    r = table(spark, folder, "body_poi", "system_id").where("system_id IS NOT NULL").distinct().select("system_id", F.lit("reported").alias("origin"), F.lit(2.0).alias("worth"))
    listed = p.unionByName(r).join(table(spark, folder, "system_exobio", "system_id"), "system_id", "left_anti").groupBy("system_id").agg(F.min("origin").alias("origin"), F.max("worth").alias("worth"))
    d = expr.distance3(XYZ, SHIP)
    return listed.join(_places(spark, folder), "system_id").withColumn("d", d).orderBy(F.desc("worth"), "d", "system_id").limit(40).select("system_id", "origin", "worth", F.round("d", 3).alias("ly"))


@query(f"""WITH {_BODY}, {_PLACE}, found AS (SELECT DISTINCT CASE WHEN spectral_class = 'N' THEN 'neutron' WHEN spectral_class IN ('A', 'F') THEN 'bright' WHEN sub_type LIKE 'Gas giant%' THEN 'giant' END AS kind, system_id64 AS system_id FROM body),
           near AS (SELECT kind, mass, system_id, {_LY} AS ly FROM found JOIN place USING (system_id) WHERE kind IS NOT NULL)
           SELECT kind, mass, count(*) AS open, min({{'ly': ly, 'system_id': system_id}}).system_id AS nearest, round(min(ly), 3) AS ly FROM near GROUP BY kind, mass""")
def confirmed_nearest(spark: S, folder: str) -> DataFrame:
    """Of each kind and mass code how many finds there are, and the nearest."""
    kind = F.when(F.col("spectral_class") == "N", "neutron").when(F.col("spectral_class").isin("A", "F"), "bright").when(F.col("sub_type").startswith("Gas giant"), "giant")
    found = bodies(spark, folder, "spectral_class", "sub_type").select(F.col("system_id64").alias("system_id"), kind.alias("kind")).where("kind IS NOT NULL").distinct()
    near = found.join(_places(spark, folder), "system_id").groupBy("kind", "mass").agg(F.count(F.lit(1)).alias("open"), F.min(F.struct(expr.distance3(XYZ, SHIP).alias("d"), "system_id")).alias("m"))
    return near.select("kind", "mass", "open", F.col("m.system_id").alias("nearest"), F.round("m.d", 3).alias("ly"))


@query(f"""WITH {_PLACE}, held AS (SELECT DISTINCT b.system_id, p.poi_class, p.poi FROM body_poi b JOIN poi p USING (poi_id) WHERE p.removed_at IS NULL)
           SELECT system_id, poi_class, string_agg(poi, ', ' ORDER BY poi) AS pois, round({_LY}, 3) AS ly FROM held JOIN place USING (system_id) GROUP BY system_id, poi_class, x, y, z QUALIFY row_number() OVER (PARTITION BY poi_class ORDER BY {_LY}, system_id) <= 3""")
def pois_nearest(spark: S, folder: str) -> DataFrame:
    """The three nearest systems with points of each class, and which they are."""
    p = table(spark, folder, "poi", "poi_id", "poi_class", "poi", "removed_at").where("removed_at IS NULL").drop("removed_at")
    held = table(spark, folder, "body_poi", "system_id", "poi_id").join(p, "poi_id").select("system_id", "poi_class", "poi").distinct()
    each = held.groupBy("system_id", "poi_class").agg(agg.listed("poi").alias("pois")).join(_places(spark, folder), "system_id").withColumn("d", expr.distance3(XYZ, SHIP))
    return windows.top_k(each, ["poi_class"], 3, F.asc("d"), F.asc("system_id")).select("system_id", "poi_class", "pois", F.round("d", 3).alias("ly"))


@query(f"""WITH {_BODY}, {_PLACE}, giants AS (SELECT system_id64 AS system_id, bool_or(signal_biology > 0 OR ring_count > 0) AS sure FROM body WHERE sub_type LIKE 'Gas giant%' GROUP BY 1),
           told AS (SELECT system_id, 'reported' AS state FROM body_poi JOIN poi USING (poi_id) WHERE poi_class = 'ggg' AND system_id IS NOT NULL UNION SELECT system_id, CASE WHEN sure THEN 'likely' ELSE 'possible' END FROM giants)
           SELECT state, arg_min(system_id, ({_LY}, system_id)) AS system_id, round(min({_LY}), 3) AS ly, count(*) AS n FROM told JOIN place USING (system_id) GROUP BY state""")
def giants_nearest(spark: S, folder: str) -> DataFrame:
    """The nearest system with a reported, a likely and a possible giant."""
    g = bodies(spark, folder, "sub_type", "signal_biology", "ring_count").where(F.col("sub_type").startswith("Gas giant")).groupBy(F.col("system_id64").alias("system_id")).agg(F.bool_or((F.col("signal_biology") > 0) | (F.col("ring_count") > 0)).alias("sure"))
    said = table(spark, folder, "body_poi", "system_id", "poi_id").join(table(spark, folder, "poi", "poi_id", "poi_class").where("poi_class = 'ggg'"), "poi_id").where("system_id IS NOT NULL").select("system_id", F.lit("reported").alias("state")).distinct()
    told = said.unionByName(g.select("system_id", F.when(F.col("sure"), "likely").otherwise("possible").alias("state")))
    near = told.join(_places(spark, folder), "system_id").groupBy("state").agg(F.min(F.struct(expr.distance3(XYZ, SHIP).alias("d"), "system_id")).alias("m"), F.count(F.lit(1)).alias("n"))
    return near.select("state", F.col("m.system_id").alias("system_id"), F.round("m.d", 3).alias("ly"), "n")


@query(f"""WITH {_PLACE}, star AS (SELECT DISTINCT c.entry_id, x, y, z FROM system_catalog c JOIN place p USING (system_id) WHERE c.missing_coordinate IS NOT TRUE), hand AS (SELECT DISTINCT system_id, x, y, z FROM system_exobio WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
           d AS (SELECT s.entry_id, min(sqrt((s.x - h.x) ** 2 + (s.y - h.y) ** 2 + (s.z - h.z) ** 2)) AS near FROM star s JOIN hand h ON abs(s.x - h.x) < 60 AND abs(s.y - h.y) < 60 AND abs(s.z - h.z) < 60 GROUP BY 1)
           SELECT entry_id, printf('%.1f ly away', {_LY}) AS said, CASE WHEN near IS NULL THEN 'lonely' ELSE 'apart' END AS why FROM star LEFT JOIN d USING (entry_id) WHERE near IS NULL OR near >= 3""")
def unfound_targets(spark: S, folder: str) -> DataFrame:
    """Catalogued stars without a named system close by, with a text for the list."""
    stars = table(spark, folder, "system_catalog", "entry_id", "system_id", "missing_coordinate").where("missing_coordinate IS NULL OR NOT missing_coordinate").join(_places(spark, folder), "system_id").select("entry_id", *XYZ).distinct()
    hand = table(spark, folder, "system_exobio", *XYZ).na.drop().distinct().select(*[F.col(c).alias(f"h{c}") for c in XYZ])
    near = joins.grid_pairs(stars, hand, 60.0, left_xyz=XYZ, right_xyz=["hx", "hy", "hz"], box=True).groupBy("entry_id").agg(F.min("distance").alias("near"))
    out = stars.join(near, "entry_id", "left").where("near IS NULL OR near >= 3")
    return out.select("entry_id", F.format_string("%.1f ly away", expr.distance3(XYZ, SHIP)).alias("said"), F.when(F.col("near").isNull(), "lonely").otherwise("apart").alias("why"))


# --- what is expected where ----------------------------------------------------------------------------------------
@query(f"""WITH {_FACTOR} SELECT s.region_id, count(*) AS systems, count(*) FILTER (bright) AS found, round(sum(rate), 4) AS expected, round(sum(rate) * any_value(strict), 4) AS corrected FROM seen s JOIN rate r ON r.mass IS NOT DISTINCT FROM s.mass AND r.band = s.band LEFT JOIN factor f ON f.region_id IS NOT DISTINCT FROM s.region_id GROUP BY s.region_id""")
def region_expected(spark: S, folder: str) -> DataFrame:
    """Systems of a region, what was found there, and what the rates let expect, plain and corrected."""
    seen = derive._seen(spark, folder)
    rates = derive._rates(seen)
    f = derive._factors(seen, rates).select(F.col("region_id").alias("r"), "strict")
    each = seen.join(F.broadcast(rates.select(F.col("mass").alias("m"), F.col("band").alias("b"), "rate")), F.col("mass").eqNullSafe(F.col("m")) & (F.col("band") == F.col("b")))  # 36 rates
    n = each.groupBy("region_id").agg(F.count(F.lit(1)).alias("systems"), F.count_if("bright").alias("found"), F.sum("rate").alias("e"))
    return n.join(F.broadcast(f), F.col("region_id").eqNullSafe(F.col("r")), "left").select("region_id", "systems", "found", F.round("e", 4).alias("expected"), F.round(F.col("e") * F.col("strict"), 4).alias("corrected"))


@query(f"""WITH {_PLACE}, sec AS (SELECT system_id, min(sector_id) AS sector_id FROM system_known WHERE removed_at IS NULL GROUP BY 1), j AS (SELECT sector_id, system_id, body_count FROM place JOIN sec USING (system_id)),
           n AS (SELECT sector_id, count(*) AS systems, coalesce(sum(body_count), 0)::BIGINT AS bodies, max({{'n': coalesce(body_count, -1), 'id': -system_id}}) AS best FROM j GROUP BY 1)
           SELECT sector_id, systems, bodies, -best.id AS richest, round(systems / max(systems) OVER ()::DOUBLE, 6) AS of_most, rank() OVER (ORDER BY systems DESC)::BIGINT AS place FROM n""")
def sector_summary(spark: S, folder: str) -> DataFrame:
    """Systems and bodies of each sector, its richest system, and its size beside the largest; windows run over sectors."""
    sec = table(spark, folder, "system_known", "system_id", "sector_id", "removed_at").where("removed_at IS NULL").groupBy("system_id").agg(F.min("sector_id").alias("sector_id"))
    j = _places(spark, folder).select("system_id", "body_count").join(sec, "system_id")
    n = j.groupBy("sector_id").agg(F.count(F.lit(1)).alias("systems"), F.coalesce(F.sum("body_count"), F.lit(0)).alias("bodies"), F.max(F.struct(F.coalesce("body_count", F.lit(-1)).alias("n"), (-F.col("system_id")).alias("id"))).alias("best"))
    most = n.agg(F.max("systems").alias("most"))
    sizes = n.groupBy("systems").agg(F.count(F.lit(1)).alias("k"))  # ranks over the different sizes, which are few
    ranks = sizes.withColumn("place", F.coalesce(F.sum("k").over(W.orderBy(F.desc("systems")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1).drop("k")
    out = n.crossJoin(F.broadcast(most)).join(ranks, "systems")
    return out.select("sector_id", "systems", "bodies", (-F.col("best.id")).alias("richest"), F.round(F.col("systems") / F.col("most"), 6).alias("of_most"), "place")


@query(f"""WITH raster AS (SELECT CAST(floor((x + 49985) * 83 / 4096) AS INTEGER) AS cx, CAST(floor((z + 24105) * 83 / 4096) AS INTEGER) AS cz, mode(region_id ORDER BY region_id) AS region FROM system_known WHERE region_id IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL GROUP BY ALL),
           votes AS (SELECT CAST(floor((x + 49985) * 83 / 4096) AS INTEGER) AS cx, CAST(floor((z + 24105) * 83 / 4096) AS INTEGER) AS cz, region_id, count(*) AS n FROM system_known WHERE region_id IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL GROUP BY ALL),
           best AS (SELECT cx, cz, min({{'n': -n, 'r': region_id}}).r AS region FROM votes GROUP BY ALL)
           SELECT c.callsign, b.region FROM (SELECT DISTINCT callsign, x, z FROM carrier_position WHERE x IS NOT NULL AND z IS NOT NULL) c LEFT JOIN best b ON b.cx = CAST(floor((c.x + 49985) * 83 / 4096) AS INTEGER) AND b.cz = CAST(floor((c.z + 24105) * 83 / 4096) AS INTEGER)""")
def region_at(spark: S, folder: str) -> DataFrame:
    """The region of the raster cell that a place lies in; the cells are voted from the systems in them."""
    cell = [F.floor((F.col("x") + 49985.0) * 83 / 4096).cast("int").alias("cx"), F.floor((F.col("z") + 24105.0) * 83 / 4096).cast("int").alias("cz")]
    k = table(spark, folder, "system_known", "x", "z", "region_id").na.drop().select("region_id", *cell)
    best = agg.modal(k, ["cx", "cz"], "region_id", name="region").drop("n")
    c = table(spark, folder, "carrier_position", "callsign", "x", "z").na.drop(subset=["x", "z"]).select("callsign", "x", "z").distinct().select("callsign", *cell)
    return salted_join(c, best, ["cx", "cz"], "left").select("callsign", "region")


@query(f"""SELECT sector_id, sector_id & 127 AS sx, (sector_id >> 7) & 127 AS sy, sector_id >> 14 AS sz, -49985 + 1280e0 * (sector_id & 127) AS low_x, -24105 + 1280e0 * (sector_id >> 14) AS low_z, count(DISTINCT system_id) AS systems
           FROM system_known WHERE sector_id BETWEEN 1 AND 2097151 GROUP BY sector_id""")
def sector_cells(spark: S, folder: str) -> DataFrame:
    """Cells of the grid back from the ids of the sectors, with their corners."""
    k = table(spark, folder, "system_known", "sector_id", "system_id").where("sector_id BETWEEN 1 AND 2097151").groupBy("sector_id").agg(F.count_distinct("system_id").alias("systems"))
    i = F.col("sector_id")
    sx, sy, sz = i.bitwiseAND(F.lit(127)), F.call_function("shiftright", i, F.lit(7)).bitwiseAND(F.lit(127)), F.call_function("shiftright", i, F.lit(14))
    return k.select("sector_id", sx.alias("sx"), sy.alias("sy"), sz.alias("sz"), (sx * 1280.0 - 49985).alias("low_x"), (sz * 1280.0 - 24105).alias("low_z"), "systems")


@query(f"""WITH {_PLACE}, near AS (SELECT floor((x + 49985) / 1280)::BIGINT - floor(({_X} + 49985) / 1280)::BIGINT AS dx, floor((z + 24105) / 1280)::BIGINT - floor(({_Z} + 24105) / 1280)::BIGINT AS dz, mass, system_id, body_count FROM place),
           n AS (SELECT dx, dz, count(*) AS systems, sum(coalesce(body_count, 0))::BIGINT AS bodies FROM near WHERE abs(dx) <= 3 AND abs(dz) <= 3 GROUP BY ALL)
           SELECT *, CASE WHEN dx = 0 AND dz = 0 THEN NULL WHEN abs(degrees(atan2(dx, dz))) <= 22.5 THEN 'N' WHEN abs(degrees(atan2(dx, dz))) >= 157.5 THEN 'S' WHEN degrees(atan2(dx, dz)) BETWEEN 67.5 AND 112.5 THEN 'E' WHEN degrees(atan2(dx, dz)) BETWEEN -112.5 AND -67.5 THEN 'W'
             WHEN dx > 0 AND dz > 0 THEN 'NE' WHEN dx > 0 THEN 'SE' WHEN dz > 0 THEN 'NW' ELSE 'SW' END AS bearing FROM n""")
def cells_around(spark: S, folder: str) -> DataFrame:
    """The columns of cells around the ship with their sums and the bearing they lie at."""
    step = lambda c, at, o: (F.floor((F.col(c) + o) / 1280) - F.floor((F.lit(at) + o) / 1280)).cast("long")
    n = _places(spark, folder).select(step("x", _X, 49985.0).alias("dx"), step("z", _Z, 24105.0).alias("dz"), "body_count").where("abs(dx) <= 3 AND abs(dz) <= 3")
    n = n.groupBy("dx", "dz").agg(F.count(F.lit(1)).alias("systems"), F.sum(F.coalesce("body_count", F.lit(0))).alias("bodies"))
    return n.withColumn("bearing", expr.compass("dx", "dz"))


@query(f"""WITH {_PLACE}, d AS (SELECT floor(x / 500)::BIGINT AS i, floor(z / 500)::BIGINT AS j, count(*) AS n FROM place GROUP BY ALL), spot AS (SELECT DISTINCT callsign, (x - 250) / 500 AS u, (z - 250) / 500 AS v FROM carrier_position WHERE x IS NOT NULL AND z IS NOT NULL),
           corner AS (SELECT callsign, u, v, a.di, b.dj FROM spot, (VALUES (0), (1)) a(di), (VALUES (0), (1)) b(dj))
           SELECT callsign, u, v, round(sum(coalesce(n, 0) * CASE di WHEN 1 THEN u - floor(u) ELSE 1 - u + floor(u) END * CASE dj WHEN 1 THEN v - floor(v) ELSE 1 - v + floor(v) END), 2) AS density
           FROM corner LEFT JOIN d ON d.i = floor(u)::BIGINT + di AND d.j = floor(v)::BIGINT + dj GROUP BY ALL""")
def density_sampled(spark: S, folder: str) -> DataFrame:
    """The density at a place, bilinear between the middles of the four cells around it."""
    d = _places(spark, folder).groupBy(F.floor(F.col("x") / 500).alias("i"), F.floor(F.col("z") / 500).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    at = table(spark, folder, "carrier_position", "callsign", "x", "z").na.drop(subset=["x", "z"]).select("callsign", ((F.col("x") - 250) / 500).alias("u"), ((F.col("z") - 250) / 500).alias("v")).distinct()
    fu, fv = F.col("u") - F.floor("u"), F.col("v") - F.floor("v")
    part = lambda di, dj: F.struct((F.floor("u") + di).alias("i"), (F.floor("v") + dj).alias("j"), ((fu if di else 1 - fu) * (fv if dj else 1 - fv)).alias("w"))
    corners = at.select("callsign", "u", "v", F.inline(F.array(*[part(a, b) for a in (0, 1) for b in (0, 1)])))
    return salted_join(corners, d, ["i", "j"], "left").groupBy("callsign", "u", "v").agg(F.round(F.sum(F.coalesce("n", F.lit(0)) * F.col("w")), 2).alias("density"))


# --- what a system holds -------------------------------------------------------------------------------------------
@query(f"""WITH {_BODY}, asked AS (SELECT DISTINCT system_id FROM system_exobio), b AS (SELECT body.* FROM body JOIN asked ON system_id = system_id64),
           c AS (SELECT system_id64, body_id, name, sub_type, signal_biology, signal_geology, dist_to_arrival_ls, is_landable, least(greatest(floor(surface_temp_k / 20) * 20, 100), 440)::INTEGER AS band FROM b),
           own AS (SELECT sub_type, band, count(*) AS n, (count(*) FILTER (signal_biology > 0) + 1) / (count(*) + 2e0) AS p FROM c WHERE is_landable AND band IS NOT NULL GROUP BY ALL), wide AS (SELECT sub_type, (count(*) FILTER (signal_biology > 0) + 1) / (count(*) + 2e0) AS p FROM c WHERE is_landable AND band IS NOT NULL GROUP BY 1),
           o AS (SELECT c.*, CASE WHEN NOT coalesce(is_landable, false) OR c.band IS NULL THEN 0 WHEN signal_biology > 0 THEN 1 WHEN own.n >= 20 THEN own.p ELSE coalesce(wide.p, 0) END AS chance FROM c LEFT JOIN own ON own.sub_type = c.sub_type AND own.band = c.band LEFT JOIN wide ON wide.sub_type = c.sub_type)
           SELECT system_id64, name, round(chance, 6) AS chance, place FROM (SELECT *, row_number() OVER (PARTITION BY system_id64 ORDER BY round(chance, 9) DESC, coalesce(signal_geology, 0) DESC, dist_to_arrival_ls NULLS LAST, body_id) AS place FROM o) WHERE place <= 12""")
def system_bodies(spark: S, folder: str) -> DataFrame:
    """The twelve bodies of each asked system that are most worth a visit: certain biology, else the odds of their cell or kind."""
    asked = table(spark, folder, "system_exobio", F.col("system_id").alias("system_id64")).distinct()
    b = bodies(spark, folder, "name", "sub_type", "signal_biology", "signal_geology", "dist_to_arrival_ls", "is_landable", "surface_temp_k").join(asked, "system_id64", "left_semi")
    b = b.withColumn("band", expr.stepped("surface_temp_k", 20, 100, 440).cast("int").cast("string"))
    fit = F.coalesce("is_landable", F.lit(False)) & F.col("band").isNotNull()
    cells = agg.wildcard_rollup(b.where(fit), ["sub_type"], "band", F.count(F.lit(1)).alias("n"), F.count_if(F.col("signal_biology") > 0).alias("k")).withColumn("p", expr.laplace("k", "n"))
    o = joins.with_fallback(b, F.broadcast(cells), ["sub_type"], "band", ["p"], F.col("n") >= 20)  # kinds of bodies by 18 bands
    chance = F.when(~fit, 0.0).when(F.col("signal_biology") > 0, 1.0).otherwise(F.coalesce("p", F.lit(0.0)))
    o = o.withColumn("chance", chance)
    order = [F.desc(F.round("chance", 9)), F.desc(F.coalesce("signal_geology", F.lit(0))), F.asc_nulls_last("dist_to_arrival_ls"), F.asc("body_id")]
    return windows.top_k(o, ["system_id64"], 12, *order, rank="place").select("system_id64", "name", F.round("chance", 6).alias("chance"), "place")


@query(f"""WITH {_PLACE}, e AS (SELECT DISTINCT region_id, p.poi_class, p.poi_family, b.system_id, x, y, z FROM body_poi b JOIN poi p USING (poi_id) JOIN place USING (system_id) WHERE region_id IS NOT NULL)
           SELECT region_id, poi_class, poi_family, count(DISTINCT system_id) AS systems, arg_min(system_id, ({_LY}, system_id)) AS nearest FROM e GROUP BY region_id, poi_class, poi_family""")
def codex_entries(spark: S, folder: str) -> DataFrame:
    """What is known of each region by class and family, with the nearest example."""
    p = table(spark, folder, "poi", "poi_id", "poi_class", "poi_family")
    e = table(spark, folder, "body_poi", "system_id", "poi_id").join(p, "poi_id").drop("poi_id").distinct().join(_places(spark, folder).where("region_id IS NOT NULL"), "system_id")
    out = e.groupBy("region_id", "poi_class", "poi_family").agg(F.count_distinct("system_id").alias("systems"), F.min(F.struct(expr.distance3(XYZ, SHIP).alias("d"), "system_id")).alias("m"))
    return out.select("region_id", "poi_class", "poi_family", "systems", F.col("m.system_id").alias("nearest"))


# --- joins and merges of their own ---------------------------------------------------------------------------------
@query(f"""WITH s AS (SELECT system_id, min(x) AS x, min(y) AS y, min(z) AS z FROM system_exobio WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY 1), k AS (SELECT system_id AS known, min(x) AS kx, min(y) AS ky, min(z) AS kz FROM system_known WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY 1),
           d AS (SELECT system_id, known, sqrt((x - kx) ** 2 + (y - ky) ** 2 + (z - kz) ** 2) AS ly FROM s JOIN k ON abs(x - kx) <= 30 AND abs(y - ky) <= 30 AND abs(z - kz) <= 30), r AS (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY ly, known) AS r, lead(ly) OVER (PARTITION BY system_id ORDER BY ly, known) AS second FROM d WHERE ly <= 30)
           SELECT system_id, known, round(ly, 4) AS ly, round(second, 4) AS second, second IS NULL OR second >= greatest(2, 4 * ly) AS sure FROM r WHERE r = 1 AND ly <= 3""")
def sure_neighbours(spark: S, folder: str) -> DataFrame:
    """The known system within 3 ly of each reported one, sure if the runner-up is four times as far (and 2 ly) or absent."""
    one = lambda name, key, out, xyz: table(spark, folder, name, key, *XYZ).na.drop(subset=XYZ).groupBy(F.col(key).alias(out)).agg(*[F.min(c).alias(k) for c, k in zip(XYZ, xyz, strict=True)])
    pairs = joins.grid_pairs(one("system_exobio", "system_id", "system_id", XYZ), one("system_known", "system_id", "known", ["kx", "ky", "kz"]), 30.0, left_xyz=XYZ, right_xyz=["kx", "ky", "kz"])
    two = windows.top_k(pairs, ["system_id"], 2, F.asc("distance"), F.asc("known"), rank="r").groupBy("system_id").agg(F.min_by("known", "r").alias("known"), F.min("distance").alias("ly"), F.max(F.when(F.col("r") == 2, F.col("distance"))).alias("second"))
    return two.where("ly <= 3").select("system_id", "known", F.round("ly", 4).alias("ly"), F.round("second", 4).alias("second"), (F.col("second").isNull() | (F.col("second") >= F.greatest(F.lit(2.0), 4 * F.col("ly")))).alias("sure"))


@query("""WITH held AS (SELECT DISTINCT report_id, reported_at FROM body_poi WHERE reported_at < TIMESTAMPTZ '2022-01-01 00:00:00+00' AND source = 'canonn') SELECT DISTINCT report_id, source FROM body_poi b
          WHERE reported_at > (SELECT max(reported_at) - INTERVAL 30 DAY FROM held) AND NOT EXISTS (SELECT 1 FROM held h WHERE h.report_id = b.report_id)""")
def new_since_newest(spark: S, folder: str) -> DataFrame:
    """Reports later than the newest held one, less an overlap of 30 days, that are not held yet."""
    b = table(spark, folder, "body_poi", "report_id", "reported_at", "source")
    held = b.where("reported_at < TIMESTAMP '2022-01-01' AND source = 'canonn'").select("report_id", "reported_at")
    return merging.newer_only(held, b, ["report_id"], "reported_at", back="30 days").select("report_id", "source").distinct()


@query("""SELECT coalesce(e.system_id, k.system_id) AS system_id, coalesce(k.region_id, -1) AS region_id, coalesce(e.n, 0) AS reports FROM (SELECT system_id, count(*) AS n FROM system_exobio GROUP BY 1) e
          FULL JOIN (SELECT system_id, min(region_id) AS region_id FROM system_known WHERE run_id = 1 GROUP BY 1) k ON k.system_id = e.system_id""")
def bucketed_merge(spark: S, folder: str) -> DataFrame:
    """A merge worked out bucket by bucket of its key; the rows are those of the merge as a whole."""

    def step(e: DataFrame, k: DataFrame) -> DataFrame:
        a = e.groupBy("system_id").agg(F.count(F.lit(1)).alias("n"))
        b = k.groupBy("system_id").agg(F.min("region_id").alias("region_id"))
        return a.join(b, "system_id", "full").select("system_id", F.coalesce("region_id", F.lit(-1)).alias("region_id"), F.coalesce("n", F.lit(0)).alias("reports"))

    e, k = table(spark, folder, "system_exobio", "system_id"), table(spark, folder, "system_known", "system_id", "region_id", "run_id").where("run_id = 1")
    return merging.in_buckets(step, [e, k], "system_id", 4, Scratch(spark, "buckets"))


@query("""WITH old AS (SELECT system_a AS name, system_b AS other, 1 AS age FROM system_catalog_alias WHERE source <> 'cross'), new AS (SELECT system_a, system_b, 0 FROM system_catalog_alias WHERE source = 'cross')
          SELECT name, min({'age': age, 'other': other}).other AS other FROM (SELECT * FROM old UNION ALL SELECT * FROM new) WHERE name <> '' AND other <> '' GROUP BY name""")
def exported_aliases(spark: S, folder: str) -> DataFrame:
    """One alias per name over what a file holds and what is new; the new one wins, then the least."""
    a = table(spark, folder, "system_catalog_alias", "system_a", "system_b", "source").where("system_a <> '' AND system_b <> '' AND source IS NOT NULL")
    best = a.groupBy(F.col("system_a").alias("name")).agg(F.min(F.struct((F.col("source") != "cross").cast("int").alias("age"), F.col("system_b").alias("other"))).alias("m"))
    return best.select("name", F.col("m.other").alias("other"))


@query(f"""WITH {_BODY}, kind AS (SELECT system_id64 AS system_id, min(CASE WHEN spectral_class = 'N' THEN 'neutron' WHEN spectral_class IN ('A', 'F') THEN 'bright' END) AS kind FROM body GROUP BY 1), held AS (SELECT DISTINCT system_id FROM system_exobio)
           SELECT system_id, kind, coalesce(CAST((SELECT max(best_cr) FROM system_exobio) AS BIGINT), 0) > 0 AS snapshot FROM kind WHERE kind IS NOT NULL AND system_id NOT IN (SELECT system_id FROM held)""")
def promoted_finds(spark: S, folder: str) -> DataFrame:
    """Seen systems by what they turn out to be, inserted where they are not held yet, with a value of that moment."""
    kind = F.when(F.col("spectral_class") == "N", "neutron").when(F.col("spectral_class").isin("A", "F"), "bright")
    k = bodies(spark, folder, "spectral_class").groupBy(F.col("system_id64").alias("system_id")).agg(F.min(kind).alias("kind")).where("kind IS NOT NULL")
    e = table(spark, folder, "system_exobio", "system_id", "best_cr")
    now = e.agg((F.coalesce(F.max("best_cr"), F.lit(0)) > 0).alias("snapshot"))
    return k.join(e.select("system_id"), "system_id", "left_anti").crossJoin(F.broadcast(now))  # one row


@query("""WITH p AS (SELECT DISTINCT source, body, report_id, system_id FROM body_poi), k AS (SELECT system_id, min(x) AS x, min(y) AS y, min(z) AS z FROM system_known WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY 1)
          SELECT source, count(*) AS sites, median(x) AS x, median(y) AS y, median(z) AS z FROM p JOIN k USING (system_id) GROUP BY source""")
def site_medians(spark: S, folder: str) -> DataFrame:
    """The middle of the sites of each source, by exact positions."""
    k = table(spark, folder, "system_known", "system_id", *XYZ).na.drop(subset=XYZ).groupBy("system_id").agg(*[F.min(c).alias(c) for c in XYZ])
    p = Scratch(spark, "sites").write(table(spark, folder, "body_poi", "source", "body", "report_id", "system_id").distinct().join(k, "system_id"))
    out = p.groupBy("source").agg(F.count(F.lit(1)).alias("sites"))
    for c in XYZ:
        out = out.join(windows.percentiles(p, ["source"], c, {c: 0.5}), "source")
    return out


@query("""SELECT CASE WHEN candidate_bodies = 0 THEN 'none' WHEN candidate_bodies <= 2 THEN 'few' WHEN candidate_bodies <= 5 THEN 'some' ELSE 'many' END AS size, count(*) AS systems, count(*) FILTER (system LIKE '% h%-%' OR system LIKE '% g%-%') AS heavy, count(*) FILTER (best_species IS NULL) AS without_species FROM system_exobio GROUP BY 1""")
def load_report(spark: S, folder: str) -> DataFrame:
    """What a load brought, by size, with counts of names like a pattern."""
    e = table(spark, folder, "system_exobio", "candidate_bodies", "system", "best_species")
    size = F.when(F.col("candidate_bodies") == 0, "none").when(F.col("candidate_bodies") <= 2, "few").when(F.col("candidate_bodies") <= 5, "some").otherwise("many")
    return e.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("systems"), F.count_if(F.col("system").like("% h%-%") | F.col("system").like("% g%-%")).alias("heavy"), F.count_if(F.col("best_species").isNull()).alias("without_species"))


@query(f"""WITH hop AS (SELECT user_id, event_id, ts, value, lag(value) OVER w AS before, lag(ts) OVER w AS since FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
           SELECT user_id, event_id, round(value - before, 6) AS leg, round(sum(abs(value - before)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS way, value > before * 4 AS boosted FROM hop WHERE before IS NOT NULL""")
def legs(spark: S, folder: str) -> DataFrame:
    """Legs between successive places of each mover, the way so far, and which were boosted."""
    e = table(spark, folder, "events", "user_id", "event_id", "ts", "value")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    hop = e.withColumn("before", F.lag("value").over(w)).where("before IS NOT NULL")
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    return hop.select("user_id", "event_id", F.round(F.col("value") - F.col("before"), 6).alias("leg"), F.round(F.sum(F.abs(F.col("value") - F.col("before"))).over(so_far), 4).alias("way"), (F.col("value") > F.col("before") * 4).alias("boosted"))


@query("""SELECT record_id, round(1800 / (earth_masses * 100 + 400 + 64) * pow(400 / 12e0, 1 / 2.6), 6) AS ly FROM spansh_galaxy_body WHERE earth_masses IS NOT NULL""")
def ranges_by_load(spark: S, folder: str) -> DataFrame:
    """How far a drive carries, by load."""
    b = table(spark, folder, "spansh_galaxy_body", "record_id", "earth_masses").where("earth_masses IS NOT NULL")
    return b.select("record_id", F.round(expr.jump_range(F.lit(1800.0), F.lit(400.0), F.lit(64.0), F.col("earth_masses") * 100, 2.6, 12.0), 6).alias("ly"))


@query(f"""WITH {_BODY}, slot AS (SELECT system_id64, body_id // 4 AS slot, string_agg(DISTINCT left(coalesce(spectral_class, sub_type), 1), '' ORDER BY left(coalesce(spectral_class, sub_type), 1)) AS marks, count(*) FILTER (is_landable) AS candidates FROM body GROUP BY ALL)
           SELECT system_id64, slot, marks, candidates FROM slot""")
def slot_marks(spark: S, folder: str) -> DataFrame:
    """Marks of the kinds in each slot of a system, and how many candidates it has."""
    b = bodies(spark, folder, "spectral_class", "sub_type", "is_landable")
    mark = F.substring(F.coalesce("spectral_class", "sub_type"), 1, 1)
    return b.groupBy("system_id64", F.floor(F.col("body_id") / 4).alias("slot")).agg(agg.listed(mark, "").alias("marks"), F.count_if("is_landable").alias("candidates"))


@query("""WITH pairs AS (SELECT DISTINCT poi_class, coalesce(poi_family, '*') AS family FROM poi), w AS (SELECT p.poi_id, p.poi_class, p.poi_family FROM poi p)
          SELECT w.poi_id, coalesce(a.family, b.family) AS family FROM w LEFT JOIN pairs a ON a.poi_class = w.poi_class AND a.family = w.poi_family LEFT JOIN pairs b ON b.poi_class = w.poi_class AND b.family = '*'""")
def two_aliases(spark: S, folder: str) -> DataFrame:
    """A dimension joined twice: by its own key, and by the wildcard where that finds nothing."""
    p = table(spark, folder, "poi", "poi_id", "poi_class", "poi_family")
    dim = p.select("poi_class", F.coalesce("poi_family", F.lit("*")).alias("family")).distinct()
    own = dim.select("poi_class", F.col("family").alias("poi_family"), F.col("family").alias("own"))
    star = dim.where("family = '*'").select("poi_class", F.col("family").alias("star"))
    out = p.join(own, ["poi_class", "poi_family"], "left").join(star, "poi_class", "left")
    return out.select("poi_id", F.coalesce("own", "star").alias("family"))


QUERIES, SQL = query.queries, query.sql
