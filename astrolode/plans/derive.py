"""Derivations over several feeds: names, merged bodies, observations, odds with fallbacks, and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import agg, expr, windows
from ..operators import joins
from ..operators.skew import salted_join
from . import biology
from .registry import Book
from .tables import table

query = Book()
S = SparkSession
XYZ = ["x", "y", "z"]

#: The record of each body with the greatest number.
_BODY = "body AS (SELECT * FROM spansh_galaxy_body QUALIFY row_number() OVER (PARTITION BY system_id64, body_id ORDER BY record_id DESC) = 1)"
#: Where the sector ends in a systematic name, and what follows the system's name in a body's.
_SECTOR = r"^(.+?) [A-Z][A-Z]-[A-Z] [a-h]"
_AFTER = r"^.+? [A-Z][A-Z]-[A-Z] [a-h](?:[0-9]+-)?[0-9]+ ?(.*)$"


def bodies(spark: S, folder: str, *columns: str) -> DataFrame:
    """The record of each body with the greatest number."""
    b = table(spark, folder, "spansh_galaxy_body", "system_id64", "body_id", "record_id", *columns)
    return windows.pick_first(b, ["system_id64", "body_id"], F.desc("record_id"))


# --- names and systems ---------------------------------------------------------------------------------------------
@query(f"""WITH told AS (SELECT system_id, regexp_extract(system, '{_SECTOR}', 1) AS name FROM system_exobio UNION SELECT system_id64, regexp_extract(name, '{_SECTOR}', 1) FROM spansh_galaxy_body),
           votes AS (SELECT sector_id, name, count(DISTINCT system_id) AS systems FROM told JOIN (SELECT DISTINCT system_id, sector_id FROM system_known) USING (system_id) WHERE name <> '' GROUP BY ALL)
           SELECT sector_id, max({{'systems': systems, 'name': name}}).name AS name, max(systems) AS systems FROM votes GROUP BY sector_id""")
def sector_names(spark: S, folder: str) -> DataFrame:
    """The name that most systems of a sector bear in two feeds (of equal ones the last); names move as counts."""
    said = lambda df, key, name: df.select(F.col(key).alias("system_id"), F.regexp_extract(name, _SECTOR, 1).alias("name")).where("name <> ''")
    told = said(table(spark, folder, "system_exobio", "system_id", "system"), "system_id", "system").union(said(table(spark, folder, "spansh_galaxy_body", "system_id64", "name"), "system_id64", "name")).distinct()
    votes = told.join(table(spark, folder, "system_known", "system_id", "sector_id").distinct(), "system_id").groupBy("sector_id", "name").agg(F.count_distinct("system_id").alias("systems"))
    return votes.groupBy("sector_id").agg(F.max(F.struct("systems", "name")).alias("m")).select("sector_id", "m.name", "m.systems")


@query(f"""WITH told AS (SELECT DISTINCT sector_id, regexp_extract(system, '{_SECTOR}', 1) AS name FROM system_exobio JOIN (SELECT DISTINCT system_id, sector_id FROM system_known) USING (system_id)),
           one AS (SELECT name, min(sector_id) AS sector_id, count(*) AS ids FROM told WHERE name <> '' GROUP BY 1),
           asked AS (SELECT DISTINCT system, regexp_extract(system, '{_SECTOR}', 1) AS name FROM carrier_position WHERE system IS NOT NULL)
           SELECT system, CASE WHEN ids = 1 THEN sector_id END AS sector_id, CASE WHEN a.name = '' THEN 'no systematic name' WHEN ids IS NULL THEN 'unknown sector' WHEN ids > 1 THEN 'ambiguous sector' ELSE 'promoted' END AS outcome
           FROM asked a LEFT JOIN one ON one.name = a.name""")
def promoted_systems(spark: S, folder: str) -> DataFrame:
    """Names whose sector resolves to one id, and all others with the reason why they are skipped."""
    known = table(spark, folder, "system_known", "system_id", "sector_id").distinct()
    told = table(spark, folder, "system_exobio", "system_id", "system").distinct().join(known, "system_id").select("sector_id", F.regexp_extract("system", _SECTOR, 1).alias("name")).where("name <> ''").distinct()
    one = told.groupBy("name").agg(F.min("sector_id").alias("sector_id"), F.count(F.lit(1)).alias("ids"))
    asked = table(spark, folder, "carrier_position", "system").where("system IS NOT NULL").distinct().withColumn("name", F.regexp_extract("system", _SECTOR, 1))
    outcome = F.when(F.col("name") == "", "no systematic name").when(F.col("ids").isNull(), "unknown sector").when(F.col("ids") > 1, "ambiguous sector").otherwise("promoted")
    return asked.join(one, "name", "left").select("system", F.when(F.col("ids") == 1, F.col("sector_id")).alias("sector_id"), outcome.alias("outcome"))


# --- bodies of several feeds ---------------------------------------------------------------------------------------
_SOURCES = f"""{_BODY}, named AS (SELECT system_id, min(system) AS system FROM system_exobio GROUP BY 1),
    feeds AS (SELECT 1 AS rank, system_id64 AS system_id, CASE WHEN name = system THEN '' WHEN starts_with(name, system || ' ') THEN substr(name, length(system) + 2) ELSE name END AS body, body_id AS number, sub_type, surface_temp_k AS temp FROM body JOIN named ON system_id = system_id64
              UNION ALL SELECT CASE source WHEN 'canonn' THEN 2 ELSE 3 END, p.system_id, body, NULL, NULL, NULL FROM body_poi p JOIN named USING (system_id)
              UNION ALL SELECT DISTINCT 4, system_id, CASE WHEN starts_with(best_body, system || ' ') THEN substr(best_body, length(system) + 2) ELSE best_body END, NULL, NULL, NULL FROM system_exobio),
    held AS (SELECT system_id, body, min(number) AS held FROM feeds WHERE number IS NOT NULL GROUP BY ALL),
    merged AS (SELECT system_id, body, min(rank) AS source, coalesce(min(number), min(held), -1) AS number, max(sub_type) AS sub_type, max(temp) AS temp, count(DISTINCT rank) AS sources FROM feeds LEFT JOIN held USING (system_id, body) WHERE body IS NOT NULL GROUP BY ALL)"""


def _merged(spark: S, folder: str) -> DataFrame:
    """One row per system and body of four feeds, from the best of them, with numbers inherited and columns filled."""
    e = table(spark, folder, "system_exobio", "system_id", "system", "best_body")
    named = e.groupBy("system_id").agg(F.min("system").alias("system"))
    none = lambda kind: F.lit(None).cast(kind)
    b = bodies(spark, folder, "name", "sub_type", "surface_temp_k").join(named, F.col("system_id") == F.col("system_id64"))
    a = b.select(F.lit(1).alias("rank"), "system_id", expr.without_prefix("name", "system").alias("body"), F.col("body_id").alias("number"), "sub_type", F.col("surface_temp_k").alias("temp"))
    p = table(spark, folder, "body_poi", "system_id", "body", "source").join(named, "system_id", "left_semi")
    p = p.select(F.when(F.col("source") == "canonn", 2).otherwise(3).alias("rank"), "system_id", "body", none("long").alias("number"), none("string").alias("sub_type"), none("double").alias("temp"))
    x = e.select(F.lit(4).alias("rank"), "system_id", expr.without_prefix("best_body", "system").alias("body"), none("long").alias("number"), none("string").alias("sub_type"), none("double").alias("temp")).distinct()
    feeds = a.unionByName(p).unionByName(x).where("body IS NOT NULL")
    # the number that any feed holds for a body is inherited by all, so one aggregate does it
    return feeds.groupBy("system_id", "body").agg(
        F.min("rank").alias("source"), F.coalesce(F.min("number"), F.lit(-1)).alias("number"), F.max("sub_type").alias("sub_type"), F.max("temp").alias("temp"), F.count_distinct("rank").alias("sources")
    )


@query(f"WITH {_SOURCES} SELECT * FROM merged")
def merged_bodies(spark: S, folder: str) -> DataFrame:
    return _merged(spark, folder)


@query(f"""WITH {_SOURCES}, learnt AS (SELECT body, min(number) AS learnt FROM merged WHERE number >= 0 GROUP BY 1 HAVING count(DISTINCT number) = 1)
           SELECT system_id, body, learnt AS number FROM merged JOIN learnt USING (body) WHERE number = -1 AND NOT EXISTS (SELECT 1 FROM merged o WHERE o.system_id = merged.system_id AND o.number = learnt)""")
def upgraded_numbers(spark: S, folder: str) -> DataFrame:
    """Unknown numbers that all other systems agree on, unless another body of the system holds the number."""
    m = _merged(spark, folder)
    learnt = m.where("number >= 0").groupBy("body").agg(F.min("number").alias("number"), F.max("number").alias("most")).where("number = most").select("body", "number")
    asked = salted_join(m.where("number = -1").select("system_id", "body"), learnt, ["body"])
    return asked.join(m.where("number >= 0").select("system_id", "number"), ["system_id", "number"], "left_anti").select("system_id", "body", "number")


@query(f"""WITH {_BODY}, ranked AS (SELECT system_id64, body_id, name, row_number() OVER (PARTITION BY system_id64 ORDER BY main_star IS TRUE DESC, type = 'Star' DESC, dist_to_arrival_ls NULLS LAST, solar_masses IS NOT NULL DESC, body_id, name) AS r FROM body)
           SELECT system_id64, body_id, name FROM ranked WHERE r = 1""")
def primary_sweep(spark: S, folder: str) -> DataFrame:
    """Exactly one primary per system by ordered rules: the main star, a star, the nearest, with a mass, the lowest number."""
    b = bodies(spark, folder, "name", "main_star", "type", "dist_to_arrival_ls", "solar_masses")
    rules = [(~F.coalesce("main_star", F.lit(False))), F.col("type") != "Star", F.col("dist_to_arrival_ls").asc_nulls_last(), F.col("solar_masses").isNull(), F.col("body_id"), F.col("name")]
    return windows.pick_first(b, ["system_id64"], *rules).select("system_id64", "body_id", "name")


@query(f"""WITH {_BODY}, d AS (SELECT DISTINCT system_id64, body_id, regexp_extract(name, '{_AFTER}', 1) AS known FROM body WHERE regexp_matches(name, '{_AFTER}'))
           SELECT DISTINCT p.report_id, d.body_id FROM body_poi p JOIN d ON d.system_id64 = p.system_id AND d.known <> '' AND (p.body = d.known OR starts_with(p.body, d.known || ' '))
           QUALIFY row_number() OVER (PARTITION BY p.report_id ORDER BY length(d.known) DESC, d.body_id) = 1""")
def longest_body(spark: S, folder: str) -> DataFrame:
    """The known body whose designation is the longest beginning of the reported one, by whole words."""
    b = bodies(spark, folder, "name").withColumn("known", F.regexp_extract("name", _AFTER, 1)).where("known <> ''")
    known = b.select(F.concat_ws(" ", F.col("system_id64").cast("string"), "known").alias("start"), "body_id").distinct()
    p = table(spark, folder, "body_poi", "report_id", "system_id", "body").where("system_id IS NOT NULL").withColumn("text", F.concat_ws(" ", F.col("system_id").cast("string"), "body"))
    met = joins.by_word_prefix(p, "text", known, "start")
    return windows.pick_first(met, ["report_id"], F.desc(F.length("start")), F.asc("body_id")).select("report_id", "body_id")


# --- points of interest --------------------------------------------------------------------------------------------
@query("""WITH e AS (SELECT DISTINCT system_id, body, poi_id FROM body_poi WHERE system_id IS NOT NULL AND poi_id IS NOT NULL), rare AS (SELECT poi_id, count(DISTINCT system_id) AS systems FROM e GROUP BY 1)
          SELECT system_id, body, CASE WHEN body = '' THEN 'system' ELSE 'body' END AS level, min({'systems': systems, 'poi_id': poi_id}).poi_id AS poi_id FROM e JOIN rare USING (poi_id) GROUP BY system_id, body""")
def poi_winners(spark: S, folder: str) -> DataFrame:
    """Of several points at one place the one that the fewest systems have, then the lowest id; by system and by body."""
    e = table(spark, folder, "body_poi", "system_id", "body", "poi_id").dropna().distinct()
    rare = e.groupBy("poi_id").agg(F.count_distinct("system_id").alias("systems"))
    best = salted_join(e, rare, ["poi_id"]).groupBy("system_id", "body").agg(F.min(F.struct("systems", "poi_id")).alias("m"))
    return best.select("system_id", "body", F.when(F.col("body") == "", "system").otherwise("body").alias("level"), F.col("m.poi_id").alias("poi_id"))


@query("""WITH l AS (SELECT poi_id, count(DISTINCT system_id) AS systems, count(DISTINCT (system_id, body)) AS places FROM body_poi WHERE system_id IS NOT NULL GROUP BY 1), n AS (SELECT count(*) AS held FROM l)
          SELECT p.poi_id, CASE WHEN held > 0 THEN coalesce(systems, 0) END AS systems, CASE WHEN held > 0 THEN coalesce(places, 0) END AS places FROM poi p LEFT JOIN l USING (poi_id), n""")
def poi_links(spark: S, folder: str) -> DataFrame:
    """Systems and places of each point; null for all as long as there is no link at all."""
    links = table(spark, folder, "body_poi", "poi_id", "system_id", "body").where("system_id IS NOT NULL")
    held = links.groupBy("poi_id").agg(F.count_distinct("system_id").alias("systems"), agg.count_tuples("system_id", "body").alias("places"))
    any_link = held.agg((F.count(F.lit(1)) > 0).alias("any"))
    out = table(spark, folder, "poi", "poi_id").join(held, "poi_id", "left").crossJoin(F.broadcast(any_link))  # one row
    return out.select("poi_id", *[F.when(F.col("any"), F.coalesce(c, F.lit(0))).alias(c) for c in ("systems", "places")])


@query("""SELECT system_id, poi_id, bool_or(known) AS in_catalogue, bool_or(NOT known) AS reported FROM (SELECT system_id, poi_id, true AS known FROM system_known UNION ALL SELECT system_id, poi_id, false FROM body_poi)
          WHERE system_id IS NOT NULL AND poi_id IS NOT NULL GROUP BY ALL""")
def system_pois(spark: S, folder: str) -> DataFrame:
    """Both attributions of points to systems, once, with who says so."""
    both = table(spark, folder, "system_known", "system_id", "poi_id").withColumn("known", F.lit(True)).union(table(spark, folder, "body_poi", "system_id", "poi_id").withColumn("known", F.lit(False))).dropna()
    return both.groupBy("system_id", "poi_id").agg(F.bool_or("known").alias("in_catalogue"), F.bool_or(~F.col("known")).alias("reported"))


@query("""SELECT poi_id, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources, count(*) AS reports FROM body_poi WHERE poi_id IS NOT NULL AND poi_id NOT IN (SELECT poi_id FROM poi WHERE poi_id IS NOT NULL) GROUP BY 1""")
def uncurated_pois(spark: S, folder: str) -> DataFrame:
    """Points that the reports name and the dimension lacks, with their sources; counted before they meet the dimension."""
    n = table(spark, folder, "body_poi", "poi_id", "source").where("poi_id IS NOT NULL").groupBy("poi_id").agg(agg.listed("source").alias("sources"), F.count(F.lit(1)).alias("reports"))
    return n.join(table(spark, folder, "poi", "poi_id"), "poi_id", "left_anti")


# The order in which kinds of observations are looked for in a name.
_LADDER = [("mollusc", "mollusc"), ("plant", "reef|kelp|plant"), ("seed_pod", "pod|seed"), ("mineral", "shell|crystal|spire"), ("lagrange", "cloud|lagrange"), ("anomaly", "beacon|anomaly")]


@query(f"""SELECT kind, count(*) AS reports, count(DISTINCT system_id) AS systems FROM (
           SELECT system_id, CASE {" ".join(f"WHEN regexp_matches(lower(p.poi), '{r}') THEN '{k}'" for k, r in _LADDER)} ELSE 'other' END AS kind FROM body_poi b JOIN poi p USING (poi_id)
           UNION ALL SELECT system_id64, 'giant' FROM spansh_galaxy_body WHERE sub_type LIKE 'Gas giant%') GROUP BY 1""")
def observation_kinds(spark: S, folder: str) -> DataFrame:
    """Observations by the first kind of an ordered ladder that their name matches, with those of another feed."""
    name = F.lower("poi")
    kind = F.when(name.rlike(_LADDER[0][1]), _LADDER[0][0])
    for k, r in _LADDER[1:]:
        kind = kind.when(name.rlike(r), k)
    kinds = table(spark, folder, "poi", "poi_id", "poi").select("poi_id", kind.otherwise("other").alias("kind"))
    seen = table(spark, folder, "body_poi", "poi_id", "system_id").join(kinds, "poi_id").select("system_id", "kind")
    giants = table(spark, folder, "spansh_galaxy_body", "system_id64", "sub_type").where(F.col("sub_type").startswith("Gas giant")).select(F.col("system_id64").alias("system_id"), F.lit("giant").alias("kind"))
    return seen.unionByName(giants).groupBy("kind").agg(F.count(F.lit(1)).alias("reports"), F.count_distinct("system_id").alias("systems"))


@query("""WITH k AS (SELECT system_id, min(region_id) AS region_id FROM system_known WHERE region_id IS NOT NULL GROUP BY 1),
          s AS (SELECT region_id, trim(regexp_replace(lower(p.poi), '[^a-z]+', ' ', 'g')) AS label, CASE WHEN p.poi_class IN ('nsp', 'anomaly') THEN 'Phenomena' WHEN p.poi_class = 'ggg' THEN 'Giants' WHEN p.needs_landing THEN 'Sites' ELSE 'Stars' END AS category, reported_at, report_id, source
                FROM body_poi b JOIN poi p USING (poi_id) JOIN k USING (system_id))
          SELECT region_id, label, min(category) AS category, count(*) AS reports, arg_min(source, (reported_at, report_id)) AS first_source, min({'at': reported_at, 'id': report_id}).id AS first_report FROM s GROUP BY region_id, label""")
def first_sightings(spark: S, folder: str) -> DataFrame:
    """The earliest report of each label in each region, labels written plainly and brought under a category by rules."""
    k = table(spark, folder, "system_known", "system_id", "region_id").where("region_id IS NOT NULL").groupBy("system_id").agg(F.min("region_id").alias("region_id"))
    label = F.trim(F.regexp_replace(F.lower("poi"), "[^a-z]+", " "))
    category = F.when(F.col("poi_class").isin("nsp", "anomaly"), "Phenomena").when(F.col("poi_class") == "ggg", "Giants").when(F.col("needs_landing"), "Sites").otherwise("Stars")
    p = table(spark, folder, "poi", "poi_id", "poi", "poi_class", "needs_landing").select("poi_id", label.alias("label"), category.alias("category"))
    s = table(spark, folder, "body_poi", "report_id", "system_id", "poi_id", "source", "reported_at").join(p, "poi_id").join(k, "system_id")
    first = F.min(F.struct("reported_at", "report_id", "source")).alias("first")
    out = s.groupBy("region_id", "label").agg(F.min("category").alias("category"), F.count(F.lit(1)).alias("reports"), first)
    return out.select("region_id", "label", "category", "reports", F.col("first.source").alias("first_source"), F.col("first.report_id").alias("first_report"))


@query("""SELECT poi_id, list_contains(string_split(sources, '+'), 'canonn') AS by_canonn, list_contains(string_split(sources, '+'), 'edsm') AS by_edsm, len(string_split(sources, '+')) AS named, needs_landing AND removed_at IS NULL AS open
          FROM poi QUALIFY row_number() OVER (PARTITION BY poi_id ORDER BY first_seen DESC) = 1""")
def poi_flags(spark: S, folder: str) -> DataFrame:
    """Flags out of a packed list, of the latest row of each point."""
    p = windows.pick_first(table(spark, folder, "poi"), ["poi_id"], F.desc("first_seen"))
    held = F.split("sources", r"\+")
    return p.select("poi_id", F.array_contains(held, "canonn").alias("by_canonn"), F.array_contains(held, "edsm").alias("by_edsm"), F.when(F.col("sources").isNotNull(), F.size(held).cast("long")).alias("named"), (F.col("needs_landing") & F.col("removed_at").isNull()).alias("open"))


# --- biology -------------------------------------------------------------------------------------------------------
_STATUS = "CASE WHEN signal_biology > 0 AND genuses IS NOT NULL THEN 'mapped' WHEN signal_biology > 0 THEN 'unmapped' WHEN left(update_time, 10) < '2021-05-19' THEN 'early' WHEN is_landable THEN 'landable' ELSE 'unreported' END"


@query(f"""WITH {_BODY} SELECT status, band, count(*) AS bodies FROM (SELECT {_STATUS} AS status, least(greatest(floor(surface_temp_k / 20) * 20, 100), 440)::INTEGER AS band FROM body WHERE atmosphere_type LIKE 'Thin%') GROUP BY ALL""")
def body_status(spark: S, folder: str) -> DataFrame:
    """Bodies with a thin atmosphere by the first status of a ladder and by bands of 20 K."""
    b = bodies(spark, folder, "atmosphere_type", "signal_biology", "genuses", "update_time", "is_landable", "surface_temp_k").where(F.col("atmosphere_type").startswith("Thin"))
    bio = F.col("signal_biology") > 0
    status = F.when(bio & F.col("genuses").isNotNull(), "mapped").when(bio, "unmapped").when(F.substring("update_time", 1, 10) < "2021-05-19", "early").when(F.col("is_landable"), "landable").otherwise("unreported")
    return b.groupBy(status.alias("status"), expr.stepped("surface_temp_k", 20, 100, 440).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("bodies"))


@query(f"""WITH {biology._JSON}, b AS (SELECT record_id, min(sub_type) AS sub_type, min(least(greatest(floor(surface_temp_k / 20) * 20, 100), 440)::INTEGER) AS band FROM spansh_galaxy_body WHERE surface_temp_k IS NOT NULL GROUP BY 1),
           g AS (SELECT DISTINCT b.*, item AS genus FROM rows_ r JOIN b USING (record_id) WHERE nested_field = 'genuses' AND child_pos = -1 AND parent_pos >= 0 AND item <> ''),
           n AS (SELECT sub_type, CASE WHEN grouping(band) = 1 THEN '*' ELSE CAST(band AS VARCHAR) END AS band, genus, count(*) AS n FROM g GROUP BY GROUPING SETS ((sub_type, band, genus), (sub_type, genus)))
           SELECT *, round(n * 1e0 / sum(n) OVER (PARTITION BY sub_type, band), 6) AS share FROM n""")
def genus_odds(spark: S, folder: str) -> DataFrame:
    """The share of each genus by kind of body and band, and by kind alone, from the flattened texts."""
    b = table(spark, folder, "spansh_galaxy_body", "record_id", "sub_type", "surface_temp_k").where("surface_temp_k IS NOT NULL")
    b = b.groupBy("record_id").agg(F.min("sub_type").alias("sub_type"), F.min(expr.stepped("surface_temp_k", 20, 100, 440)).cast("int").cast("string").alias("band"))
    g = biology.found(spark, folder).where("nested_field = 'genuses' AND child_pos = -1 AND parent_pos >= 0 AND item <> ''").select("record_id", F.col("item").alias("genus")).distinct()
    n = agg.wildcard_rollup(g.join(b, "record_id"), ["sub_type", "genus"], "band", F.count(F.lit(1)).alias("n"))
    return n.select("sub_type", "band", "genus", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy("sub_type", "band")), 6).alias("share"))


@query("""SELECT split_part(best_species, ' ', 1) AS genus, count(DISTINCT system_id) AS systems, count(DISTINCT best_species) AS species FROM system_exobio WHERE best_species IS NOT NULL GROUP BY 1""")
def species_by_genus(spark: S, folder: str) -> DataFrame:
    e = table(spark, folder, "system_exobio", "system_id", "best_species").where("best_species IS NOT NULL")
    return e.groupBy(F.split_part("best_species", F.lit(" "), F.lit(1)).alias("genus")).agg(F.count_distinct("system_id").alias("systems"), F.count_distinct("best_species").alias("species"))


@query(f"""WITH {_BODY}, c AS (SELECT system_id64, body_id, name, sub_type, least(greatest(floor(surface_temp_k / 20) * 20, 100), 440)::INTEGER AS band, signal_biology > 0 AS bio FROM body WHERE is_landable AND surface_temp_k IS NOT NULL),
           own AS (SELECT sub_type, band, count(*) AS n, (count(*) FILTER (bio) + 1) / (count(*) + 2e0) AS p FROM c GROUP BY ALL), wide AS (SELECT sub_type, (count(*) FILTER (bio) + 1) / (count(*) + 2e0) AS p FROM c GROUP BY 1),
           o AS (SELECT c.*, CASE WHEN own.n >= 20 THEN own.p ELSE wide.p END AS p FROM c JOIN own USING (sub_type, band) JOIN wide USING (sub_type))
           SELECT system_id64, count(*) AS candidates, round(sum(p), 6) AS expected, max({{'p': round(p, 12), 'name': name}}).name AS best_body FROM o GROUP BY 1 HAVING sum(p) >= 0.1""")
def system_odds(spark: S, folder: str) -> DataFrame:
    """What a system is expected to hold: each body by its own cell where that has enough support, else by its kind."""
    b = bodies(spark, folder, "name", "sub_type", "surface_temp_k", "is_landable", "signal_biology").where("is_landable AND surface_temp_k IS NOT NULL")
    b = b.select("system_id64", "name", "sub_type", expr.stepped("surface_temp_k", 20, 100, 440).cast("int").cast("string").alias("band"), (F.col("signal_biology") > 0).alias("bio"))
    cells = agg.wildcard_rollup(b, ["sub_type"], "band", F.count(F.lit(1)).alias("n"), F.count_if("bio").alias("k")).withColumn("p", expr.laplace("k", "n"))
    placed = joins.with_fallback(b, F.broadcast(cells), ["sub_type"], "band", ["p"], F.col("n") >= 20)  # kinds of bodies by 18 bands
    out = placed.groupBy("system_id64").agg(F.count(F.lit(1)).alias("candidates"), F.sum("p").alias("sum"), F.max(F.struct(F.round("p", 12).alias("p"), "name")).alias("best"))
    return out.where("sum >= 0.1").select("system_id64", "candidates", F.round("sum", 6).alias("expected"), F.col("best.name").alias("best_body"))


# --- predictions ---------------------------------------------------------------------------------------------------
_PLACE = "place AS (SELECT system_id, min(x) AS x, min(y) AS y, min(z) AS z, min(mass_code) AS mass, min(region_id) AS region_id, min(body_count) AS body_count FROM system_known WHERE removed_at IS NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY 1)"
_FLAG = f"""{_PLACE}, {_BODY}, label AS (SELECT system_id64 AS system_id, bool_or(spectral_class = 'N') AS neutron, bool_or(spectral_class IN ('A', 'F')) AS bright, count(*) FILTER (type = 'Star') AS stars, count(*) AS scans FROM body GROUP BY 1),
    seen AS (SELECT p.*, coalesce(l.neutron, false) AS neutron, coalesce(l.bright, false) AS bright, coalesce(l.stars, 0) AS stars, coalesce(l.scans, 0) AS scans, CASE WHEN sqrt(x * x + z * z) < 10000 THEN '0-10k' WHEN sqrt(x * x + z * z) < 20000 THEN '10-20k' WHEN sqrt(x * x + z * z) < 30000 THEN '20-30k' ELSE '30k+' END AS band
             FROM place p LEFT JOIN label l USING (system_id))"""


def _seen(spark: S, folder: str) -> DataFrame:
    """Located systems with what their scans hold, and the band of their distance from the axis."""
    k = table(spark, folder, "system_known", "system_id", *XYZ, "mass_code", "region_id", "body_count", "removed_at").where("removed_at IS NULL").na.drop(subset=XYZ)
    k = k.groupBy("system_id").agg(*[F.min(c).alias(c) for c in XYZ], F.min("mass_code").alias("mass"), F.min("region_id").alias("region_id"), F.min("body_count").alias("body_count"))
    b = bodies(spark, folder, "type", "spectral_class").groupBy(F.col("system_id64").alias("system_id")).agg(
        F.bool_or(F.col("spectral_class") == "N").alias("neutron"), F.bool_or(F.col("spectral_class").isin("A", "F")).alias("bright"), F.count_if(F.col("type") == "Star").alias("stars"), F.count(F.lit(1)).alias("scans")
    )
    out = k.join(b, "system_id", "left").na.fill(False, ["neutron", "bright"]).na.fill(0, ["stars", "scans"])
    r = F.sqrt(F.col("x") * F.col("x") + F.col("z") * F.col("z"))
    return out.withColumn("band", expr.banded(r, [10000, 20000, 30000], ["0-10k", "10-20k", "20-30k", "30k+"]))


@query(f"WITH {_FLAG} SELECT system_id, mass, band, neutron, bright, stars, scans, scans > 0 AND stars > 0 AS scanned FROM seen")
def system_labels(spark: S, folder: str) -> DataFrame:
    """Flags of what a system holds, with how far it was scanned."""
    return _seen(spark, folder).select("system_id", "mass", "band", "neutron", "bright", "stars", "scans", ((F.col("scans") > 0) & (F.col("stars") > 0)).alias("scanned"))


_RATE = f"""{_FLAG}, tiers AS (SELECT mass, band, t.tier, count(*) AS n, count(*) FILTER (bright) AS k FROM seen, (VALUES (1), (2), (3)) t(tier) WHERE stars > 0 AND scans >= CASE t.tier WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END GROUP BY ALL),
    chosen AS (SELECT mass, band, arg_min(struct_pack(tier := tier, n := n, k := k), (CASE WHEN n >= 50 THEN tier ELSE 10 - n * 1e-9 END, tier)) AS c FROM tiers GROUP BY ALL), rate AS (SELECT mass, band, c.tier AS tier, c.n AS n, round((c.k + 1) / (c.n + 2e0), 6) AS rate FROM chosen)"""


def _rates(seen: DataFrame) -> DataFrame:
    """Rates by mass code and band from the best-scanned systems that are enough, else from the tier with the most."""
    need = F.array(*[F.struct(F.lit(tier).alias("tier"), F.lit(least).alias("least")) for tier, least in ((1, 4), (2, 2), (3, 1))])
    t = seen.where("stars > 0").select("mass", "band", "bright", F.inline(F.filter(need, lambda x: F.col("scans") >= x["least"])))
    t = t.groupBy("mass", "band", "tier").agg(F.count(F.lit(1)).alias("n"), F.count_if("bright").alias("k"))
    order = F.when(F.col("n") >= 50, F.col("tier").cast("double")).otherwise(10 - F.col("n") * 1e-9)
    best = t.groupBy("mass", "band").agg(F.min_by(F.struct("tier", "n", "k"), F.struct(order, "tier")).alias("c"))
    return best.select("mass", "band", F.col("c.tier").alias("tier"), F.col("c.n").alias("n"), F.round(expr.laplace("c.k", "c.n"), 6).alias("rate"))


@query(f"WITH {_RATE} SELECT * FROM rate")
def rate_tiers(spark: S, folder: str) -> DataFrame:
    return _rates(_seen(spark, folder))


_FACTOR = f"""{_RATE}, judged AS (SELECT s.region_id, rate, bright, stars > 0 AS any_star, scans >= coalesce(body_count, 1) AS whole FROM seen s JOIN rate r ON r.mass IS NOT DISTINCT FROM s.mass AND r.band = s.band),
    factor AS (SELECT region_id, least(round((count(*) FILTER (bright AND any_star) + 20) / (sum(rate) FILTER (any_star) + 20), 4), 1) AS loose, least(round((count(*) FILTER (bright AND whole) + 20) / (coalesce(sum(rate) FILTER (whole), 0) + 20), 4), 1) AS strict FROM judged GROUP BY 1)"""


def _factors(seen: DataFrame, rates: DataFrame) -> DataFrame:
    """Observed over expected by region, shrunk, by two definitions of a completed system."""
    r = rates.select(F.col("mass").alias("m"), F.col("band").alias("b"), "rate")
    j = seen.join(F.broadcast(r), F.col("mass").eqNullSafe(F.col("m")) & (F.col("band") == F.col("b")))  # nine mass codes by four bands
    loose, strict = F.col("stars") > 0, F.col("scans") >= F.coalesce("body_count", F.lit(1))
    ratio = lambda done: (F.count_if(F.col("bright") & done), F.coalesce(F.sum(F.when(done, F.col("rate"))), F.lit(0.0)))
    return j.groupBy("region_id").agg(expr.shrunk_ratio(*ratio(loose)).alias("loose"), expr.shrunk_ratio(*ratio(strict)).alias("strict"))


@query(f"WITH {_FACTOR} SELECT region_id, CASE WHEN loose IS NULL THEN round(1, 4) ELSE loose END AS loose, strict FROM factor")
def calibration(spark: S, folder: str) -> DataFrame:
    seen = _seen(spark, folder)
    return _factors(seen, _rates(seen))


_GUESS = """lowest AS (SELECT sector_id, cube_id, mass_code, coalesce(sub_cube_id, -1) AS sub, min(boxel_index) AS low, count(DISTINCT boxel_index) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM system_known WHERE cube_id IS NOT NULL AND boxel_index IS NOT NULL AND removed_at IS NULL GROUP BY ALL),
    rate0 AS (SELECT mass_code, (count(*) FILTER (low = 0) + 1) / (count(*) + 2e0) AS p, count(*) AS boxels FROM lowest GROUP BY 1), all0 AS (SELECT (count(*) FILTER (low = 0) + 1) / (count(*) + 2e0) AS p FROM lowest),
    guess AS (SELECT sector_id, cube_id, mass_code, sub, cube_id || ' ' || mass_code || CASE WHEN sub >= 0 THEN sub || '-' ELSE '' END || '0' AS name, round(CASE WHEN boxels >= 100 THEN r.p ELSE all0.p END, 6) AS p_exist, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM lowest JOIN rate0 r USING (mass_code), all0 WHERE low > 0)"""


def _guesses(spark: S, folder: str) -> DataFrame:
    """The first name of each boxel whose lowest known index isn't 0, with a smoothed rate of its mass code or of all."""
    keys = ["sector_id", "cube_id", "mass_code", "sub"]
    k = table(spark, folder, "system_known", "sector_id", "cube_id", "mass_code", "sub_cube_id", "boxel_index", *XYZ, "removed_at").where("cube_id IS NOT NULL AND boxel_index IS NOT NULL AND removed_at IS NULL")
    low = k.withColumn("sub", F.coalesce("sub_cube_id", F.lit(-1))).groupBy(*keys).agg(F.min("boxel_index").alias("low"), *[F.avg(c).alias(c) for c in XYZ])
    rates = agg.wildcard_rollup(low, [], "mass_code", F.count_if(F.col("low") == 0).alias("k"), F.count(F.lit(1)).alias("boxels")).withColumn("p", expr.laplace("k", "boxels"))
    placed = joins.with_fallback(low.where("low > 0").withColumn("one", F.lit(1)), F.broadcast(rates.withColumn("one", F.lit(1))), ["one"], "mass_code", ["p"], F.col("boxels") >= 100)  # one row per mass code
    name = F.concat("cube_id", F.lit(" "), "mass_code", F.when(F.col("sub") >= 0, F.concat(F.col("sub").cast("string"), F.lit("-"))).otherwise(""), F.lit("0"))
    return placed.select(*keys, name.alias("name"), F.round("p", 6).alias("p_exist"), *[F.round(c, 5).alias(c) for c in XYZ])


@query(f"WITH {_GUESS} SELECT sector_id, name, p_exist, x, y, z FROM guess")
def first_names(spark: S, folder: str) -> DataFrame:
    return _guesses(spark, folder).select("sector_id", "name", "p_exist", *XYZ)


_POOL = f"""{_FACTOR}, {_GUESS}, pool AS (SELECT CAST(system_id AS VARCHAR) AS target, mass, band, region_id, 1e0 AS p_exist FROM seen WHERE scans = 0
    UNION ALL SELECT g.sector_id || ' ' || g.name, mass_code, CASE WHEN sqrt(x * x + z * z) < 10000 THEN '0-10k' WHEN sqrt(x * x + z * z) < 20000 THEN '10-20k' WHEN sqrt(x * x + z * z) < 30000 THEN '20-30k' ELSE '30k+' END, NULL, p_exist FROM guess g
    WHERE x IS NOT NULL AND z IS NOT NULL AND NOT EXISTS (SELECT 1 FROM system_known k WHERE k.sector_id = g.sector_id AND k.system_in_sector = g.name))"""


def _pool(spark: S, folder: str, seen: DataFrame) -> DataFrame:
    """Known systems without a scan, and guessed ones whose names are not known."""
    known = seen.where("scans = 0").select(F.col("system_id").cast("string").alias("target"), "mass", "band", "region_id", F.lit(1.0).alias("p_exist"))
    names = table(spark, folder, "system_known", "sector_id", F.col("system_in_sector").alias("name"))
    g = _guesses(spark, folder).na.drop(subset=["x", "z"]).join(names, ["sector_id", "name"], "left_anti")
    r = F.sqrt(F.col("x") * F.col("x") + F.col("z") * F.col("z"))
    band = expr.banded(r, [10000, 20000, 30000], ["0-10k", "10-20k", "20-30k", "30k+"])
    return known.unionByName(g.select(F.concat_ws(" ", F.col("sector_id").cast("string"), "name").alias("target"), F.col("mass_code").alias("mass"), band.alias("band"), F.lit(None).cast("long").alias("region_id"), "p_exist"))


@query(f"WITH {_POOL} SELECT * FROM pool")
def candidate_pool(spark: S, folder: str) -> DataFrame:
    return _pool(spark, folder, _seen(spark, folder))


@query(f"""WITH {_POOL} SELECT target, round(least(coalesce(rate, 0) * coalesce(strict, 1), 1) * p_exist, 6) AS score FROM pool p LEFT JOIN rate r ON r.mass IS NOT DISTINCT FROM p.mass AND r.band = p.band LEFT JOIN factor f ON f.region_id = p.region_id""")
def predicted_systems(spark: S, folder: str) -> DataFrame:
    """The final score: rate by factor, one at most, by how likely the system is there at all."""
    seen = _seen(spark, folder)
    rates = _rates(seen)
    r = rates.select(F.col("mass").alias("m"), F.col("band").alias("b"), "rate")
    f = _factors(seen, rates).select("region_id", "strict")
    p = _pool(spark, folder, seen).join(F.broadcast(r), F.col("mass").eqNullSafe(F.col("m")) & (F.col("band") == F.col("b")), "left").join(F.broadcast(f), "region_id", "left")  # 36 rates, 42 regions
    return p.select("target", F.round(F.least(F.coalesce("rate", F.lit(0.0)) * F.coalesce("strict", F.lit(1.0)), F.lit(1.0)) * F.col("p_exist"), 6).alias("score"))


@query(f"""WITH {_RATE} SELECT band, count(*) AS systems, round(count(*) FILTER (neutron) / (count(*) * 1e0), 6) AS naive, round(count(*) FILTER (neutron AND stars > 0) / nullif(count(*) FILTER (stars > 0), 0)::DOUBLE, 6) AS debiased,
           round((count(*) FILTER (neutron) + 1) / (count(*) + 2e0), 6) AS floor FROM seen GROUP BY band""")
def rate_estimators(spark: S, folder: str) -> DataFrame:
    """Three estimates of a rare rate side by side: of all systems, of the scanned ones, and smoothed."""
    g = _seen(spark, folder).groupBy("band").agg(F.count(F.lit(1)).alias("systems"), F.count_if("neutron").alias("k"), F.count_if(F.col("neutron") & (F.col("stars") > 0)).alias("ks"), F.count_if(F.col("stars") > 0).alias("s"))
    return g.select("band", "systems", F.round(F.col("k") / F.col("systems"), 6).alias("naive"), F.round(F.try_divide(F.col("ks").cast("double"), F.col("s").cast("double")), 6).alias("debiased"), F.round(expr.laplace("k", "systems"), 6).alias("floor"))


QUERIES, SQL = query.queries, query.sql
