"""What a commander has seen and done, kept by upserts that change nothing when they are repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import agg, windows
from ..operators import merging
from .registry import Book
from .tables import table

query = Book()
S = SparkSession

_SEEN = """held AS (SELECT system, max(system_id) AS id, max(best_species) AS species, min(last_reported) AS first_seen FROM system_exobio WHERE candidate_bodies > 1 GROUP BY 1),
           new AS (SELECT system, max(system_id) AS id, max(best_body) AS body, max(last_reported) AS at FROM system_exobio WHERE candidate_bodies <= 2 GROUP BY 1)"""


def _seen(spark: S, folder: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, folder, "system_exobio", "system", "system_id", "best_species", "best_body", "last_reported", "candidate_bodies")
    held = e.where("candidate_bodies > 1").groupBy("system").agg(F.max("system_id").alias("id"), F.max("best_species").alias("species"), F.min("last_reported").alias("first_seen"))
    new = e.where("candidate_bodies <= 2").groupBy("system").agg(F.max("system_id").alias("id"), F.max("best_body").alias("body"), F.max("last_reported").alias("at"))
    return held, new


@query(f"WITH {_SEEN} SELECT coalesce(h.system, n.system) AS system, coalesce(n.id, h.id) AS id, h.species, strftime(coalesce(h.first_seen, n.at), '%Y-%m-%d %H:%M:%S') AS first_seen, h.system IS NULL AS is_new FROM held h FULL JOIN new n ON h.system = n.system")
def record_seen(spark: S, folder: str) -> DataFrame:
    """New values over old ones, missing names inserted, the first time kept; new names are marked."""
    held, new = _seen(spark, folder)
    m = merging.merge(held, new.select("system", "id", F.col("at").alias("first_seen")), ["system"], {"id": merging.NEWEST, "first_seen": merging.KEEP})
    return m.select("system", "id", "species", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), (F.col("change") == "inserted").alias("is_new"))


@query("""WITH v AS (SELECT system_id, min(reported_at) AS first_at, max(reported_at) AS last_at, count(DISTINCT report_id) AS visits FROM body_poi WHERE system_id IS NOT NULL GROUP BY 1)
          SELECT system_id, strftime(first_at, '%Y-%m-%d') AS first_day, strftime(last_at, '%Y-%m-%d') AS last_day, visits FROM v""")
def record_arrival(spark: S, folder: str) -> DataFrame:
    """Inserted once, then only the last time moves: as one fold over all arrivals."""
    b = table(spark, folder, "body_poi", "system_id", "report_id", "reported_at").where("system_id IS NOT NULL")
    v = b.groupBy("system_id").agg(F.min("reported_at").alias("a"), F.max("reported_at").alias("z"), F.count_distinct("report_id").alias("visits"))
    return v.select("system_id", F.date_format("a", "yyyy-MM-dd").alias("first_day"), F.date_format("z", "yyyy-MM-dd").alias("last_day"), "visits")


@query("""SELECT system_id64, array_to_string(list_sort(list_distinct(list(sub_type))), '|') AS scanned, bool_or(signal_biology > 0) AS found_bio, bool_or(coalesce(is_landable, false)) AS found_land, count(DISTINCT body_id) >= 5 AS complete
          FROM spansh_galaxy_body GROUP BY 1""")
def record_outcome(spark: S, folder: str) -> DataFrame:
    """Distinct kinds that were scanned, flags OR-ed in, and whether the system is complete."""
    b = table(spark, folder, "spansh_galaxy_body", "system_id64", "sub_type", "signal_biology", "is_landable", "body_id").groupBy("system_id64")
    return b.agg(agg.listed("sub_type", "|").alias("scanned"), F.bool_or(F.col("signal_biology") > 0).alias("found_bio"), F.bool_or(F.coalesce("is_landable", F.lit(False))).alias("found_land"), (F.count_distinct("body_id") >= 5).alias("complete"))


@query("""WITH k AS (SELECT DISTINCT system_id FROM system_known WHERE removed_at IS NULL), p AS (SELECT DISTINCT system_id FROM body_poi WHERE system_id IS NOT NULL), s AS (SELECT DISTINCT system_id FROM system_exobio)
          SELECT s.system_id, CASE WHEN k.system_id IS NOT NULL THEN true WHEN p.system_id IS NOT NULL THEN false END AS is_known FROM s LEFT JOIN k USING (system_id) LEFT JOIN p ON p.system_id = s.system_id""")
def rederive_known(spark: S, folder: str) -> DataFrame:
    """A flag of three states, derived anew: known, reported but not known, not checked."""
    one = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    s = table(spark, folder, "system_exobio", "system_id").distinct()
    s = s.join(one(table(spark, folder, "system_known", "system_id", "removed_at").where("removed_at IS NULL").select("system_id"), "k"), "system_id", "left")
    s = s.join(one(table(spark, folder, "body_poi", "system_id").where("system_id IS NOT NULL"), "p"), "system_id", "left")
    return s.select("system_id", F.when(F.col("k"), True).when(F.col("p"), False).alias("is_known"))


@query("""WITH s AS (SELECT entry_id, system_id, loaded_at FROM system_catalog WHERE system_id IS NOT NULL) SELECT system_id, entry_id FROM s QUALIFY row_number() OVER (PARTITION BY system_id ORDER BY loaded_at DESC, entry_id DESC) = 1""")
def reassert_alias(spark: S, folder: str) -> DataFrame:
    """The latest assertion for each key replaces those before."""
    c = table(spark, folder, "system_catalog", "system_id", "entry_id", "loaded_at").where("system_id IS NOT NULL")
    return windows.pick_first(c, ["system_id"], F.desc("loaded_at"), F.desc("entry_id")).select("system_id", "entry_id")


@query("""WITH t AS (SELECT poi_id, poi FROM poi WHERE poi_class <> 'gec'), s AS (SELECT poi_id, poi FROM poi WHERE needs_landing) SELECT * FROM t UNION ALL SELECT * FROM s WHERE poi_id NOT IN (SELECT poi_id FROM t)""")
def mark_once(spark: S, folder: str) -> DataFrame:
    """Insert what is not there yet."""
    p = table(spark, folder, "poi", "poi_id", "poi", "poi_class", "needs_landing")
    return merging.insert_new(p.where("poi_class <> 'gec'").select("poi_id", "poi"), p.where("needs_landing").select("poi_id", "poi"), ["poi_id"])


@query("""SELECT poi_id, poi FROM poi WHERE poi_id IN (SELECT poi_id FROM body_poi)""")
def delete_stale(spark: S, folder: str) -> DataFrame:
    """Rows whose key the source no longer has are deleted."""
    return merging.delete_stale(table(spark, folder, "poi", "poi_id", "poi"), table(spark, folder, "body_poi", "poi_id").where("poi_id IS NOT NULL").distinct(), ["poi_id"])


@query("""WITH n AS (SELECT poi_id, min(source) AS source FROM body_poi WHERE poi_id IS NOT NULL GROUP BY 1) SELECT p.poi_id, coalesce(p.sources, n.source) AS sources FROM poi p LEFT JOIN n USING (poi_id)""")
def fill_nulls(spark: S, folder: str) -> DataFrame:
    """An update from a subquery, of nulls only."""
    n = table(spark, folder, "body_poi", "poi_id", "source").where("poi_id IS NOT NULL").groupBy("poi_id").agg(F.min("source").alias("sources"))
    return merging.update_from(table(spark, folder, "poi", "poi_id", "sources"), n, ["poi_id"], ["sources"], only_null=True)


@query("""SELECT coalesce(p.poi_family, 'none') AS family, strftime(b.reported_at, '%Y-%m-%d') AS day, count(*) AS n FROM body_poi b LEFT JOIN poi p USING (poi_id) GROUP BY ALL""")
def per_day_per_kind(spark: S, folder: str) -> DataFrame:
    b = table(spark, folder, "body_poi", "poi_id", "reported_at").groupBy("poi_id", F.date_format("reported_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    p = table(spark, folder, "poi", "poi_id", "poi_family")
    return b.join(p, "poi_id", "left").groupBy(F.coalesce("poi_family", F.lit("none")).alias("family"), "day").agg(F.sum("n").alias("n"))


@query("""SELECT 'entry without system' AS what, count(*) AS n FROM system_catalog c WHERE system_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM system_known k WHERE k.system_id = c.system_id)
          UNION ALL SELECT 'report without poi', count(*) FROM body_poi b WHERE poi_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM poi p WHERE p.poi_id = b.poi_id)""")
def orphan_counts(spark: S, folder: str) -> DataFrame:
    a = merging.orphans(table(spark, folder, "system_catalog", "system_id"), "system_id", table(spark, folder, "system_known", "system_id"), "system_id")
    b = merging.orphans(table(spark, folder, "body_poi", "poi_id"), "poi_id", table(spark, folder, "poi", "poi_id"), "poi_id")
    n = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return n(a, "entry without system").unionByName(n(b, "report without poi"))


QUERIES, SQL = query.queries, query.sql
