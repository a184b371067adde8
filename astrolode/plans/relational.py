"""Projections, predicates, joins, aggregates, windows, top-k and set operations over the star schema."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import agg, expr, windows
from ..operators import joins
from ..operators.skew import in_order
from ..storage import Scratch, numbered
from .registry import Book
from .tables import table

query = Book()
S = SparkSession


# --- flagship ------------------------------------------------------------------------------------------------------
@query("""
    WITH l AS (SELECT r.r_name, n.n_name, l.l_extendedprice * (1 - l.l_discount) AS revenue, l.l_returnflag, o.o_orderkey
               FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
               JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
    g AS (SELECT r_name, n_name, round(sum(revenue), 2) AS revenue, count(*) FILTER (l_returnflag = 'R') AS returned, count(DISTINCT o_orderkey) AS orders FROM l GROUP BY ALL)
    SELECT *, round(revenue / sum(revenue) OVER (PARTITION BY r_name), 6) AS region_share FROM g""")
def expected_by_region(spark: S, folder: str) -> DataFrame:
    """Sums, filtered counts and shares by region and nation; the small dimensions are joined after aggregation by key."""
    l = table(spark, folder, "lineitem", "l_orderkey", "l_extendedprice", "l_discount", "l_returnflag")  # noqa: E741
    per_order = l.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey")
    per_customer = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("revenue").alias("revenue"), F.sum("returned").alias("returned"), F.count(F.lit(1)).alias("orders"))
    places = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, folder, "customer", "c_custkey", "c_nationkey").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    out = per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name", "n_name")
    out = out.agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.sum("returned").alias("returned"), F.sum("orders").alias("orders"))
    return out.withColumn("region_share", F.round(windows.share("revenue", "r_name"), 6))


# --- projections and predicates ------------------------------------------------------------------------------------
@query("SELECT * EXCLUDE (l_tax) REPLACE (round(l_extendedprice * (1 - l_discount), 4) AS l_extendedprice) FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag IN ('A', 'R')")
def replace_exclude(spark: S, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem").where(F.col("l_quantity").between(10, 12) & F.col("l_returnflag").isin("A", "R"))  # noqa: E741
    return l.withColumn("l_extendedprice", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)).drop("l_tax")


@query("""SELECT record_id, main_star IS TRUE AS is_main, main_star IS NOT TRUE AS not_main, is_landable IS NOT FALSE AS maybe_landable,
          terraforming_state IS DISTINCT FROM volcanism_type AS differs FROM spansh_galaxy_body""")
def three_valued(spark: S, folder: str) -> DataFrame:
    b = table(spark, folder, "spansh_galaxy_body", "record_id", "main_star", "is_landable", "terraforming_state", "volcanism_type")
    true, false = F.lit(True), F.lit(False)
    return b.select(
        "record_id", F.col("main_star").eqNullSafe(true).alias("is_main"), (~F.col("main_star").eqNullSafe(true)).alias("not_main"),
        (~F.col("is_landable").eqNullSafe(false)).alias("maybe_landable"), (~F.col("terraforming_state").eqNullSafe(F.col("volcanism_type"))).alias("differs"),
    )


@query("SELECT poi_id, poi FROM poi WHERE poi LIKE '%el%' OR poi ILIKE 'LANTERN%' OR regexp_matches(poi, '(^|\\s)Pale\\s')")
def text_predicates(spark: S, folder: str) -> DataFrame:
    p = table(spark, folder, "poi", "poi_id", "poi")
    return p.where(F.col("poi").like("%el%") | F.col("poi").ilike("LANTERN%") | F.col("poi").rlike(r"(^|\s)Pale\s"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state,
          CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 150000 THEN 'middle' ELSE 'large' END AS size_band FROM orders""")
def simple_and_searched_case(spark: S, folder: str) -> DataFrame:
    o = table(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open").otherwise("other")
    return o.select("o_orderkey", state.alias("state"), expr.banded("o_totalprice", [50000, 150000], ["small", "middle", "large"]).alias("size_band"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE ('BUILDING' IS NULL OR c_mktsegment = 'BUILDING') AND (NULL IS NULL OR c_nationkey = NULL)")
def optional_parameters(spark: S, folder: str) -> DataFrame:
    """Parameters that filter only where they are given, by named parameters of spark.sql."""
    table(spark, folder, "customer").createOrReplaceTempView("__customer")
    text = "SELECT c_custkey, c_acctbal FROM __customer WHERE (:segment IS NULL OR c_mktsegment = :segment) AND (:nation IS NULL OR c_nationkey = :nation)"
    return spark.sql(text, args={"segment": "BUILDING", "nation": None})


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT unnest(string_split('Brand#11' || chr(31) || 'Brand#23', chr(31))))")
def packed_list_parameter(spark: S, folder: str) -> DataFrame:
    wanted = spark.createDataFrame([("Brand#11\x1fBrand#23",)], "packed string").select(F.explode(F.split("packed", "\x1f")).alias("p_brand"))
    return table(spark, folder, "part", "p_partkey", "p_brand").join(F.broadcast(wanted), "p_brand", "left_semi").select("p_partkey", "p_brand")


# --- joins ---------------------------------------------------------------------------------------------------------
@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def anti_join(spark: S, folder: str) -> DataFrame:
    """Customers without an urgent order."""
    urgent = table(spark, folder, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'")
    return table(spark, folder, "customer", "c_custkey").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT s_suppkey, s_name FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_returnflag = 'R')")
def semi_join(spark: S, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem", "l_suppkey", "l_returnflag").where("l_returnflag = 'R'")  # noqa: E741
    return table(spark, folder, "supplier", "s_suppkey", "s_name").join(l, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi")


@query("SELECT record_id FROM spansh_galaxy_body WHERE body_id NOT IN (SELECT primary_star_body_id FROM system_known WHERE primary_star_body_id IS NOT NULL)")
def not_in_subquery(spark: S, folder: str) -> DataFrame:
    known = table(spark, folder, "system_known", "primary_star_body_id").where("primary_star_body_id IS NOT NULL").distinct()
    return table(spark, folder, "spansh_galaxy_body", "record_id", "body_id").join(known, F.col("body_id") == F.col("primary_star_body_id").cast("long"), "left_anti").select("record_id")


@query("""SELECT DISTINCT system_id, best_species FROM system_exobio WHERE best_species NOT IN (SELECT best_species FROM system_exobio WHERE candidate_bodies > 8 AND best_species IS NOT NULL)
          UNION ALL SELECT -1, best_species FROM system_exobio WHERE best_species NOT IN (SELECT best_species FROM system_exobio WHERE candidate_bodies > 8)""")
def not_in_null_aware(spark: S, folder: str) -> DataFrame:
    """NOT IN with its nulls: a null on the left is never outside of a list, and one null in the list leaves nothing."""
    e = table(spark, folder, "system_exobio", "system_id", "best_species", "candidate_bodies")
    many = e.where("candidate_bodies > 8").select(F.col("best_species").alias("other"))
    out = joins.not_in(e.select("system_id", "best_species").distinct(), "best_species", many.where("other IS NOT NULL"), "other")
    return out.unionByName(joins.not_in(e.select(F.lit(-1).cast("long").alias("system_id"), "best_species"), "best_species", many, "other"))


@query("""SELECT a.sector_id, a.cube_id, a.mass_code, a.sub_cube_id, count(*) AS pairs FROM (SELECT DISTINCT sector_id, cube_id, mass_code, sub_cube_id FROM system_known WHERE run_id = 1) a
          JOIN (SELECT sector_id, cube_id, mass_code, sub_cube_id FROM system_known WHERE run_id = 2) b
          ON a.sector_id = b.sector_id AND a.cube_id IS NOT DISTINCT FROM b.cube_id AND a.mass_code IS NOT DISTINCT FROM b.mass_code AND a.sub_cube_id IS NOT DISTINCT FROM b.sub_cube_id GROUP BY ALL""")
def null_safe_join(spark: S, folder: str) -> DataFrame:
    """A composite key with nulls that match; the second side is counted per key before it moves."""
    keys = ["sector_id", "cube_id", "mass_code", "sub_cube_id"]
    k = table(spark, folder, "system_known", *keys, "run_id")
    a = k.where("run_id = 1").select(*keys).distinct()
    b = k.where("run_id = 2").groupBy(*[F.col(c).alias(f"b_{c}") for c in keys]).agg(F.count(F.lit(1)).alias("pairs"))
    on = F.col("sector_id") == F.col("b_sector_id")
    for c in keys[1:]:
        on = on & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    return a.join(b, on).select(*keys, "pairs")


@query("""SELECT DISTINCT k.entry_id, a.name FROM system_catalog k JOIN (SELECT system_a AS name FROM system_catalog_alias UNION SELECT system_b FROM system_catalog_alias) a
          ON a.name = k.system OR a.name = k.type || ' ' || k.designation OR a.name = k.designation""")
def or_join(spark: S, folder: str) -> DataFrame:
    """Entries with each name of the aliases that one of three writings equals."""
    names = table(spark, folder, "system_catalog_alias", "system_a", "system_b").select(F.explode(F.array("system_a", "system_b")).alias("name")).distinct()
    k = table(spark, folder, "system_catalog", "entry_id", "system", "type", "designation")
    writings = [(F.col("system"), "name"), (F.concat("type", F.lit(" "), "designation"), "name"), (F.col("designation"), "name")]
    return joins.any_of_keys(k, names, writings, row=["entry_id", "name"]).select("entry_id", "name")


@query("SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND o_orderpriority = '1-URGENT' AND l_returnflag = 'R'")
def left_join_with_condition(spark: S, folder: str) -> DataFrame:
    """The condition on the left side belongs to the join: rows that fail it stay, without a partner."""
    l = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").where("l_returnflag = 'R'")  # noqa: E741
    o = table(spark, folder, "orders", "o_orderkey", "o_orderpriority")
    return o.join(l, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("o_orderpriority") == "1-URGENT"), "left").select("o_orderkey", "l_linenumber")


@query("""SELECT p_partkey, b.label FROM part JOIN (VALUES (0, 'tiny'), (1, 'small'), (2, 'middle'), (3, 'large')) b(band, label)
          ON b.band = CASE WHEN p_size < 5 THEN 0 WHEN p_size < 15 THEN 1 WHEN p_size < 35 THEN 2 ELSE 3 END""")
def computed_key_join(spark: S, folder: str) -> DataFrame:
    labels = spark.createDataFrame([(0, "tiny"), (1, "small"), (2, "middle"), (3, "large")], "band int, label string")
    p = table(spark, folder, "part", "p_partkey", "p_size").withColumn("band", F.when(F.col("p_size") < 5, 0).when(F.col("p_size") < 15, 1).when(F.col("p_size") < 35, 2).otherwise(3))
    return p.join(F.broadcast(labels), "band").select("p_partkey", "label")


@query("SELECT DISTINCT b.record_id, b.name, s.system FROM spansh_galaxy_body b JOIN (SELECT DISTINCT system FROM system_exobio) s ON b.name = s.system OR starts_with(b.name, s.system || ' ')")
def prefix_join(spark: S, folder: str) -> DataFrame:
    """Bodies whose names begin with the name of a known system."""
    b = table(spark, folder, "spansh_galaxy_body", "record_id", "name").distinct()
    return joins.by_word_prefix(b, "name", table(spark, folder, "system_exobio", "system").distinct(), "system")


@query("SELECT p_partkey, t.kind FROM part JOIN (SELECT DISTINCT split_part(p_name, ' ', 2) AS kind FROM part) t ON t.kind <> '' AND ends_with(p_name, ' ' || t.kind)")
def suffix_join(spark: S, folder: str) -> DataFrame:
    """Parts whose names end with one of the kinds, a whole word."""
    p = table(spark, folder, "part", "p_partkey", "p_name")
    kinds = p.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("kind")).where("kind <> ''").distinct()
    return joins.by_word_prefix(p, "p_name", kinds, "kind", suffix=True).where("p_name <> kind").select("p_partkey", "kind")


@query("""WITH runs AS (SELECT o_custkey % 50 AS z, CAST(row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 AS BIGINT) * 40 AS x_start, CAST(o_orderkey % 60 AS BIGINT) AS len, o_orderkey FROM orders),
          points AS (SELECT l_partkey % 50 AS z, l_orderkey % 5000 AS x, l_orderkey, l_linenumber FROM lineitem)
          SELECT l_orderkey, l_linenumber, o_orderkey FROM points p JOIN runs r ON p.z = r.z AND p.x BETWEEN r.x_start AND r.x_start + r.len - 1""")
def point_in_run(spark: S, folder: str) -> DataFrame:
    """Points in runs of a raster row, as equal cells."""
    o = table(spark, folder, "orders", "o_orderkey", "o_custkey").withColumn("z", F.col("o_custkey") % 50)
    runs = o.select("z", ((F.row_number().over(W.partitionBy("z").orderBy("o_orderkey")) - 1).cast("long") * 40).alias("x_start"), (F.col("o_orderkey") % 60).alias("len"), "o_orderkey")
    points = table(spark, folder, "lineitem", "l_partkey", "l_orderkey", "l_linenumber").select((F.col("l_partkey") % 50).alias("z"), (F.col("l_orderkey") % 5000).alias("x"), "l_orderkey", "l_linenumber")
    return joins.in_run(points, runs, row="z", at="x", start="x_start", length="len").select("l_orderkey", "l_linenumber", "o_orderkey")


@query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < 500""")
def band_join(spark: S, folder: str) -> DataFrame:
    """A band on a number as equal cells of its width, the neighbours' cells included."""
    s = table(spark, folder, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    a = s.select(F.col("s_suppkey").alias("a"), "s_nationkey", F.col("s_acctbal").alias("x"), F.floor(F.col("s_acctbal") / 500).alias("cell"))
    b = s.select(F.col("s_suppkey").alias("b"), "s_nationkey", F.col("s_acctbal").alias("y"), F.explode(F.sequence(F.floor(F.col("s_acctbal") / 500) - 1, F.floor(F.col("s_acctbal") / 500) + 1)).alias("cell"))
    return a.join(b, ["s_nationkey", "cell"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("x") - F.col("y")) < 500)).select("a", "b")


@query("""SELECT n.n_name, g.i FROM nation n CROSS JOIN range(0, 9) g(i)""")
def grid_cross_join(spark: S, folder: str) -> DataFrame:
    """A dimension with a template of nine rows."""
    return table(spark, folder, "nation", "n_name").crossJoin(F.broadcast(spark.range(9).withColumnRenamed("id", "i")))


@query("SELECT o_orderkey, k FROM (SELECT o_orderkey, CAST(o_orderkey % 4 AS BIGINT) AS len FROM orders) o, range(0, 4) t(k) WHERE len - k >= 1")
def lateral_series(spark: S, folder: str) -> DataFrame:
    """A series per row; an empty range gives no row, although a descending sequence would."""
    o = table(spark, folder, "orders", "o_orderkey").withColumn("len", F.col("o_orderkey") % 4).where("len >= 1")
    return o.select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(3), F.col("len") - 1).cast("long"))).alias("k"))


@query("""SELECT c.callsign, u.id AS system_id FROM carrier_position c LEFT JOIN (SELECT system, min(system_id) AS id FROM system_exobio GROUP BY system HAVING count(DISTINCT system_id) = 1) u USING (system)""")
def unique_name_join(spark: S, folder: str) -> DataFrame:
    c = table(spark, folder, "carrier_position", "callsign", "system")
    return joins.by_unique_name(c, table(spark, folder, "system_exobio", "system", "system_id"), "system", "system_id").select("callsign", "system_id")


@query("""WITH o AS (SELECT o_custkey, o_orderkey FROM orders) SELECT * FROM o QUALIFY count(*) OVER (PARTITION BY o_custkey) = 1""")
def only_single_orders(spark: S, folder: str) -> DataFrame:
    return windows.only_unique(table(spark, folder, "orders", "o_custkey", "o_orderkey"), ["o_custkey"])


# --- aggregation ---------------------------------------------------------------------------------------------------
@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS discounted,
          min(l_tax) AS least_tax, max(l_tax) AS most_tax, bool_or(l_quantity > 49) AS any_big, bool_and(l_quantity > 0) AS all_some FROM lineitem GROUP BY 1, 2""")
def filtered_aggregates(spark: S, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"),
        F.min("l_tax").alias("least_tax"), F.max("l_tax").alias("most_tax"), F.bool_or(F.col("l_quantity") > 49).alias("any_big"), F.bool_and(F.col("l_quantity") > 0).alias("all_some"),
    )


@query("""SELECT c_mktsegment, coalesce(CASE WHEN grouping(o_orderpriority) = 1 THEN '*' END, o_orderpriority) AS o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((c_mktsegment, o_orderpriority), (c_mktsegment))""")
def wildcard_rollup(spark: S, folder: str) -> DataFrame:
    o = table(spark, folder, "orders", "o_custkey", "o_orderpriority", "o_totalprice").join(table(spark, folder, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return agg.wildcard_rollup(o, ["c_mktsegment"], "o_orderpriority", F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT sector_id, count(DISTINCT (cube_id, mass_code)) AS boxels, count(DISTINCT mass_code) AS codes FROM system_known GROUP BY sector_id")
def distinct_tuples(spark: S, folder: str) -> DataFrame:
    return table(spark, folder, "system_known", "sector_id", "cube_id", "mass_code").groupBy("sector_id").agg(agg.count_tuples("cube_id", "mass_code").alias("boxels"), F.count_distinct("mass_code").alias("codes"))


@query("""SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order,
          arg_max(nullif(o_orderpriority, '1-URGENT'), (o_totalprice, o_orderkey)) AS top_calm FROM orders GROUP BY o_custkey""")
def arg_min_max(spark: S, folder: str) -> DataFrame:
    """arg_min and arg_max with tuple order; null values are passed over."""
    o = table(spark, folder, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    return o.groupBy("o_custkey").agg(
        agg.min_by_held("o_orderkey", "o_orderdate", "o_orderkey").alias("first_order"), agg.max_by_held("o_orderkey", "o_orderdate", "o_orderkey").alias("last_order"),
        agg.max_by_held(F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")), "o_totalprice", "o_orderkey").alias("top_calm"),
    )


@query("""WITH c AS (SELECT sector_id, region_id, count(*) AS n FROM system_known WHERE region_id IS NOT NULL GROUP BY ALL)
          SELECT sector_id, region_id AS region, n FROM c QUALIFY row_number() OVER (PARTITION BY sector_id ORDER BY n DESC, region_id) = 1""")
def modal_region(spark: S, folder: str) -> DataFrame:
    return agg.modal(table(spark, folder, "system_known", "sector_id", "region_id"), ["sector_id"], "region_id", name="region")


@query("SELECT p_brand, string_agg(DISTINCT string_split(p_type, ' ')[1], '+' ORDER BY string_split(p_type, ' ')[1]) AS kinds FROM part GROUP BY p_brand")
def listed_distinct(spark: S, folder: str) -> DataFrame:
    return table(spark, folder, "part", "p_brand", "p_type").groupBy("p_brand").agg(agg.listed(F.split_part("p_type", F.lit(" "), F.lit(1)), "+").alias("kinds"))


@query("SELECT o_custkey, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_totalprice DESC, o_orderkey)[1:3], ',') AS top3 FROM orders GROUP BY o_custkey")
def ordered_list_slice(spark: S, folder: str) -> DataFrame:
    """The first three of an ordered list; cut to three per key before they are collected."""
    o = table(spark, folder, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    top = windows.top_k(o, ["o_custkey"], 3, F.desc("o_totalprice"), F.asc("o_orderkey"), rank="r")
    return top.groupBy("o_custkey").agg(F.array_join(agg.in_order_of(F.col("o_orderkey").cast("string"), "r"), ",").alias("top3"))


@query("SELECT l_shipdate_year AS y, median(l_quantity) AS mid, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM (SELECT year(l_shipdate) AS l_shipdate_year, l_quantity, l_extendedprice FROM lineitem) GROUP BY 1")
def medians(spark: S, folder: str) -> DataFrame:
    """Exact percentiles by positions in the global order: no task holds the values of a year."""
    l = table(spark, folder, "lineitem", "l_shipdate", "l_quantity", "l_extendedprice").select(F.year("l_shipdate").cast("long").alias("y"), "l_quantity", "l_extendedprice")  # noqa: E741
    mid = windows.percentiles(l, ["y"], "l_quantity", {"mid": 0.5})
    return mid.join(windows.percentiles(l, ["y"], "l_extendedprice", {"p90": 0.9}), "y").select("y", "mid", F.round("p90", 4).alias("p90"))


@query("""SELECT DISTINCT o_orderpriority, o_orderstatus, count(*) OVER (PARTITION BY o_orderpriority) AS n, median(o_totalprice) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_orderpriority) AS mid_f FROM orders""")
def window_median(spark: S, folder: str) -> DataFrame:
    """A filtered median of the partition beside each row's group; the medians are worked out once and joined."""
    o = table(spark, folder, "orders", "o_orderpriority", "o_orderstatus", "o_totalprice")
    mids = windows.percentiles(o.where("o_orderstatus = 'F'"), ["o_orderpriority"], "o_totalprice", {"mid_f": 0.5})
    groups = o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("k"))
    return groups.join(mids, "o_orderpriority", "left").select("o_orderpriority", "o_orderstatus", F.sum("k").over(W.partitionBy("o_orderpriority")).alias("n"), "mid_f")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 5 AND count(*) FILTER (o_orderstatus = 'F') * 1e0 / count(*) > 0.5")
def having_ratio(spark: S, folder: str) -> DataFrame:
    o = table(spark, folder, "orders", "o_custkey", "o_orderstatus").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return o.where((F.col("n") >= 5) & (F.col("f") / F.col("n") > 0.5)).select("o_custkey", "n")


@query("""WITH a AS (SELECT sector_id, mass_code, count(*) AS n FROM system_known WHERE mass_code IS NOT NULL GROUP BY ALL) SELECT sector_id, sum(n)::BIGINT AS systems, round(max(n) * 1e0 / sum(n), 6) AS dominance FROM a GROUP BY sector_id""")
def nested_aggregate(spark: S, folder: str) -> DataFrame:
    n = table(spark, folder, "system_known", "sector_id", "mass_code").where("mass_code IS NOT NULL").groupBy("sector_id", "mass_code").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("sector_id").agg(F.sum("n").alias("systems"), F.round(F.max("n") / F.sum("n"), 6).alias("dominance"))


@query("SELECT p_brand, round(avg(p_retailprice) / (SELECT avg(p_retailprice) FROM part), 6) AS rel FROM part GROUP BY p_brand")
def scalar_divisor(spark: S, folder: str) -> DataFrame:
    p = table(spark, folder, "part", "p_brand", "p_retailprice")
    whole = p.agg(F.avg("p_retailprice").alias("whole"))
    return p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("a")).crossJoin(F.broadcast(whole)).select("p_brand", F.round(F.col("a") / F.col("whole"), 6).alias("rel"))


@query("""WITH r AS (SELECT avg(CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END) AS rate FROM lineitem), s AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS k FROM lineitem GROUP BY 1)
          SELECT l_suppkey, least(round((k + 20) / (n * rate + 20), 4), 1) AS factor, round((k + 1) / (n + 2e0), 6) AS smoothed FROM s, r""")
def observed_expected(spark: S, folder: str) -> DataFrame:
    """Observed over expected with shrinkage, and a smoothed rate."""
    l = table(spark, folder, "lineitem", "l_suppkey", "l_returnflag")  # noqa: E741
    s = l.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    rate = s.agg((F.sum("k") / F.sum("n")).alias("rate"))
    return s.crossJoin(F.broadcast(rate)).select("l_suppkey", expr.shrunk_ratio("k", F.col("n") * F.col("rate")).alias("factor"), F.round(expr.laplace("k", "n"), 6).alias("smoothed"))


@query("""WITH t AS (SELECT p_brand, p_size <= 5 AS a, p_size <= 15 AS b, p_retailprice FROM part), n AS (SELECT p_brand, count(*) FILTER (a) AS na, count(*) FILTER (b) AS nb FROM t GROUP BY 1)
          SELECT n.p_brand, CASE WHEN na >= 9 THEN 1 WHEN nb >= 25 THEN 2 ELSE 3 END AS tier, round(avg(p_retailprice) FILTER (CASE WHEN na >= 9 THEN a WHEN nb >= 25 THEN b ELSE true END), 4) AS price
          FROM n JOIN t USING (p_brand) GROUP BY ALL""")
def tier_selection(spark: S, folder: str) -> DataFrame:
    """The narrowest tier with enough rows; sums of all tiers come out of one aggregation."""
    p = table(spark, folder, "part", "p_brand", "p_size", "p_retailprice")
    tiers = [F.col("p_size") <= 5, F.col("p_size") <= 15, F.lit(True)]
    sums = p.groupBy("p_brand").agg(*[F.count_if(t).alias(f"n{i}") for i, t in enumerate(tiers)], *[F.avg(F.when(t, F.col("p_retailprice"))).alias(f"v{i}") for i, t in enumerate(tiers)])
    tier = F.when(F.col("n0") >= 9, 1).when(F.col("n1") >= 25, 2).otherwise(3)
    return sums.select("p_brand", tier.alias("tier"), F.round(F.when(tier == 1, F.col("v0")).when(tier == 2, F.col("v1")).otherwise(F.col("v2")), 4).alias("price"))


@query("SELECT DISTINCT source, w AS word FROM (SELECT sources AS s, poi_id FROM poi WHERE sources IS NOT NULL), unnest(string_split(s, '+')) u(w), (VALUES ('poi')) v(source)")
def distinct_over_unnest(spark: S, folder: str) -> DataFrame:
    return table(spark, folder, "poi", "sources").select(F.lit("poi").alias("source"), F.explode(F.split("sources", r"\+")).alias("word")).distinct()


# --- windows -------------------------------------------------------------------------------------------------------
@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def pick_one(spark: S, folder: str) -> DataFrame:
    return windows.pick_first(table(spark, folder, "orders", "o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("""SELECT type, sub_type, n, round(n * 1e0 / sum(n) OVER (PARTITION BY type), 6) AS of_type, round(n * 1e0 / sum(n) OVER (), 6) AS of_all, CAST(row_number() OVER (PARTITION BY type ORDER BY n DESC, sub_type) AS INTEGER) AS place
          FROM (SELECT type, sub_type, count(*) AS n FROM spansh_galaxy_body GROUP BY ALL)""")
def census_shares(spark: S, folder: str) -> DataFrame:
    """Census by type and subtype with shares of the type and of all, and places; windows over the grouped rows only."""
    n = table(spark, folder, "spansh_galaxy_body", "type", "sub_type").groupBy("type", "sub_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumns({"of_type": F.round(windows.share("n", "type"), 6), "of_all": F.round(windows.share("n"), 6), "place": F.row_number().over(W.partitionBy("type").orderBy(F.desc("n"), "sub_type"))})


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - o_totalprice, 2) AS so_far, count(*) OVER (PARTITION BY o_custkey) AS of_customer FROM orders")
def exclusive_running_sum(spark: S, folder: str) -> DataFrame:
    o = table(spark, folder, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    return o.select("o_custkey", "o_orderkey", F.round(windows.before("o_totalprice", ["o_custkey"], F.col("o_orderkey")), 2).alias("so_far"), F.count(F.lit(1)).over(W.partitionBy("o_custkey")).alias("of_customer"))


@query("""WITH b AS (SELECT p_brand, p_size, avg(p_retailprice) AS v FROM part GROUP BY ALL) SELECT p_brand, p_size, round(v / max(v) FILTER (p_size = 1) OVER (PARTITION BY p_brand), 6) AS rel FROM b""")
def window_with_filter(spark: S, folder: str) -> DataFrame:
    """An aggregate with a filter over a window, as a conditional argument."""
    b = table(spark, folder, "part", "p_brand", "p_size", "p_retailprice").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("v"))
    return b.select("p_brand", "p_size", F.round(F.col("v") / F.max(F.when(F.col("p_size") == 1, F.col("v"))).over(W.partitionBy("p_brand")), 6).alias("rel"))


@query("SELECT user_id, event_id, event_id - lag(event_id) OVER w AS since, lead(event_type) OVER w AS following FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lead_lag(spark: S, folder: str) -> DataFrame:
    e = table(spark, folder, "events", "user_id", "event_id", "event_type", "ts")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", "event_id", (F.col("event_id") - F.lag("event_id").over(w)).alias("since"), F.lead("event_type").over(w).alias("following"))


@query("""SELECT decile, count(*) AS n, round(sum(total), 2) AS total FROM (SELECT total, ntile(10) OVER (ORDER BY total DESC, l_suppkey) AS decile FROM (SELECT l_suppkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1)) GROUP BY 1""")
def deciles(spark: S, folder: str) -> DataFrame:
    """Deciles of suppliers by revenue, cut by exact positions in their order."""
    t = table(spark, folder, "lineitem", "l_suppkey", "l_extendedprice").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("total"))
    d = windows.tiles(t, 10, [F.desc("total"), F.asc("l_suppkey")], "decile")
    return d.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query("""WITH s AS (SELECT DISTINCT p_brand AS brand, CASE WHEN p_brand < 'Brand#3' THEN CAST(substr(p_brand, 7) AS BIGINT) END AS id FROM part), m AS (SELECT coalesce(max(id), 0) AS top FROM s)
          SELECT brand, coalesce(id, top + row_number() OVER (PARTITION BY id IS NULL ORDER BY brand)) AS id FROM s, m""")
def allocate_ids(spark: S, folder: str) -> DataFrame:
    s = table(spark, folder, "part", "p_brand").distinct().select(F.col("p_brand").alias("brand"), F.when(F.col("p_brand") < "Brand#3", F.substring("p_brand", 7, 9).cast("long")).alias("id"))
    return windows.allocate(s, s.select("id"), "id", ["brand"])


@query("SELECT o_custkey, any_value(n_name) AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def any_value_of(spark: S, folder: str) -> DataFrame:
    """A value that is the same on all rows of a group; dimensions are joined to the groups, not to the rows."""
    o = table(spark, folder, "orders", "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, folder, "customer", "c_custkey", "c_nationkey").join(F.broadcast(table(spark, folder, "nation", "n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_custkey").agg(F.any_value("n_name").alias("nation"), F.first("n").alias("n"))


@query("""SELECT coalesce(CAST(y AS VARCHAR), '*') AS y, o_orderpriority, count(*) AS n FROM (SELECT year(o_orderdate) AS y, o_orderpriority FROM orders) GROUP BY GROUPING SETS ((y, o_orderpriority), (o_orderpriority))""")
def two_grouping_sets(spark: S, folder: str) -> DataFrame:
    """Counts per pair of keys and per the second key alone."""
    o = table(spark, folder, "orders", "o_orderdate", "o_orderpriority").select(F.year("o_orderdate").cast("string").alias("y"), "o_orderpriority")
    return agg.wildcard_rollup(o, ["o_orderpriority"], "y", F.count(F.lit(1)).alias("n")).select("y", "o_orderpriority", "n")


@query("SELECT o_orderkey, CASE 'o_orderstatus' WHEN 'o_orderpriority' THEN o_orderpriority WHEN 'o_orderstatus' THEN o_orderstatus END AS picked FROM orders")
def picked_column(spark: S, folder: str, column: str = "o_orderstatus") -> DataFrame:
    """A column that is named by a parameter: only that column reaches the scan."""
    if column not in ("o_orderpriority", "o_orderstatus"):
        raise ValueError(column)
    return table(spark, folder, "orders", "o_orderkey", column).withColumnRenamed(column, "picked")


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_quantity > 10 GROUP BY 1")
def template_fragments(spark: S, folder: str) -> DataFrame:
    """SQL put together from named fragments; values go in as parameters, never as text."""
    table(spark, folder, "lineitem").createOrReplaceTempView("__lines")
    text = expr.fill_template("SELECT l_returnflag, {{MEASURES}} FROM __lines WHERE {{RECENT}} AND l_quantity > :least GROUP BY 1", {"MEASURES": "count(*) AS n, round(sum(${measure}), 2) AS total", "RECENT": "l_shipdate >= :since"}, {"measure": "l_quantity"})
    return spark.sql(text, {"least": 10, "since": datetime.datetime(1995, 1, 1)})


@query("SELECT c.*, n.n_name, n.n_regionkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def star_of_two_tables(spark: S, folder: str) -> DataFrame:
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation", "n_nationkey", "n_name", "n_regionkey")
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey")  # 25 rows


@query("SELECT record_id FROM spansh_galaxy_body WHERE (type, sub_type) IS DISTINCT FROM ('Planet', 'Icy body') AND (volcanism_type, atmosphere_type) IS NOT DISTINCT FROM (NULL, NULL)")
def tuple_distinct(spark: S, folder: str) -> DataFrame:
    """Tuples compared as wholes, with nulls that are equal to each other."""
    b = table(spark, folder, "spansh_galaxy_body", "record_id", "type", "sub_type", "volcanism_type", "atmosphere_type")
    same = lambda a, b: F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(a)]).eqNullSafe(F.struct(*[F.lit(v).cast("string").alias(f"c{i}") for i, v in enumerate(b)]))
    return b.where(~same(["type", "sub_type"], ["Planet", "Icy body"]) & same(["volcanism_type", "atmosphere_type"], [None, None])).select("record_id")


@query("SELECT o_custkey, row_number() OVER (ORDER BY total DESC, o_custkey) AS place FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)")
def display_rank(spark: S, folder: str) -> DataFrame:
    """Places in one order over everything, numbered where the rows lie."""
    t = table(spark, folder, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    placed = numbered(in_order(t, [F.desc("total"), F.asc("o_custkey")]), Scratch(spark, "rank"), "ordered", "no")
    return placed.select("o_custkey", (F.col("no") + 1).alias("place"))


@query("""WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '5-LOW')
          SELECT k, 'first' AS side FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'second' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def symmetric_difference(spark: S, folder: str) -> DataFrame:
    """Keys that only one of two sets has, with the set, from one aggregate."""
    o = table(spark, folder, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority IN ('1-URGENT', '5-LOW')")
    held = o.groupBy(F.col("o_custkey").alias("k")).agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("a"), F.bool_or(F.col("o_orderpriority") == "5-LOW").alias("b"))
    return held.where("a <> b").select("k", F.when(F.col("a"), "first").otherwise("second").alias("side"))


@query("SELECT poi_class, list_append(list_distinct(list(poi_family ORDER BY poi_family) FILTER (poi_family IS NOT NULL)), 'end')[-1] AS last, len(list_distinct(list(poi_family))) AS families FROM poi GROUP BY 1")
def list_append_to(spark: S, folder: str) -> DataFrame:
    p = table(spark, folder, "poi", "poi_class", "poi_family").groupBy("poi_class").agg(F.collect_set("poi_family").alias("f"))
    return p.select("poi_class", F.element_at(F.array_append("f", F.lit("end")), -1).alias("last"), F.size("f").cast("long").alias("families"))


@query("SELECT o_orderpriority, map_keys(m) AS kinds, map_values(m) AS counts, m['F'] AS finished FROM (SELECT o_orderpriority, map(list(o_orderstatus ORDER BY o_orderstatus), list(n ORDER BY o_orderstatus)) AS m FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1)")
def map_of_counts(spark: S, folder: str) -> DataFrame:
    """Counts by kind as a map, its keys in order, and a value looked up in it."""
    n = table(spark, folder, "orders", "o_orderpriority", "o_orderstatus").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("o_orderpriority").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("o_orderstatus", "n")))).alias("m"))
    return m.select("o_orderpriority", F.map_keys("m").alias("kinds"), F.map_values("m").alias("counts"), F.try_element_at("m", F.lit("F")).alias("finished"))


# --- sort, limit, top-k --------------------------------------------------------------------------------------------
@query("SELECT record_id, volcanism_type, surface_temp_k FROM spansh_galaxy_body ORDER BY volcanism_type IS NULL, volcanism_type DESC NULLS LAST, surface_temp_k ASC NULLS LAST, record_id LIMIT 50")
def sorted_limit(spark: S, folder: str) -> DataFrame:
    b = table(spark, folder, "spansh_galaxy_body", "record_id", "volcanism_type", "surface_temp_k")
    return b.orderBy(F.col("volcanism_type").isNull(), F.desc_nulls_last("volcanism_type"), F.asc_nulls_last("surface_temp_k"), "record_id").limit(50)


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 2 ELSE 0 END, o_totalprice DESC, o_orderkey LIMIT 20")
def order_by_rank(spark: S, folder: str) -> DataFrame:
    o = table(spark, folder, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "5-LOW", 2).otherwise(0)
    return o.orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_orderpriority")


@query("""WITH k AS (SELECT DISTINCT sector_id, run_id FROM system_known UNION SELECT sector_id, run_id FROM sector_known),
          s AS (SELECT sector_id, run_id, 0 AS pri, 'stated' AS origin, max(systems) AS systems FROM sector_known WHERE systems IS NOT NULL GROUP BY ALL
                UNION ALL SELECT sector_id, run_id, 1, 'counted', count(DISTINCT system_id) FROM system_known GROUP BY ALL)
          SELECT k.sector_id, k.run_id, origin, systems FROM k LEFT JOIN s USING (sector_id, run_id) QUALIFY row_number() OVER (PARTITION BY k.sector_id, k.run_id ORDER BY pri) = 1""")
def first_source_that_has_it(spark: S, folder: str) -> DataFrame:
    """The number of systems as it is stated, else as it is counted, with where it comes from."""
    key = ["sector_id", "run_id"]
    said = table(spark, folder, "sector_known", *key, "systems")
    stated = said.where("systems IS NOT NULL").groupBy(*key).agg(F.max("systems").alias("stated"))
    counted = table(spark, folder, "system_known", *key, "system_id").groupBy(*key).agg(F.count_distinct("system_id").alias("counted"))
    both = said.select(*key).distinct().join(stated, key, "left").join(counted, key, "full")
    origin = F.when(F.col("stated").isNotNull(), "stated").when(F.col("counted").isNotNull(), "counted")
    return both.select(*key, origin.alias("origin"), F.coalesce("stated", "counted").alias("systems"))


# --- set operations ------------------------------------------------------------------------------------------------
@query("SELECT system_id FROM system_exobio UNION SELECT system_id FROM system_catalog WHERE system_id IS NOT NULL EXCEPT SELECT system_id FROM system_known")
def union_except(spark: S, folder: str) -> DataFrame:
    a = table(spark, folder, "system_exobio", "system_id").union(table(spark, folder, "system_catalog", "system_id").where("system_id IS NOT NULL"))
    return a.distinct().join(table(spark, folder, "system_known", "system_id"), "system_id", "left_anti")


@query("SELECT system_id, NULL AS system, 'catalog' AS origin, entry_id FROM system_catalog UNION ALL BY NAME SELECT system, system_id, 'exobio' AS origin, NULL AS entry_id FROM system_exobio")
def union_by_name(spark: S, folder: str) -> DataFrame:
    a = table(spark, folder, "system_catalog", "system_id", "entry_id").withColumn("origin", F.lit("catalog"))
    b = table(spark, folder, "system_exobio", "system", "system_id").withColumn("origin", F.lit("exobio"))
    return a.unionByName(b, allowMissingColumns=True).select("system_id", "system", "origin", "entry_id")


@query("""SELECT o_custkey, array_to_string(list_sort(list_distinct(list(substr(o_orderpriority, 1, 1)))), '') AS priorities, bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')) AS pressing FROM orders GROUP BY 1""")
def list_sets(spark: S, folder: str) -> DataFrame:
    o = table(spark, folder, "orders", "o_custkey", "o_orderpriority").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    return o.select("o_custkey", F.array_join(F.array_sort(F.array_distinct(F.transform("p", lambda x: F.substring(x, 1, 1)))), "").alias("priorities"), F.arrays_overlap("p", F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("pressing"))


QUERIES, SQL = query.queries, query.sql
