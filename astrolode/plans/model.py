"""Rates, odds and scores from partial observations, and how well they turned out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import agg, expr, windows
from ..operators import graphs, joins, runs
from .galaxy import SHIP, XYZ, live_systems
from .registry import Book
from .tables import table

query = Book()
S = SparkSession
#: Where routes lead to.
FAR = (-28491.5625, 1937.4375, 40012.4375)
#: Length of a jump of a route and of a carrier, in mean distances of the systems, and how many jumps more than a
#: straight line takes a route may have.
ROUTE_SPACINGS, CARRIER_SPACINGS, ROUTE_OVER = 3.3, 4.2, 24


@query("""WITH b AS (SELECT least(abs(x), abs(z)) AS d, worked_bodies > 0 AS hit, candidate_bodies FROM system_exobio WHERE x IS NOT NULL AND z IS NOT NULL),
          g AS (SELECT CASE WHEN d < 1000 THEN '0-1k' WHEN d < 5000 THEN '1-5k' WHEN d < 15000 THEN '5-15k' WHEN d IS NOT NULL THEN 'clear' END AS band, candidate_bodies AS cls, count(*) AS n, count(*) FILTER (hit) AS k FROM b GROUP BY ALL),
          c AS (SELECT cls, sum(k) * 1e0 / sum(n) AS rate FROM g GROUP BY 1), q AS (SELECT band, sum(k) / nullif(sum(n * rate), 0) AS q FROM g JOIN c USING (cls) GROUP BY 1)
          SELECT band, CASE WHEN band = 'clear' THEN 1 ELSE round(q / (SELECT q FROM q WHERE band = 'clear'), 6) END AS factor FROM q""")
def band_factors(spark: S, folder: str) -> DataFrame:
    """Observed over expected by distance band, relative to the band that is clear."""
    e = table(spark, folder, "system_exobio", "x", "z", "worked_bodies", "candidate_bodies").na.drop(subset=["x", "z"])
    band = expr.banded(F.least(F.abs("x"), F.abs("z")), [1000, 5000, 15000], ["0-1k", "1-5k", "5-15k", "clear"])
    g = e.groupBy(band.alias("band"), F.col("candidate_bodies").alias("cls")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("worked_bodies") > 0).alias("k"))
    rate = F.sum("k").over(W.partitionBy("cls")) / F.sum("n").over(W.partitionBy("cls"))
    q = g.withColumn("rate", rate).groupBy("band").agg(expr.ratio(F.sum("k"), F.sum(F.col("n") * F.col("rate"))).alias("q"))
    clear = F.max(F.when(F.col("band") == "clear", F.col("q"))).over(W.partitionBy())
    return q.select("band", F.when(F.col("band") == "clear", F.lit(1.0)).otherwise(F.round(F.col("q") / clear, 6)).alias("factor"))


@query("""WITH s AS (SELECT sector_id, count(*) FILTER (mass_code = 'c') AS c, count(*) FILTER (mass_code = 'd') AS d, count(*) AS n FROM system_known GROUP BY 1)
          SELECT sector_id, round(1 / (1 + exp(-greatest(-50, least(50, 0.1 * (c * ln(0.4 / 0.2) + d * ln(0.1 / 0.3)) + ln(0.25 / 0.75))))), 8) AS posterior FROM s""")
def mixture_posterior(spark: S, folder: str) -> DataFrame:
    """Odds that a sector is of the first of two types, from tempered log shares of its counts and a prior."""
    s = table(spark, folder, "system_known", "sector_id", "mass_code").groupBy("sector_id").agg(F.count_if(F.col("mass_code") == "c").alias("c"), F.count_if(F.col("mass_code") == "d").alias("d"))
    evidence = 0.1 * (F.col("c") * F.log(F.lit(0.4 / 0.2)) + F.col("d") * F.log(F.lit(0.1 / 0.3))) + F.log(F.lit(0.25 / 0.75))
    return s.select("sector_id", F.round(expr.logistic(evidence), 8).alias("posterior"))


@query("""WITH s AS (SELECT system_id, max(cr_expected) AS score, bool_or(worked_bodies > 0) AS hit FROM system_exobio GROUP BY 1), d AS (SELECT *, ntile(10) OVER (ORDER BY score DESC, system_id) AS decile FROM s)
          SELECT decile, count(*) AS n, count(*) FILTER (hit) AS found, round(count(*) FILTER (hit) * 1e0 / count(*) / (SELECT avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END) FROM s), 6) AS lift FROM d GROUP BY 1""")
def lift_by_decile(spark: S, folder: str) -> DataFrame:
    """How much more often the better-scored tenths came true.

    Tenths are cut by exact positions in the order of the score, found from counts per partition, not by one task.
    """
    s = table(spark, folder, "system_exobio", "system_id", "cr_expected", "worked_bodies").groupBy("system_id").agg(F.max("cr_expected").alias("score"), F.bool_or(F.col("worked_bodies") > 0).alias("hit"))
    ranked = windows.tiles(s, 10, [F.desc("score"), F.asc("system_id")], "decile")
    g = ranked.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("found"))
    base = F.sum("found").over(W.partitionBy()) / F.sum("n").over(W.partitionBy())
    return g.select("decile", "n", "found", F.round(F.col("found") / F.col("n") / base, 6).alias("lift"))


@query("""WITH s AS (SELECT cr_expected AS score, count(*) FILTER (worked_bodies > 0) AS p, count(*) FILTER (worked_bodies <= 0) AS q FROM system_exobio GROUP BY 1),
          c AS (SELECT *, sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - q AS below FROM s) SELECT round(sum(p * (below + q / 2e0)) / (sum(p) * sum(q)), 6) AS auc FROM c""")
def auc(spark: S, folder: str) -> DataFrame:
    """Area under the curve from counts by score; ties count half."""
    s = table(spark, folder, "system_exobio", "cr_expected", "worked_bodies").groupBy(F.col("cr_expected").alias("score")).agg(F.count_if(F.col("worked_bodies") > 0).alias("p"), F.count_if(F.col("worked_bodies") <= 0).alias("q"))
    # prefix sums in two steps: within blocks of scores, and over the few blocks
    block = F.floor(F.log2(F.col("score").cast("double") + 1) * 64)
    b = s.withColumn("b", block)
    inner = b.withColumn("below", windows.before("q", ["b"], F.col("score")))
    outer = b.groupBy("b").agg(F.sum("q").alias("bq")).withColumn("lower", windows.before("bq", [], F.col("b"))).select("b", "lower")
    c = inner.join(outer, "b")
    return c.agg(F.round(F.sum(F.col("p") * (F.col("below") + F.col("lower") + F.col("q") / 2)) / (F.sum("p") * F.sum("q")), 6).alias("auc"))


@query("""WITH m AS (SELECT system_id AS old, sector_id, count(*) AS n FROM system_known GROUP BY ALL), p AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY old ORDER BY n DESC, sector_id) = 1)
          SELECT old, sector_id FROM p QUALIFY count(*) OVER (PARTITION BY sector_id) <= 3""")
def rekey_map(spark: S, folder: str) -> DataFrame:
    """Old keys to the key most of their rows have, where few old keys claim it."""
    best = agg.modal(table(spark, folder, "system_known", "system_id", "sector_id"), ["system_id"], "sector_id", name="sector").drop("n")
    few = best.groupBy("sector").agg(F.count(F.lit(1)).alias("n")).where("n <= 3").select("sector")
    return best.join(few, "sector", "left_semi").select(F.col("system_id").alias("old"), F.col("sector").alias("sector_id"))


@query("""WITH s AS (SELECT *, 'live' AS origin FROM (SELECT system_id, cr_expected, '99999999' AS taken FROM system_exobio) UNION ALL SELECT system_id, cr_expected, strftime(last_reported, '%Y%m%d'), 'snapshot' FROM system_exobio WHERE system_id % 2 = 0)
          SELECT system_id, origin, cr_expected FROM s QUALIFY row_number() OVER (PARTITION BY system_id ORDER BY taken DESC, cr_expected DESC) = 1""")
def newest_snapshot(spark: S, folder: str) -> DataFrame:
    """Of a live table and its snapshots, the newest row of each key."""
    e = table(spark, folder, "system_exobio", "system_id", "cr_expected", "last_reported")
    live = e.select("system_id", "cr_expected", F.lit("99999999").alias("taken"), F.lit("live").alias("origin"))
    snap = e.where("system_id % 2 = 0").select("system_id", "cr_expected", F.date_format("last_reported", "yyyyMMdd").alias("taken"), F.lit("snapshot").alias("origin"))
    return windows.pick_first(live.unionByName(snap), ["system_id"], F.desc("taken"), F.desc("cr_expected")).select("system_id", "origin", "cr_expected")


@query("""WITH p AS (SELECT least(system_a, system_b) AS a, greatest(system_a, system_b) AS b, min(source) AS source FROM system_catalog_alias WHERE system_a <> '' AND system_b <> '' AND system_a <> system_b GROUP BY ALL),
          c AS (SELECT name, count(*) AS claims FROM (SELECT a AS name FROM p UNION ALL SELECT b FROM p) GROUP BY 1)
          SELECT p.* FROM p JOIN c x ON x.name = a JOIN c y ON y.name = b WHERE x.claims <= 4 AND y.claims <= 4""")
def alias_claims(spark: S, folder: str) -> DataFrame:
    """Ordered pairs, the first source of each; partners that more than four claim are dropped."""
    from ..operators.skew import salted_join

    p = table(spark, folder, "system_catalog_alias").where("system_a <> '' AND system_b <> '' AND system_a <> system_b")
    p = p.groupBy(F.least("system_a", "system_b").alias("a"), F.greatest("system_a", "system_b").alias("b")).agg(F.min("source").alias("source"))
    few = p.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n <= 4")
    for c in ("a", "b"):
        p = salted_join(p, few.select(F.col("name").alias(c)), [c], "left_semi")
    return p.select("a", "b", "source")


@query("""SELECT act, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'of the ([A-Z][a-z]+(?: [a-z]+)?(?: [A-Z][a-z]+)+)', 1)) AS act FROM documents) GROUP BY 1""")
def mentions(spark: S, folder: str) -> DataFrame:
    """Names of acts mentioned in running text, whole texts read."""
    d = table(spark, folder, "documents", "doc_id", "text")
    found = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("of the ([A-Z][a-z]+(?: [a-z]+)?(?: [A-Z][a-z]+)+)"), F.lit(1))).alias("act"))
    return found.groupBy("doc_id", "act").agg(F.count(F.lit(1)).alias("n")).groupBy("act").agg(F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("documents"))


@query("""SELECT record_id, round(-r * cos(b) * sin(l), 4) AS gx, round(r * sin(b), 4) AS gy, round(r * cos(b) * cos(l), 4) AS gz FROM (
            SELECT record_id, 3261.56 / (1 + record_id % 300) AS r, radians(record_id % 360) AS l, radians(record_id % 180 - 90) AS b FROM spansh_galaxy_body)""")
def parallax_positions(spark: S, folder: str) -> DataFrame:
    x, y, z = expr.galactic_xyz(1 + F.col("record_id") % 300, F.col("record_id") % 360, F.col("record_id") % 180 - 90)
    return table(spark, folder, "spansh_galaxy_body", "record_id").select("record_id", F.round(x, 4).alias("gx"), F.round(y, 4).alias("gy"), F.round(z, 4).alias("gz"))


@query("""WITH r AS (SELECT CAST(o_custkey % 300 AS INTEGER) AS row_no, o_orderkey, CAST(o_orderkey % 7 AS INTEGER) AS length, CAST(o_custkey % 5 AS INTEGER) AS value FROM orders)
          SELECT row_no, o_orderkey, CAST(sum(length) OVER (PARTITION BY row_no ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS start, length, value FROM r""")
def run_starts(spark: S, folder: str) -> DataFrame:
    o = table(spark, folder, "orders", "o_custkey", "o_orderkey").select((F.col("o_custkey") % 300).cast("int").alias("row_no"), "o_orderkey", (F.col("o_orderkey") % 7).cast("int").alias("length"), (F.col("o_custkey") % 5).cast("int").alias("value"))
    return runs.starts(o, "row_no", "o_orderkey", "length").select("row_no", "o_orderkey", "start", "length", "value")


@query("""SELECT event_id, k FROM (SELECT event_id, unnest(from_json('[' || props || ',{"k":' || event_id || '}]', '[{"k":"BIGINT"}]'), recursive := true) FROM events) WHERE event_id >= 0""")
def json_inline(spark: S, folder: str) -> DataFrame:
    """A list of objects in a text, as rows."""
    e = table(spark, folder, "events", "event_id", "props")
    text = F.concat(F.lit("["), F.col("props"), F.lit(',{"k":'), F.col("event_id").cast("string"), F.lit("}]"))
    return e.select("event_id", F.inline(F.from_json(text, "array<struct<k:bigint>>")))


@query("""SELECT k, array_to_string(list_slice(w, 1, greatest(len(w) - 2, 0)), ' ') AS head, w[-1] AS last, list_contains(w, 'the') AS has_the, len(w) AS words FROM (SELECT poi_id AS k, string_split(poi, ' ') AS w FROM poi)""")
def list_functions(spark: S, folder: str) -> DataFrame:
    w = table(spark, folder, "poi", "poi_id", "poi").select(F.col("poi_id").alias("k"), F.split("poi", " ").alias("w"))
    return w.select("k", F.array_join(F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))), " ").alias("head"), F.try_element_at("w", F.lit(-1)).alias("last"), F.array_contains("w", "the").alias("has_the"), F.size("w").cast("long").alias("words"))


def _spacing(stars: DataFrame) -> float:
    """Edge of the cube that a star has for itself on average, in the box around all of them; 1 where there are too few."""
    box = stars.agg(F.count_distinct("name").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in XYZ]).first()
    return (box["x"] * box["y"] * box["z"] / box["n"]) ** (1 / 3) or 1.0 if box["n"] else 1.0


_STARS = """s AS (SELECT system AS name, min(x) AS x, min(y) AS y, min(z) AS z FROM system_exobio WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY 1),
    room AS (SELECT pow((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) / count(*), 1 / 3e0) AS edge FROM s)"""
_AWAY = lambda p, q: f"sqrt(({p[0]} - ({q[0]})) ** 2 + ({p[1]} - ({q[1]})) ** 2 + ({p[2]} - ({q[2]})) ** 2)"
_S, _W, _B = (tuple(f"{t}.{c}" for c in XYZ) for t in "swb")


@query()
def route(spark: S, folder: str) -> DataFrame:
    """A route of the fewest jumps over the systems; a jump is about as long as the gaps between them, so there are many."""
    s = table(spark, folder, "system_exobio", "system", *XYZ).na.drop(subset=XYZ).withColumnRenamed("system", "name")
    hops = graphs.fewest_hops(s, SHIP, FAR, ROUTE_SPACINGS * _spacing(s), over=ROUTE_OVER)
    return spark.createDataFrame([(h["jump"], h["name"], h.get("x"), h.get("y"), h.get("z")) for h in hops], "jump int, name string, x double, y double, z double")


@query(f"""WITH RECURSIVE {_STARS}, link AS (SELECT a.name AS here, b.name AS there FROM s a, s b, room WHERE a.name <> b.name AND {_AWAY(("a.x", "a.y", "a.z"), _B)} <= {ROUTE_SPACINGS} * edge),
           reached(n, name) AS (SELECT 1, name FROM s, room WHERE {_AWAY(_S, SHIP)} <= {ROUTE_SPACINGS} * edge UNION SELECT n + 1, there FROM reached JOIN link ON here = name WHERE n < 40)
           SELECT min(n)::INTEGER AS jumps, true AS sound FROM reached JOIN s USING (name), room WHERE {_AWAY(_S, FAR)} <= {ROUTE_SPACINGS} * edge""")
def route_jumps(spark: S, folder: str) -> DataFrame:
    """The number of jumps of the route, and whether each of them is one that can be made."""
    r = route(spark, folder).orderBy("jump").withColumn("one", F.lit(1))
    reach = ROUTE_SPACINGS * _spacing(table(spark, folder, "system_exobio", "system", *XYZ).na.drop(subset=XYZ).withColumnRenamed("system", "name"))
    w = W.partitionBy("one").orderBy("jump")  # a route is as long as its jumps
    back = [F.coalesce(F.lag(c).over(w), F.lit(v)) for c, v in zip(XYZ, SHIP, strict=True)]
    fine = r.withColumn("fine", expr.distance3(XYZ, back) <= reach * (1 + 1e-12)).groupBy("one")
    ends = F.max_by(expr.distance3(XYZ, list(FAR)), "jump") <= reach * (1 + 1e-12)
    return fine.agg(F.max("jump").alias("jumps"), (F.bool_and("fine") & ends).alias("sound")).select("jumps", "sound")


@query(f"""WITH RECURSIVE {_STARS}, walk(hop, name, x, y, z) AS (SELECT 0, '', {SHIP[0]}::DOUBLE, {SHIP[1]}::DOUBLE, {SHIP[2]}::DOUBLE
           UNION ALL SELECT hop + 1, m.name, m.x, m.y, m.z FROM (SELECT w.hop, min({{'d': {_AWAY(_S, FAR)}, 'name': s.name, 'x': s.x, 'y': s.y, 'z': s.z}}) AS m FROM walk w, s, room
             WHERE w.hop < 100 AND {_AWAY(_W, FAR)} > 1 AND {_AWAY(_S, _W)} BETWEEN 0.5 AND {CARRIER_SPACINGS} * edge AND {_AWAY(_S, FAR)} < {_AWAY(_W, FAR)} GROUP BY w.hop))
           SELECT hop, name, x, y, z FROM walk WHERE hop > 0""")
def carrier_path(spark: S, folder: str) -> DataFrame:
    """Hops towards a place that each go as near to it as their range allows."""
    s = table(spark, folder, "system_exobio", "system", *XYZ).na.drop(subset=XYZ).withColumnRenamed("system", "name")
    hops = graphs.greedy_path(s, SHIP, FAR, CARRIER_SPACINGS * _spacing(s))
    return spark.createDataFrame([(h["hop"], h["name"], h["x"], h["y"], h["z"]) for h in hops], "hop int, name string, x double, y double, z double")


@query("""WITH g AS (SELECT CAST(floor((x + 49985) / 1280) AS BIGINT) AS i, CAST(floor((z + 24105) / 1280) AS BIGINT) AS k, count(*) AS n FROM (SELECT DISTINCT system_id, x, z FROM system_exobio WHERE x IS NOT NULL AND z IS NOT NULL) GROUP BY 1, 2)
          SELECT g.i + a.d AS i, g.k + b.d AS k FROM g, (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d) WHERE n >= 3 EXCEPT SELECT i, k FROM g""")
def unvisited_neighbours(spark: S, folder: str) -> DataFrame:
    """Cells next to well-known ones in which nothing is known: a template of nine, and an anti join on a computed key."""
    cell = lambda c, o: F.floor((F.col(c) + F.lit(o)) / 1280)
    g = table(spark, folder, "system_exobio", "system_id", "x", "z").na.drop(subset=["x", "z"]).distinct().groupBy(cell("x", 49985.0).alias("i"), cell("z", 24105.0).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    around = g.where("n >= 3").select("i", "k", step.alias("s")).select((F.col("i") + F.col("s.a")).alias("i"), (F.col("k") + F.col("s.b")).alias("k")).distinct()
    return around.join(g, ["i", "k"], "left_anti")


@query(f"""SELECT service, callsign, round(d, 3) AS ly FROM (SELECT substr(callsign, 1, 1) AS service, callsign, min(sqrt((x - {SHIP[0]}) ** 2 + (y - {SHIP[1]}) ** 2 + (z - {SHIP[2]}) ** 2)) AS d FROM carrier_position WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY ALL)
           QUALIFY row_number() OVER (PARTITION BY service ORDER BY d, callsign) = 1""")
def nearest_per_kind(spark: S, folder: str) -> DataFrame:
    """The nearest carrier of each kind."""
    c = table(spark, folder, "carrier_position", "callsign", *XYZ).na.drop(subset=XYZ)
    n = c.groupBy(F.substring("callsign", 1, 1).alias("service")).agg(F.min(F.struct(expr.distance3(XYZ, SHIP).alias("d"), "callsign")).alias("m"))
    return n.select("service", F.col("m.callsign").alias("callsign"), F.round("m.d", 3).alias("ly"))


@query(f"""SELECT z_row, greatest(x_start, 600) AS x_start, least(x_start + length, 1000) - greatest(x_start, 600) AS length, r.value FROM (SELECT CAST(floor((z + 24105) * 83 / 4096) AS INTEGER) AS z_row, min(CAST(floor((x + 49985) * 83 / 4096) AS INTEGER)) AS x_start,
           max(CAST(floor((x + 49985) * 83 / 4096) AS INTEGER)) - min(CAST(floor((x + 49985) * 83 / 4096) AS INTEGER)) + 1 AS length, min(region_id) AS value FROM system_known WHERE x IS NOT NULL AND z IS NOT NULL GROUP BY 1) r
           WHERE x_start < 1000 AND x_start + length > 600 ORDER BY z_row""")
def runs_overlapping(spark: S, folder: str) -> DataFrame:
    """Runs of the raster that overlap a window."""
    cell = lambda c, o: F.floor((F.col(c) + F.lit(o)) * 83 / 4096).cast("int")
    k = table(spark, folder, "system_known", "x", "z", "region_id").na.drop(subset=["x", "z"])
    r = k.groupBy(cell("z", 24105.0).alias("z_row")).agg(F.min(cell("x", 49985.0)).alias("x_start"), (F.max(cell("x", 49985.0)) - F.min(cell("x", 49985.0)) + 1).alias("length"), F.min("region_id").alias("value"))
    return joins.runs_in_window(r, start="x_start", length="length", low=600, high=1000)


@query("""WITH l AS (SELECT * FROM system_known WHERE removed_at IS NULL QUALIFY row_number() OVER (PARTITION BY system_id ORDER BY run_id DESC, first_seen DESC, poi_id NULLS LAST, body_count NULLS LAST) = 1)
          SELECT *, round(n * 1e0 / sum(n) OVER (PARTITION BY region_id), 6) AS of_region FROM (SELECT region_id, mass_code, count(*) AS n, round(sum(coalesce(body_count, 0)) * 1e0 / count(*), 4) AS bodies FROM l GROUP BY ALL)""")
def region_rollup(spark: S, folder: str) -> DataFrame:
    l = live_systems(spark, folder).groupBy("region_id", "mass_code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("body_count", F.lit(0))) / F.count(F.lit(1)), 4).alias("bodies"))  # noqa: E741
    return l.withColumn("of_region", F.round(windows.share("n", "region_id"), 6))


# Temperatures at which a rung counts, the depth of the ladder (5/9 * 1300 K, to the power 1.2), and labels.
_MARKS = [114.0, 210.0, 270.0, 370.0, 700.0, 900.0, 1400.0]


@query("""WITH marks AS (SELECT unnest([114, 210, 270, 370, 700, 900, 1400])::FLOAT AS mark), body AS (SELECT record_id, row_number() OVER () AS row, CAST(surface_temp_k AS FLOAT)::DOUBLE AS low, surface_temp_k + 5e0 / 9 * 1300 * pow(surface_temp_k / 1300, 1.2) AS high FROM spansh_galaxy_body WHERE surface_temp_k > 0),
          rung AS (SELECT row, CAST(low + i * ((high - low) / 7e0) AS FLOAT) AS step FROM body, range(7) s(i)),
          met AS (SELECT row, max(CASE WHEN step = mark THEN 3 WHEN nextafter(step, mark) = mark THEN 2 ELSE 1 END) AS best FROM rung, marks GROUP BY 1)
          SELECT record_id, ['OFF', 'ONE_OFF', 'ON'][best] AS landing FROM body JOIN met USING (row)""")
def ladder_landings(spark: S, folder: str) -> DataFrame:
    """Single-precision ladders over temperatures, and whether a rung meets a mark to the last bit."""
    from ..functions import floats

    b = table(spark, folder, "spansh_galaxy_body", "record_id", "surface_temp_k").where("surface_temp_k > 0")
    t = F.col("surface_temp_k")
    top = t + F.lit(5.0) / F.lit(9.0) * 1300 * F.pow(t / 1300, F.lit(1.2))
    return b.select("record_id", floats.touches(floats.ladder(t, top), _MARKS, F.lit(True)).alias("landing"))


@query("SELECT s_suppkey, sector_at(s_acctbal, s_acctbal / 2, s_acctbal * 2) AS cell, distance3(s_acctbal, 0, 0, 0, 3, 4) AS d, mass_code_of(s_suppkey) AS code, shrunk_ratio(s_suppkey, 50) AS r FROM (SELECT s_suppkey, s_acctbal FROM supplier)".replace(
    "sector_at(s_acctbal, s_acctbal / 2, s_acctbal * 2)", "CAST(floor((s_acctbal + 49985) / 1280) AS BIGINT) + 128 * CAST(floor((s_acctbal / 2 + 40985) / 1280) AS BIGINT) + 16384 * CAST(floor((s_acctbal * 2 + 24105) / 1280) AS BIGINT)").replace(
    "distance3(s_acctbal, 0, 0, 0, 3, 4)", "sqrt(s_acctbal * s_acctbal + 25)").replace("mass_code_of(s_suppkey)", "substr('abcdefgh', CAST(s_suppkey & 7 AS INTEGER) + 1, 1)").replace("shrunk_ratio(s_suppkey, 50)", "least(round((s_suppkey + 20) / 70e0, 4), 1e0)"))
def sql_functions(spark: S, folder: str) -> DataFrame:
    """Functions with names of their own in SQL."""
    from ..functions.sql_functions import register

    register(spark)
    table(spark, folder, "supplier", "s_suppkey", "s_acctbal").createOrReplaceTempView("__supplier")
    return spark.sql("SELECT s_suppkey, sector_at(s_acctbal, s_acctbal / 2, s_acctbal * 2) AS cell, distance3(s_acctbal, 0, 0, 0, 3, 4) AS d, mass_code_of(s_suppkey) AS code, shrunk_ratio(s_suppkey, 50) AS r FROM __supplier")


@query("""WITH RECURSIVE s AS (SELECT DISTINCT system_id, x, y, z, floor(x / 12) AS i, floor(y / 12) AS j, floor(z / 12) AS k FROM system_exobio WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
          o AS (SELECT system_id, x, y, z, i + a.d AS i, j + b.d AS j, k + c.d AS k FROM s, (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d), (VALUES (-1), (0), (1)) c(d)),
          e AS (SELECT s.system_id AS a, o.system_id AS b FROM s JOIN o USING (i, j, k) WHERE s.system_id <> o.system_id AND (s.x - o.x) ** 2 + (s.y - o.y) ** 2 + (s.z - o.z) ** 2 <= 25),
          r(node, other) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other) SELECT node, min(other) AS label FROM r GROUP BY node""")
def clusters(spark: S, folder: str) -> DataFrame:
    """Single-link clusters of systems within 5 ly of each other."""
    from ..operators.proximity import radius_pairs

    p = table(spark, folder, "system_exobio", "system_id", *XYZ).na.drop(subset=XYZ).distinct().select(F.lit(0).alias("kind"), F.col("system_id").alias("id"), *XYZ)
    pairs = radius_pairs(p, 5.0, coordinates=XYZ).select(F.col("id").alias("a"), F.col("near_id").alias("b"))
    return graphs.components(pairs, a="a", b="b")


QUERIES, SQL = query.queries, query.sql
