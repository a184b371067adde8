"""Problem 6: genera, species, rings and hotspots out of the nested texts of the body feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nested import Shape, flatten, paths, tables
from .tables import table

SHAPES = {
    "genuses": Shape("genuses", wrappers=("genuses",), name=("genus", "Genus", "name"), inner=(Shape("species", wrappers=("items",), name=("name", "type"), under=("species",)),)),
    "ring_types": Shape("rings", wrappers=("rings",), name=("type",), inner=(Shape("hotspots", wrappers=("hotspots", "items"), name=("type", "name"), under=("signals", "hotspots")),), plain_list=True),
}


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    bodies = table(spark, folder, "spansh_galaxy_body", "record_id", *SHAPES)
    return bodies.select(F.col("record_id").alias("key"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in SHAPES])))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, nested_field, parent_pos, child_pos, item: one row per genus, species, ring and hotspot."""
    return flatten(_texts(spark, folder), SHAPES).select(F.col("key").alias("record_id"), F.col("field").alias("nested_field"), "parent_pos", "child_pos", "item")


def children(spark: SparkSession, folder: str) -> DataFrame:
    """Each species or hotspot with the genus or ring that it belongs to ('' if that is not there)."""
    rows = found(spark, folder)
    outer = rows.where("child_pos = -1 AND parent_pos >= 0").select("record_id", "nested_field", "parent_pos", F.col("item").alias("parent"))
    return rows.where("child_pos >= 0").join(outer, ["record_id", "nested_field", "parent_pos"], "left").na.fill("", ["parent"])


def paths_found(spark: SparkSession, folder: str) -> DataFrame:
    """field, ancestor, leaf, n: the tables and columns that the nested texts hold."""
    return paths(_texts(spark, folder), SHAPES)


def _element_table(field: str, ancestor: str, leaves: dict[str, str]):
    def elements(spark: SparkSession, folder: str) -> DataFrame:
        held = tables(_texts(spark, folder), SHAPES, columns={(field, ancestor): [x.partition("~")[0] for x in leaves]})[field, ancestor]
        own = [F.col(f"`{x}`").alias(n) for x, n in leaves.items()]
        return held.select(F.col("key").alias("record_id"), F.array_join("parent", "/").alias("parent"), F.array_join("ordinals", "/").alias("element"), F.col("bare"), *own).distinct()

    return elements


QUERIES = {
    "p6_found": found, "p6_children": children, "p6_paths": paths_found,
    "p6_genuses": _element_table("genuses", "genuses", {"genus": "genus", "genus.name": "genus_name", "genus.seen.by": "seen_by", "Genus~2": "genus_2", "Genus_Localised": "localised", "name": "name"}),
    "p6_species": _element_table("genuses", "genuses.species", {"name": "name", "colony_m": "colony_m"}),
    "p6_samples": _element_table("genuses", "genuses.species.samples", {"lat": "lat", "lon": "lon"}),
    "p6_rings": _element_table("ring_types", "rings", {"name": "name", "type": "type", "mass": "mass"}),
    "p6_hotspots": _element_table("ring_types", "rings.hotspots", {"type": "type", "count": "count"}),
}

# Texts are unwrapped step by step: strings that hold JSON, wrapping objects, single objects in place of lists.
_JSON = """
    t AS (SELECT DISTINCT record_id, f, x FROM (SELECT record_id, 'genuses' AS f, genuses AS x FROM spansh_galaxy_body UNION ALL SELECT record_id, 'ring_types', ring_types FROM spansh_galaxy_body) WHERE trim(x, ' \t\n\r') <> ''),
    l AS (SELECT record_id, f, x, CASE WHEN regexp_matches(x, '^\\s*([\\[{"]|(null|true|false)\\s*$)') AND json_valid(x) THEN x::JSON END AS j FROM t),
    s AS (SELECT record_id, f, CASE WHEN json_type(j) = 'VARCHAR' THEN j ->> '$' ELSE x END AS x FROM l),
    k AS (SELECT record_id, f, x, likely, CASE WHEN likely AND json_valid(x) THEN x::JSON END AS j FROM (SELECT *, regexp_matches(x, '^\\s*([\\[{"]|(null|true|false)\\s*$)') AS likely FROM s) WHERE trim(x, ' \t\n\r') <> ''),
    plain AS (SELECT record_id, f, trim(part, ' \t\n\r') AS item, i - 1 AS pos FROM (SELECT record_id, f, unnest(c) AS part, generate_subscripts(c, 1) AS i FROM (SELECT record_id, f, CASE f WHEN 'ring_types' THEN string_split(x, ',') ELSE [x] END AS c FROM k WHERE NOT likely))),
    w AS (SELECT record_id, f, CASE WHEN json_type(j) <> 'OBJECT' THEN j WHEN f = 'genuses' AND json_exists(j, '$.genuses') THEN j -> '$.genuses' WHEN f = 'ring_types' AND json_exists(j, '$.rings') THEN j -> '$.rings' ELSE j END AS j FROM k WHERE j IS NOT NULL),
    v AS (SELECT record_id, f, CASE WHEN json_type(j) = 'VARCHAR' AND json_valid(j ->> '$') THEN (j ->> '$')::JSON ELSE j END AS j FROM w),
    e AS (SELECT record_id, f, unnest(c) AS el, generate_subscripts(c, 1) - 1 AS pos FROM (SELECT record_id, f, CASE json_type(j) WHEN 'ARRAY' THEN j::JSON[] WHEN 'NULL' THEN [] ELSE [j] END AS c FROM v)),
    o AS (SELECT record_id, f, pos, CASE WHEN json_type(el) = 'VARCHAR' AND regexp_matches(el ->> '$', '^\\s*[\\[{]') AND json_valid(el ->> '$') THEN (el ->> '$')::JSON ELSE el END AS el FROM e WHERE el IS NOT NULL AND json_type(el) <> 'NULL'),
    i0 AS (SELECT record_id, f, pos, CASE f WHEN 'genuses' THEN el -> '$.species' ELSE coalesce(el -> '$.signals', el -> '$.hotspots') END AS j FROM o WHERE json_type(el) = 'OBJECT'),
    i1 AS (SELECT record_id, f, pos, CASE WHEN json_type(j) = 'VARCHAR' AND json_valid(j ->> '$') THEN (j ->> '$')::JSON ELSE j END AS j FROM i0 WHERE j IS NOT NULL),
    i2 AS (SELECT record_id, f, pos, CASE WHEN json_type(j) <> 'OBJECT' THEN j WHEN f = 'ring_types' AND json_exists(j, '$.hotspots') THEN j -> '$.hotspots' WHEN json_exists(j, '$.items') THEN j -> '$.items' ELSE j END AS j FROM i1),
    i3 AS (SELECT record_id, f, pos, unnest(c) AS el, generate_subscripts(c, 1) - 1 AS child FROM (SELECT record_id, f, pos, CASE json_type(j) WHEN 'ARRAY' THEN j::JSON[] WHEN 'NULL' THEN [] ELSE [j] END AS c FROM i2)),
    called AS (SELECT record_id, f, pos, -1 AS child, CASE WHEN json_type(el) <> 'OBJECT' THEN el ->> '$'
                 WHEN f = 'ring_types' THEN coalesce(el ->> '$.type', '')
                 ELSE coalesce(CASE WHEN json_type(el -> '$.genus') = 'OBJECT' THEN el ->> '$.genus.name' ELSE el ->> '$.genus' END, CASE WHEN json_type(el -> '$.Genus') = 'OBJECT' THEN el ->> '$.Genus.name' ELSE el ->> '$.Genus' END,
                               CASE WHEN json_type(el -> '$.name') = 'OBJECT' THEN el ->> '$.name.name' ELSE el ->> '$.name' END, '') END AS item FROM o
               UNION ALL SELECT record_id, f, pos, child, CASE WHEN json_type(el) <> 'OBJECT' THEN el ->> '$' WHEN f = 'ring_types' THEN coalesce(el ->> '$.type', el ->> '$.name', '') ELSE coalesce(el ->> '$.name', el ->> '$.type', '') END
               FROM i3 WHERE el IS NOT NULL AND json_type(el) <> 'NULL'),
    rows_ AS (SELECT DISTINCT record_id, f AS nested_field, CAST(pos AS INTEGER) AS parent_pos, CAST(child AS INTEGER) AS child_pos, item FROM (
               SELECT * FROM called UNION ALL SELECT record_id, f, pos, -1, item FROM plain UNION ALL SELECT record_id, f, -1, -1, 'unreadable' FROM k WHERE likely AND j IS NULL))"""

SQL = {
    "p6_found": f"WITH {_JSON} SELECT * FROM rows_",
    "p6_children": f"""WITH {_JSON} SELECT c.*, coalesce(p.item, '') AS parent FROM rows_ c LEFT JOIN rows_ p ON p.record_id = c.record_id AND p.nested_field = c.nested_field AND p.parent_pos = c.parent_pos AND p.child_pos = -1
        WHERE c.child_pos >= 0""",
    "p6_hotspots": f"""WITH {_JSON} SELECT DISTINCT record_id, CAST(pos AS VARCHAR) AS parent, pos || '/' || child AS element, CASE WHEN json_type(el) <> 'OBJECT' THEN el ->> '$' END AS bare, el ->> '$.type' AS type, el ->> '$.count' AS count
        FROM i3 WHERE f = 'ring_types' AND el IS NOT NULL AND json_type(el) <> 'NULL'""",
    "p6_species": f"""WITH {_JSON} SELECT DISTINCT record_id, CAST(pos AS VARCHAR) AS parent, pos || '/' || child AS element, CASE WHEN json_type(el) <> 'OBJECT' THEN el ->> '$' END AS bare, el ->> '$.name' AS name, el ->> '$.colony_m' AS colony_m
        FROM i3 WHERE f = 'genuses' AND el IS NOT NULL AND json_type(el) <> 'NULL'""",
    "p6_rings": f"""WITH {_JSON} SELECT DISTINCT record_id, '' AS parent, CAST(pos AS VARCHAR) AS element, CASE WHEN json_type(el) <> 'OBJECT' THEN el ->> '$' END AS bare, el ->> '$.name' AS name, el ->> '$.type' AS type, el ->> '$.mass' AS mass
        FROM o WHERE f = 'ring_types' UNION SELECT record_id, '', CAST(pos AS VARCHAR), item, NULL, NULL, NULL FROM plain WHERE f = 'ring_types'""",
    "p6_samples": f"""WITH {_JSON}, m AS (SELECT record_id, pos, child, el -> '$.samples' AS j FROM i3 WHERE f = 'genuses' AND json_type(el) = 'OBJECT' AND json_exists(el, '$.samples')),
        n AS (SELECT record_id, pos, child, unnest(c) AS el, generate_subscripts(c, 1) - 1 AS i FROM (SELECT *, CASE json_type(j) WHEN 'ARRAY' THEN j::JSON[] ELSE [] END AS c FROM m))
        SELECT DISTINCT record_id, pos || '/' || child AS parent, pos || '/' || child || '/' || i AS element, CAST(NULL AS VARCHAR) AS bare, el ->> '$.lat' AS lat, el ->> '$.lon' AS lon FROM n WHERE el IS NOT NULL AND json_type(el) <> 'NULL'""",
    "p6_genuses": f"""WITH {_JSON} SELECT record_id, '' AS parent, CAST(pos AS VARCHAR) AS element, CASE WHEN json_type(el) <> 'OBJECT' THEN el ->> '$' END AS bare, CASE WHEN json_type(el -> '$.genus') <> 'OBJECT' THEN el ->> '$.genus' END AS genus,
        el ->> '$.genus.name' AS genus_name, el ->> '$.genus.seen.by' AS seen_by, CASE WHEN json_type(el -> '$.Genus') <> 'OBJECT' THEN el ->> '$.Genus' END AS genus_2, el ->> '$.Genus_Localised' AS localised, CASE WHEN json_type(el -> '$.name') <> 'OBJECT' THEN el ->> '$.name' END AS name
        FROM o WHERE f = 'genuses' UNION SELECT record_id, '', CAST(pos AS VARCHAR), item, NULL, NULL, NULL, NULL, NULL, NULL FROM plain WHERE f = 'genuses'""",
}
