"""Queries p3, p4, p7, p8 and p9, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table
from ..storage import Scratch
from . import abuse, groups, mixing, refine, tokens


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """system_name and group_id, the smallest name of its group."""
    pairs = table(spark, folder, "system_catalog_alias", "system_a", "system_b")
    return groups.linked_groups(pairs, "system_a", "system_b").withColumnRenamed("name", "system_name")


def _copies(spark: SparkSession, folder: str) -> DataFrame:
    texts = ["system", "type", "designation"]
    entries = refine.plain_writing(table(spark, folder, "system_catalog", "entry_id", *texts), texts)
    return refine.refined_classes(entries, "entry_id", *refine.designation_key("type", ["system", "designation"]), columns=texts)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """first_id, copy_id: the smallest entry of each record with each of its copies."""
    return _copies(spark, folder).where("entry_id <> first_key").select(F.col("first_key").alias("first_id"), F.col("entry_id").alias("copy_id"))


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    """entry_id and copies: one row per record, under its smallest entry, with the number of entries it had."""
    entries = table(spark, folder, "system_catalog", "entry_id").where("entry_id IS NOT NULL").distinct()
    groups_ = _copies(spark, folder)
    alone = entries.join(groups_.select("entry_id"), "entry_id", "left_anti").select("entry_id", F.lit(1).cast("long").alias("copies"))
    return alone.unionByName(groups_.where("entry_id = first_key").select("entry_id", "copies"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and ids by byte_bpe_50k."""
    return tokens.encode(table(spark, folder, "documents", "doc_id", "text"))


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and text, decoded from the ids of every document."""
    return tokens.decode(p7_ids(spark, folder))


def p7_tokens_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and tokens of each source."""
    sized = tokens.count(table(spark, folder, "documents", "source", "text"))
    return sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("n_tokens"))


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    return Scratch(spark, "sized").write(tokens.count(table(spark, folder, "documents", "doc_id", "source", "text")))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """mix, source, doc_id, n_tokens, copies."""
    return mixing.draw(_sized(spark, folder), table(spark, folder, "mix_target"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of each mix and source."""
    sized, targets = _sized(spark, folder), table(spark, folder, "mix_target")
    return mixing.shares(mixing.draw(sized, targets), sized, targets)


def _judged(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = abuse.fit(docs, table(spark, folder, "doc_label"))
    return abuse.score(docs.select(*columns, "text"), model)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id of the documents with an abusive passage."""
    return _judged(spark, folder, "doc_id").where("score > 0").select("doc_id")


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and score, from 0 to 1; above 0.5 a document holds an abusive passage."""
    return _judged(spark, folder, "doc_id").select("doc_id", F.round(1 / (1 + F.exp(-F.col("score"))), 6).alias("score"))


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each source, those with an abusive passage, and their rate."""
    judged = _judged(spark, folder, "source").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("score") > 0).alias("abusive"))
    return judged.withColumn("rate", F.round(F.col("abusive") / F.col("documents"), 6))


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p4_records": p4_records, "p7_ids": p7_ids, "p7_round_trip": p7_round_trip, "p7_tokens_by_source": p7_tokens_by_source, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}

_CANON = """
    w AS (SELECT entry_id, regexp_replace(lower(type), '[^a-z]', '', 'g') AS t,
                 replace(replace(replace(replace(translate(lower(designation), '０１２３４５６７８９＋－', '0123456789+-'), '–', '-'), '−', '-'), '—', '-'), '​', '') AS x FROM system_catalog),
    k AS (SELECT entry_id, t || ':' || CASE WHEN t = 'dz' THEN regexp_extract(x, '^[^0-9]*?([-+])\\s*[0-9]', 1) ELSE '' END
                 || array_to_string(list_filter(regexp_extract_all(x, '[a-z]+|[0-9]+'), lambda v: v <> t), ' ') AS k FROM w)"""

SQL = {
    "p3_found": """
        WITH RECURSIVE e AS (SELECT system_a AS a, system_b AS b FROM system_catalog_alias WHERE system_a <> '' AND system_b <> ''),
        both_ways AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)),
        n AS (SELECT DISTINCT name FROM (SELECT system_a AS name FROM system_catalog_alias UNION ALL SELECT system_b FROM system_catalog_alias) WHERE name <> ''),
        reach(name, other) AS (SELECT name, name FROM n UNION SELECT r.name, b.b FROM reach r JOIN both_ways b ON r.other = b.a)
        SELECT name AS system_name, min(other) AS group_id FROM reach GROUP BY name""",
    "p4_found": f"""
        WITH {_CANON}
        SELECT f.first_id, k.entry_id AS copy_id FROM k JOIN (SELECT k, min(entry_id) AS first_id FROM k GROUP BY k) f USING (k) WHERE k.entry_id <> f.first_id""",
    "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p4_records": f"WITH {_CANON} SELECT min(entry_id) AS entry_id, count(*) AS copies FROM k GROUP BY k",
}
