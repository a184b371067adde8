"""Batch forms of the stream operators over the events table: the same functions give the same rows on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import windows
from ..streaming import journal
from .registry import Book
from .tables import table

query = Book()
S = SparkSession


@query("SELECT event_id, coalesce(props->>'$.page', props->>'$.k') AS page, json_valid(props) AS ok, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def event_projection(spark: S, folder: str) -> DataFrame:
    """Two kinds of events with a field out of their JSON."""
    e = table(spark, folder, "events", "event_id", "event_type", "props").where(F.col("event_type").isin("click", "purchase"))
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.page"), F.get_json_object("props", "$.k")).alias("page"), F.try_parse_json("props").isNotNull().alias("ok"), "event_type")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS began, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_days(spark: S, folder: str) -> DataFrame:
    e = table(spark, folder, "events", "ts", "event_type", "value")
    return journal.windowed(e, "ts", "1 day", by=["event_type"], n=F.count(F.lit(1)), total=F.round(F.sum("value"), 4))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
          n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM s)
          SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS events FROM n GROUP BY user_id, i""")
def user_sessions(spark: S, folder: str) -> DataFrame:
    return journal.sessions(table(spark, folder, "events", "user_id", "ts"), "user_id", "ts")


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) FILTER (event_type = 'purchase') AS purchases, max(event_id) AS last_id,
          count(*) FILTER (n > coalesce(m, 0)) AS since_purchase FROM (SELECT *, row_number() OVER w AS n, max(CASE WHEN event_type = 'purchase' THEN rn END) OVER (PARTITION BY user_id) AS m
          FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id""")
def state_fold(spark: S, folder: str) -> DataFrame:
    """The last state of each user and what has happened since the event that resets it."""
    e = table(spark, folder, "events", "user_id", "ts", "event_id", "event_type")
    reset = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("reset"), F.count(F.lit(1)).alias("purchases"))
    joined = e.join(reset, "user_id", "left")
    since = F.col("reset").isNull() | (F.struct("ts", "event_id") > F.col("reset"))
    return joined.groupBy("user_id").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.coalesce(F.max("purchases"), F.lit(0)).alias("purchases"), F.max("event_id").alias("last_id"), F.count_if(since).alias("since_purchase")
    )


@query("SELECT * EXCLUDE (r) FROM (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins(spark: S, folder: str) -> DataFrame:
    e = table(spark, folder, "events", "user_id", "event_type", "event_id", "value", "ts")
    return windows.pick_first(e, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).drop("ts")


@query("""SELECT user_id, event_id, date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) < 300 AS cooling FROM events WHERE event_type = 'click'""")
def cooldowns(spark: S, folder: str) -> DataFrame:
    """Clicks that come within five minutes of the one before."""
    e = table(spark, folder, "events", "user_id", "event_id", "ts", "event_type").where("event_type = 'click'")
    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("user_id", "event_id", (F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(before.cast("timestamp")) < 300).alias("cooling"))


QUERIES, SQL = query.queries, query.sql
