"""A journal of events, as a stream: source, projection, state per commander, idempotent upserts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import file_system, listed, read_text, write_text

# The fields that are read from an event, of any kind; absent ones are null.
EVENT = "timestamp string, event string, SystemAddress long, StarSystem string, StarClass string, StarPos array<double>, BodyID long, BodyName string, BodyCount long, Landable boolean, Signals array<struct<Type:string,Count:long>>, Genuses array<struct<Genus:string>>, Species string, ScanType string, Name string, Latitude double, Longitude double"


def lines(spark: SparkSession, folder: str, *, files_per_batch: int = 1) -> DataFrame:
    """New lines of the files of a folder as a stream, older files first; a file that is rotated in is read whole."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("latestFirst", "false").text(folder)


def events(text: DataFrame, kinds: list[str], schema: str = EVENT) -> DataFrame:
    """The events of some kinds, typed, with their time ``at``. The kind is looked for in the text before it is parsed."""
    wanted = F.get_json_object("value", "$.event").isin(*kinds)
    maybe = F.lit(False)
    for k in kinds:
        maybe = maybe | F.contains("value", F.lit(k))
    parsed = text.where(maybe).where(wanted).select(F.from_json("value", schema).alias("e")).where("e.event IS NOT NULL").select("e.*")
    return parsed.withColumn("at", F.col("timestamp").try_cast("timestamp"))


FOLDED = "commander string, system_address long, arrived timestamp, bodies long, signals long, sampled long, events long, last_event timestamp"
_STATE = "system_address long, arrived long, body_ids array<long>, signals long, samples array<string>, events long, last_event long, last_ids array<long>"
_FIELDS = ["event", "at", "SystemAddress", "BodyID", "ScanType", "Species", "signal_count"]


def _microseconds(t: object) -> int:
    return int(pd.Timestamp(t).value // 1000)


def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state of one commander's system: begun anew by each jump to another system, kept by one to the same.

    Events are taken in the order of their time, jumps before others of the same second; events of other systems are
    passed over. bodies counts different bodies that were scanned, sampled different species that were analysed (an
    Analyse completes it, whatever Log and Sample came before it in the same second), signals the signals told.
    Replays change nothing: an event older than the last one is passed over, and of those at the time of the last one
    the hashes of all their fields are kept, so that each counts once, in whatever batch it comes. Events that arrive
    later than a younger one of an earlier batch are therefore lost; the source gives a journal in its order.
    """
    held = list(state.get) if state.exists else [None, None, [], 0, [], 0, None, []]
    address, arrived, bodies, signals, samples, count, last, ids = held
    bodies, samples, ids = list(bodies), list(samples), set(ids)
    rows = pd.concat(list(batches), ignore_index=True).drop_duplicates(["id"])
    rows["rank"] = (~rows["event"].isin(JUMPS)).astype(int)
    for r in rows.sort_values(["at", "rank", "event", "id"], kind="stable").itertuples(index=False):
        t = _microseconds(r.at)
        if last is not None and (t < last or t == last and int(r.id) in ids):
            continue
        ids = {int(r.id)} if t != last else ids | {int(r.id)}
        last = t
        place = None if pd.isna(r.SystemAddress) else int(r.SystemAddress)
        if r.event in JUMPS:
            if place != address:
                address, arrived, bodies, signals, samples, count = place, t, [], 0, [], 0
                continue
        elif place is not None and place != address:
            continue
        elif r.event == "Scan":
            if not pd.isna(r.BodyID) and int(r.BodyID) not in bodies:
                bodies.append(int(r.BodyID))
        elif r.event in ("FSSBodySignals", "SAASignalsFound"):
            signals += 0 if pd.isna(r.signal_count) else int(r.signal_count)
        elif r.event == "ScanOrganic" and r.ScanType == "Analyse":
            sample = f"{'' if pd.isna(r.BodyID) else int(r.BodyID)}:{r.Species or ''}"
            if sample not in samples:
                samples.append(sample)
        count += 1
    state.update((address, arrived, bodies, signals, samples, count, last, sorted(ids)))
    stamp = lambda v: None if v is None else pd.Timestamp(v, unit="us", tz="UTC")
    yield pd.DataFrame({"commander": [key[0]], "system_address": pd.array([address], "Int64"), "arrived": [stamp(arrived)], "bodies": [len(bodies)], "signals": [signals], "sampled": [len(samples)], "events": [count], "last_event": [stamp(last)]})


#: Events that tell where a commander is.
JUMPS = ("FSDJump", "Location", "CarrierJump")


def folded(typed: DataFrame, commander: str = "commander") -> DataFrame:
    """The state of each commander after each batch, as an update stream."""
    total = F.aggregate(F.coalesce(F.transform("Signals", lambda s: s["Count"]), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, b: a + b)
    slim = typed.select(commander, "event", "at", "SystemAddress", "BodyID", "ScanType", "Species", total.alias("signal_count")).where("at IS NOT NULL")
    marked = slim.withColumn("id", F.xxhash64(*_FIELDS))
    return marked.groupBy(commander).applyInPandasWithState(fold, FOLDED, _STATE, "update", GroupStateTimeout.NoTimeout)


def catch_up(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Give all that has been written so far to a sink, in as many batches as the source makes, and return.

    The tail goes on from the same checkpoint folder, so that each line is given once.
    """
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def sessions(events_: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key with at most that gap between events; events later than the watermark are dropped."""
    return events_.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "events")


def windowed(events_: DataFrame, at: str, width: str, slide: str | None = None, late: str = "1 hour", *, by: list[str], **aggregates) -> DataFrame:
    """Tumbling or sliding windows per key."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return events_.withWatermark(at, late).groupBy(w.alias("w"), *by).agg(*[v.alias(k) for k, v in aggregates.items()]).select(F.col("w.start").alias("began"), *by, *aggregates)


def upsert_into(path: str, merge: Callable[[DataFrame, DataFrame], DataFrame], empty: str, *, key: str = "system", query: str = "main", buckets: int = 16, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that merges each batch into a table kept in buckets of its key.

    Only the buckets that a batch touches are written again; a small file per version then says which folder holds each
    bucket, the batch number of each query, and takes effect as a whole when it appears. A batch that comes again after
    a failure finds its number in the newest version and is skipped. query names the stream: another stream, or one
    with a new checkpoint, must have another name, for its numbers begin anew. The last ``keep`` versions stay for
    readers that still use them; folders that none of these names are deleted.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version, state = _newest(spark, path)
        if state["batches"].get(query, -1) >= number:
            return
        batch = batch.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        new = f"{path}/data/{version + 1:012d}-{uuid.uuid4().hex[:8]}"
        batch.persist()
        try:
            touched = sorted(r[0] for r in batch.select("__bucket").distinct().collect())  # at most as many as there are buckets
            held = _read(spark, path, state, empty, touched)
            merged = merge(held, batch.drop("__bucket")).withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
            merged.write.partitionBy("__bucket").parquet(new)
        finally:
            batch.unpersist()
        folders = state["folders"] | {str(b): f"{new}/__bucket={b}" for b in touched}
        write_text(spark, f"{path}/versions/{version + 1:012d}.json", json.dumps({"folders": folders, "batches": state["batches"] | {query: number}}))
        _prune(spark, path, keep)

    return sink


def _newest(spark: SparkSession, path: str) -> tuple[int, dict]:
    done = [p for p in listed(spark, f"{path}/versions") if p.endswith(".json")]
    if not done:
        return 0, {"folders": {}, "batches": {}}
    return int(done[-1][-17:-5]), json.loads(read_text(spark, done[-1]))


def _read(spark: SparkSession, path: str, state: dict, empty: str, buckets: list[int] | None = None) -> DataFrame:
    fs, jpath = file_system(spark, path)
    wanted = [f for b, f in state["folders"].items() if (buckets is None or int(b) in buckets) and fs.exists(jpath(f))]  # a bucket may have become empty
    return spark.read.schema(empty).parquet(*wanted) if wanted else spark.createDataFrame([], empty)


def _prune(spark: SparkSession, path: str, keep: int) -> None:
    fs, jpath = file_system(spark, path)
    versions = [p for p in listed(spark, f"{path}/versions") if p.endswith(".json")]
    used = {f.rsplit("/", 2)[-2] for p in versions[-keep:] for f in json.loads(read_text(spark, p))["folders"].values()}
    for p in versions[:-keep]:
        fs.delete(jpath(p), False)
    for folder in listed(spark, f"{path}/data"):
        if folder.rsplit("/", 1)[-1] not in used:
            fs.delete(jpath(folder), True)


def current(spark: SparkSession, path: str, empty: str) -> DataFrame:
    """The newest version of a table that upsert_into() keeps."""
    return _read(spark, path, _newest(spark, path)[1], empty)


def seen_merge(held: DataFrame, batch: DataFrame) -> DataFrame:
    """Names that were seen: the new non-null value of a column wins, what is held stays, first time of all is kept."""
    new = batch.groupBy("system").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in ("star_class", "system_id")], F.min("at").alias("first_seen"))
    both = held.alias("h").join(new.alias("n"), "system", "full")
    return both.select("system", *[F.coalesce(f"n.{c}", f"h.{c}").alias(c) for c in ("star_class", "system_id")], F.least("h.first_seen", "n.first_seen").alias("first_seen"))


SEEN = "system string, star_class string, system_id long, first_seen timestamp"
