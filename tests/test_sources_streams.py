import datetime as dt
import gzip
import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from astrolode.sources import feeds, ledger, sinks
from astrolode.streaming import journal


def test_readers(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write('{"id": 1, "c": {"x": 1.5}, "s": [{"name": "n"}]}\n{broken\n{"id": 2}\n')
    schema = "id long, c struct<x:double>, s array<struct<name:string>>"
    assert rows(feeds.json_lines(spark, str(tmp_path / "a.json.gz"), schema).selectExpr("id", "c.x", "s[0].name")) == sorted([(1, 1.5, "n"), (2, None, None)], key=repr)
    assert feeds.json_lines(spark, str(tmp_path / "a.json.gz"), "id long", bad="raw").where("raw IS NOT NULL").count() == 1
    (tmp_path / "b.json").write_text('[\n{"id": 1, "t": "a,"},\n{"id": 2, "t": "]"},\nnull\n]\n')
    assert rows(feeds.json_array_lines(spark, str(tmp_path / "b.json"), "id long, t string")) == [(1, "a,"), (2, "]")]
    doc = [{"id": 1, "stations": [{"n": "a"}], "bodies": [{"stations": [{"n": "b"}, {"n": "c"}]}, {"stations": None}]}, {"id": 2}]
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    d = feeds.json_document(spark, str(tmp_path / "c.json"), "id long, stations array<struct<n:string>>, bodies array<struct<stations:array<struct<n:string>>>>")
    assert rows(feeds.stations_of(d, ["stations"], [("bodies", "stations")], keep=["id"], item="s").selectExpr("id", "s.n")) == [(1, "a"), (1, "b"), (1, "c")]
    (tmp_path / "d.csv").write_text('a,b,c\n1,"x, y",2020-01-02\nbad, ,\n')
    assert rows(feeds.csv_texts(spark, str(tmp_path / "d.csv"), {"a": "int AS n", "b": "string", "c": "date"})) == sorted([(1, "x, y", dt.date(2020, 1, 2)), (None, None, None)], key=repr)
    (tmp_path / "e.tsv").write_text('# note\nk\tv\n"q\t1.5\n# more\nz\t\n')
    assert rows(feeds.tsv(spark, str(tmp_path / "e.tsv"), {"k": "string", "v": "double"})) == sorted([('"q', 1.5), ("z", None)], key=repr)
    df = spark.range(100)
    assert rows(feeds.sample_rows(df, 5, ["id"])) == rows(feeds.sample_rows(df.repartition(7), 5, ["id"])) and feeds.reconcile(df, "id", 103)["missing"] == 3


def test_ledger_and_sinks(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n, tzinfo=dt.UTC)
    m = ledger.Manifest(spark, str(tmp_path))
    spark.range(3).write.parquet(str(tmp_path / "tables/full"))
    m.add("bodies", "old", "u", 1, 1, False, day(1))
    m.add("bodies", "full", "u", 2, 3, True, day(2))
    assert m.bind("bodies", str(tmp_path / "tables")).count() == 3 and spark.table("bodies").count() == 3
    with pytest.raises(LookupError):
        m.bind("none", str(tmp_path))
    w = ["1day", "7days", "1month", "full"]
    assert [ledger.window_for_gap(w, g) for g in (0.5, 3, 8, 99)] == ["1day", "7days", "1month", "full"] and ledger.window_within(w, 10) == "7days"
    assert ledger.gap_in_days(spark.createDataFrame([(day(1),)], "t timestamp"), "t", day(4)) == 3.0
    (tmp_path / "f").write_text("hello")
    state = str(tmp_path / "f.state")
    assert ledger.needs_load(str(tmp_path / "f"), state)
    ledger.note_load(str(tmp_path / "f"), state)
    assert not ledger.needs_load(str(tmp_path / "f"), state)
    for run, sec in (("r1", 10.0), ("r2", 30.0)):
        log = ledger.RunLog(spark, str(tmp_path), "load", run)
        log.note("merge", "t", inserted=1, seconds=sec, at=day(1 if run == "r1" else 2))
        log.close()
    r = ledger.RunLog.report(spark, str(tmp_path)).first()
    assert (r.run_id, r.seconds, r.usual, r.runs) == ("r2", 30.0, 20.0, 2)

    path = str(tmp_path / "swapped")
    assert sinks.swap_in(spark.range(5), path) == 5 and sinks.swap_in(spark.range(7), path, expected=7) == 7
    with pytest.raises(ValueError):
        sinks.swap_in(spark.range(2), path, expected=3)
    assert spark.read.parquet(path).count() == 7
    sinks.ordered_file(spark.range(9).orderBy(F.desc("id")), str(tmp_path / "o"), ["id"])
    assert [x.id for x in spark.read.parquet(str(tmp_path / "o")).collect()] == list(range(9))
    assert sinks.same_content(spark.range(9), spark.range(9).repartition(3)) and not sinks.same_content(spark.range(9), spark.range(8))
    assert sinks.clustered(spark.range(100), ["id"], 4).count() == 100
    spark.range(1).createOrReplaceTempView("seen_view")
    assert sinks.catalogue_of(spark).where("table_name = 'seen_view'").count() == 1


def line(at, event, **more):
    return json.dumps({"timestamp": f"2024-05-01T10:00:{at:02d}Z", "event": event, **more})


def run(spark, df, mode, folder, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", folder).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_journal_state(spark, tmp_path):
    src = tmp_path / "j"
    src.mkdir()
    (src / "1.log").write_text("\n".join([line(1, "FSDJump", SystemAddress=7), line(2, "Scan", SystemAddress=7, BodyID=1), line(3, "Scan", SystemAddress=9, BodyID=1), "broken", line(4, "Music")]) + "\n")
    (src / "2.log").write_text("\n".join([line(2, "Scan", SystemAddress=7, BodyID=1), line(5, "FSSBodySignals", SystemAddress=7, BodyID=1, Signals=[{"Type": "bio", "Count": 3}]), line(6, "ScanOrganic", SystemAddress=7, ScanType="Analyse"), line(7, "FSDJump", SystemAddress=8), line(8, "Scan", SystemAddress=8, BodyID=2)]) + "\n")
    os.utime(src / "1.log", (1_700_000_000, 1_700_000_000))
    kinds = ["FSDJump", "Scan", "FSSBodySignals", "ScanOrganic"]
    typed = journal.events(journal.lines(spark, str(src)), kinds).withColumn("commander", F.lit("c"))
    out = run(spark, journal.folded(typed), "update", str(tmp_path / "ck"), "folded")
    last = out.orderBy(F.desc("last_event")).first()
    assert (last.system_address, last.bodies, last.signals, last.sampled) == (8, 1, 0, 0)
    first = out.orderBy("last_event").first()
    assert (first.system_address, first.bodies) == (7, 1)


def test_upserts_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "seen")
    sink = journal.upsert_into(path, journal.seen_merge, journal.SEEN)
    t = dt.datetime(2024, 1, 1)
    b0 = spark.createDataFrame([("Sol", "G", None, t), ("Sol", None, 5, t + dt.timedelta(1))], "system string, star_class string, system_id long, at timestamp")
    b1 = spark.createDataFrame([("Sol", None, 6, t - dt.timedelta(1)), ("Vega", None, None, t)], b0.schema)
    for batch, number in ((b0, 0), (b1, 1), (b1, 1), (b0, 0)):
        sink(batch, number)
    want = [("Sol", "G", 6, t - dt.timedelta(1)), ("Vega", None, None, t)]
    assert rows(journal.current(spark, path, journal.SEEN)) == sorted(want, key=repr)


def test_sessions_on_a_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    data = [(1, t), (1, t + dt.timedelta(minutes=10)), (1, t + dt.timedelta(hours=2)), (2, t + dt.timedelta(days=2))]
    spark.createDataFrame(data, "k int, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, at timestamp").parquet(str(tmp_path / "in"))
    got = run(spark, journal.sessions(stream, "k", "at"), "append", str(tmp_path / "ck"), "sess")
    assert sorted((r.k, r.events) for r in got.collect()) == [(1, 1), (1, 2)]


def test_a_replayed_event_counts_once(spark, tmp_path):
    src = tmp_path / "j"
    src.mkdir()
    # the last event of the first file comes again in the second, and a Log and an Analyse stand in one second
    (src / "1.log").write_text("\n".join([line(1, "FSDJump", SystemAddress=7), line(2, "Scan", SystemAddress=7, BodyID=1)]) + "\n")
    (src / "2.log").write_text("\n".join([line(1, "FSDJump", SystemAddress=7), line(2, "Scan", SystemAddress=7, BodyID=1), line(2, "Scan", SystemAddress=7, BodyID=2), line(3, "ScanOrganic", SystemAddress=7, BodyID=1, ScanType="Log", Species="s"), line(3, "ScanOrganic", SystemAddress=7, BodyID=1, ScanType="Analyse", Species="s")]) + "\n")
    os.utime(src / "1.log", (1_700_000_000, 1_700_000_000))
    kinds = ["FSDJump", "Scan", "ScanOrganic"]
    typed = journal.events(journal.lines(spark, str(src)), kinds).withColumn("commander", F.lit("c"))
    out = run(spark, journal.folded(typed), "update", str(tmp_path / "ck"), "replayed").orderBy("last_event").collect()
    assert [(r.bodies, r.sampled, r.events) for r in out] == [(1, 0, 1), (2, 1, 4)]


def test_upserts_rewrite_what_they_touch_and_keep_few_versions(spark, tmp_path):
    path, t = str(tmp_path / "seen"), dt.datetime(2024, 1, 1)
    rows_of = lambda names: spark.createDataFrame([(n, "G", None, t) for n in names], "system string, star_class string, system_id long, at timestamp")
    first, second = (journal.upsert_into(path, journal.seen_merge, journal.SEEN, query=q) for q in ("a", "b"))
    for i in range(6):
        first(rows_of([f"s{i}", "Sol"]), i)
    second(rows_of(["new"]), 0)  # a stream with a new checkpoint begins at 0 and is not skipped
    second(rows_of(["lost?"]), 0)  # its replay is
    assert sorted(r.system for r in journal.current(spark, path, journal.SEEN).collect()) == ["Sol", "new", *[f"s{i}" for i in range(6)]]
    assert len(os.listdir(f"{path}/versions")) <= 4 and len(os.listdir(f"{path}/data")) <= 9  # with the files of checksums


def test_catch_up_then_tail(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/1.log").write_text("a\nb\n")
    got = []
    for more in (None, "c\n"):
        if more:
            (tmp_path / "j/2.log").write_text(more)
        journal.catch_up(journal.lines(spark, str(tmp_path / "j")), lambda b, n: got.extend(r.value for r in b.collect()), str(tmp_path / "ck"))
    assert sorted(got) == ["a", "b", "c"]


def test_inferred_resumed_attached_copied(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "c": {"x": 1.5}}\n{"id": 2, "t": "s"}\n')
    assert rows(feeds.json_inferred(spark, str(tmp_path / "a.json")).selectExpr("id", "c.x", "t")) == sorted([(1, 1.5, None), (2, None, "s")], key=repr)
    (tmp_path / "b.csv").write_text("n,d,t\n1,2.5,x\n2,,y\n")
    assert feeds.csv_inferred(spark, str(tmp_path / "b.csv")).dtypes == [("n", "int"), ("d", "double"), ("t", "string")]
    (tmp_path / "dump.json").write_text("[\n" + "".join(f'{{"id": {i}}},\n' for i in range(10)) + "]\n")
    loaded = []
    while n := feeds.resumed(spark, str(tmp_path / "dump.json"), "id long", str(tmp_path / "out"), rows=5):
        loaded.append(n)
        os.makedirs(tmp_path / "out/parts/rows-broken-000000000099", exist_ok=True)  # as a part that failed leaves it
    assert loaded == [5, 5, 2] and sorted(r.id for r in spark.read.parquet(str(tmp_path / "out/parts/*")).collect()) == list(range(10))
    df = spark.range(100).select("id", (F.col("id") % 7).cast("string").alias("t")).unionByName(spark.createDataFrame([(None, "n")], "id long, t string"))
    report = sinks.copy_in_batches(df, str(tmp_path / "copy"), "id", 4)
    assert rows(report.select("column", "same")) == [("id", True), ("t", True)] and spark.read.parquet(str(tmp_path / "copy")).count() == 101
    df.write.parquet(str(tmp_path / "tables/things.parquet"))
    assert sinks.attach(spark, str(tmp_path / "tables"), "other") == ["other_things"] and spark.table("other_things").count() == 101


def test_fingerprints_through_the_session(spark, tmp_path):
    feed, state = tmp_path / "f.txt", f"file://{tmp_path}/f.state"
    feed.write_text("a\nb\n")
    assert ledger.needs_load(f"file://{feed}", state, spark=spark)
    ledger.note_load(f"file://{feed}", state, spark)
    assert not ledger.needs_load(f"file://{feed}", state, spark=spark)
    at = os.stat(feed).st_mtime
    feed.write_text("a\nc\n")
    os.utime(feed, (at, at))
    assert ledger.needs_load(f"file://{feed}", state, spark=spark)
