import datetime as dt
import os

from conftest import rows
from pyspark.sql import functions as F

from astrolode.functions import floats, sql_functions
from astrolode.operators.graphs import components
from astrolode.streaming import carriers


def test_floats(spark):
    near = float(__import__("numpy").nextafter(__import__("numpy").float32(270), __import__("numpy").float32(0)))
    df = spark.createDataFrame([(270.0, 0), (near, 1), (100.0, 2)], "t double, i int")
    got = df.select("i", floats.touches(floats.ladder("t", F.lit(1000.0)), [270.0], F.lit(True)), floats.touches(floats.ladder("t", F.lit(1000.0)), [270.0]))
    assert rows(got) == [(0, "ON", "ON"), (1, "ONE_OFF", "OFF"), (2, "OFF", "OFF")]
    one = df.limit(1).select(floats.ladder(F.lit(0.0), F.lit(70.0)).alias("a"), floats.ladder(F.lit(0.0), F.lit(7.0), least=30.0).alias("b"), floats.flag(F.lit(10), 1).alias("c"), floats.flag(F.lit(10), 2).alias("d"))
    r = one.first()
    assert list(r.a) == [0, 10, 20, 30, 40, 50, 60] and list(r.b) == [30 * k for k in range(7)] and r.c and not r.d
    cost = spark.createDataFrame([([80.0, 80.0],), ([],)], "d array<double>").select(floats.folded_cost("d", 5, 1 / 8, 1000, 25000))
    assert sorted(x[0] for x in cost.collect()) == [0.0, 30.0]


def test_sql_functions(spark):
    assert "laplace" in sql_functions.register(spark)
    assert spark.sql("SELECT laplace(1, 2), mass_code_of(15), distance3(0, 0, 0, 0, 3, 4), shrunk_ratio(0, 80)").first()[:] == (0.5, "h", 5.0, 0.2)


def test_components(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3), (50, 60)]
    got = dict(rows(components(spark.createDataFrame(e, "a int, b int"), a="a", b="b")))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 50: 50, 60: 50}
    assert components(spark.createDataFrame([], "a int, b int"), a="a", b="b").count() == 0


def test_carriers(spark, tmp_path):
    t = dt.datetime(2024, 5, 1, 12)
    m = lambda n: t + dt.timedelta(minutes=n)
    schema = "carrier long, event string, at timestamp, place string, departs timestamp"
    batches = [
        [(1, "CarrierLocation", m(0), "A", None), (1, "CarrierJumpRequest", m(1), "B", m(16))],
        [(1, "CarrierJump", m(16), "B", None), (2, "CarrierJumpRequest", m(16), "C", m(31)), (2, "CarrierJumpCancelled", m(17), None, None), (1, "CarrierJumpRequest", m(2), "late", None)],
        [(3, "CarrierLocation", m(90), "Z", None)],
        [(3, "CarrierLocation", m(91), "Z", None)],
    ]
    src = tmp_path / "in"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(src))
        for p in src.glob("*.parquet"):
            if p.stat().st_mtime > 1_700_000_100:
                os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = carriers.followed(stream).writeStream.outputMode("update").format("memory").queryName("carriers").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    seen = [(r.carrier, r.place, r.pending, r.phase) for r in spark.table("carriers").collect()]
    assert seen[0] == (1, "A", "B", "pending") and (1, "B", None, "cooling") in seen and (2, None, None, "ready") in seen
    assert (1, "B", None, "ready") in seen  # the timer fired once the watermark had passed
