from pyspark.sql import functions as F

from astrolode.llm import refine

CASES = [
    (1, "DZ-1 23", "DZ", "-1 23"), (2, " dz－１/23.", "dz", "–１_23"), (3, "-1 23 DZ", " DZ.", "DZ-1 23"), (4, "DZ+1 23", "DZ", "+1 23"), (5, "DZ 1 23", "DZ", "1 23"),
    (6, "ORC 12 A", "ORC", "12 A"), (7, "orc12a", "orc", "ORC 12A"), (8, "ORC 12 B", "ORC", "12 B"), (9, "ORC 12", "ORC", "12"), (10, "VKS 12", "VKS", "12"), (11, "12 VKS", "vks", "12​"),
    (12, "TLX 1-23-4", "TLX", "1-23-4"), (13, "TLX 12-3-4", "TLX", "12-3-4"), (14, "TLX 1 23 4", "TLX", "TLX(1.23.4)"), (15, None, "VKS", "VKS 12"), (16, "VKS 12", None, None), (17, None, None, None), (18, "", " ", "—"), (19, "VKS 21", "VKS", "21"),
    (10, "VKS 12", "VKS", "12"),
]


def classes(spark, cases):
    df = spark.createDataFrame(cases, "entry_id long, system string, type string, designation string").withColumn("record", F.lit("clash"))
    plain = refine.plain_writing(df, ["system", "type", "designation"])
    invariants, exact = refine.designation_key("type", ["system", "designation"])
    out = {}
    for r in refine.refined_classes(plain, "entry_id", invariants, exact, columns=["system", "type", "designation"]).collect():
        out.setdefault(r.first_key, [r.copies]).append(r.entry_id)
    return {first: (v[0], sorted(v[1:])) for first, v in out.items()}


def test_formatting_collapses_and_content_stays(spark):
    assert classes(spark, CASES) == {1: (3, [1, 2, 3]), 6: (2, [6, 7]), 10: (4, [10, 11, 15, 16]), 12: (2, [12, 14])}


def test_a_hot_record_and_no_rows(spark):
    many = [(i, "VKS 7" + " " * (i % 5), "VKS", "7") for i in range(500)]
    assert classes(spark, many) == {0: (500, list(range(500)))}
    assert classes(spark, many[:1]) == {} and classes(spark, many[:0]) == {}
