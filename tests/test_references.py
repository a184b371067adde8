import datetime as dt
import random

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from astrolode.functions.bitmaps import Bitmap
from astrolode.operators.references import dangling

REFS = "child_field string, child_id long, target string, key long, at timestamp"
PARENTS = "target string, key long, live_from timestamp, live_to timestamp"


def brute(refs, parents):
    out = set()
    for field, child, target, key, at in refs:
        if key is None:
            continue
        own = [(a, b) for t, k, a, b in parents if t == target and k == key]
        if at is not None and any(a is not None and a <= at and (b is None or b > at) for a, b in own):
            continue
        late = at is not None and own and all(a is not None and a > at for a, b in own)
        out.add((field, child, at and at.strftime("%Y-%m"), "missing" if not own else "late" if late else "deleted"))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    parents = []
    for _ in range(300):
        a = rng.randrange(900)
        parents.append((rng.choice("ab"), rng.choice([*range(60), None]), None if rng.random() < 0.05 else day(a), None if rng.random() < 0.4 else day(a + rng.randrange(1, 300))))
    refs = [(f"{t}.f", i % 700, t, rng.choice([*range(80), 1, 1, 1, None]), None if rng.random() < 0.03 else day(rng.randrange(1000))) for i in range(900) for t in [rng.choice("ab")]]
    got = dangling(spark.createDataFrame(refs, REFS).withColumn("range", F.lit(1)), spark.createDataFrame(parents, PARENTS), range_rows=200)
    assert rows(got) == brute(refs, parents)


def test_ends_of_a_span(spark):
    t = [dt.datetime(2021, 5, d) for d in (1, 10, 20)]
    parents = [("p", 1, t[0], t[1]), ("p", 1, t[2], None)]
    refs = [("f", i, "p", 1, at) for i, at in enumerate([t[0], t[1], dt.datetime(2021, 5, 15), t[2], dt.datetime(2021, 4, 30)])]
    assert rows(dangling(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))) == [("f", 1, "2021-05", "deleted"), ("f", 2, "2021-05", "deleted"), ("f", 4, "2021-04", "late")]


def test_empty_tables(spark):
    none, refs = spark.createDataFrame([], PARENTS), spark.createDataFrame([("f", 1, "p", 7, dt.datetime(2021, 5, 1))], REFS)
    assert rows(dangling(refs, none)) == [("f", 1, "2021-05", "missing")]
    assert rows(dangling(refs.limit(0), none)) == []


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 200_000)), st.sets(st.integers(0, 200_000)), st.booleans())
def test_bitmaps(a, b, dense):
    if dense:
        a |= set(range(1000, 9000))
        b |= set(range(3000, 70_000, 2))
    x, y = Bitmap.of(list(a)), Bitmap.of(list(b))
    assert x.codes().tolist() == sorted(a) and len(x) == len(a)
    assert x.and_not(y).codes().tolist() == sorted(a - b)
