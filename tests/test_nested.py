import json
import math

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from astrolode.operators.nested import flatten, tables
from astrolode.plans.biology import SHAPES
from astrolode.sources.json_events import ARRAY, OBJECT, Malformed, events

CASES = [
    ("genuses", None, []), ("genuses", "  ", []), ("genuses", "null", []), ("genuses", "[]", []), ("genuses", '{"genuses": []}', []), ("genuses", '{"genuses": null}', []), ("genuses", '""', []),
    ("genuses", "{}", [(0, -1, "")]), ("genuses", '[null, "a", {"Genus": null}]', [(1, -1, "a"), (2, -1, "")]),
    ("genuses", '{"genus": {"name": "g", "seen": {"by": "x"}}, "species": {"items": ["s", null, {"name": "t", "samples": [{"lat": 1.5}]}]}}', [(0, -1, "g"), (0, 0, "s"), (0, 2, "t")]),
    ("genuses", '[{"name": "g", "species": {"name": "only"}}, {"name": "h", "species": {}}]', [(0, -1, "g"), (0, 0, "only"), (1, -1, "h"), (1, 0, "")]),
    ("genuses", json.dumps(json.dumps({"genuses": [{"genus": "g", "species": []}]})), [(0, -1, "g")]),
    ("genuses", '[{"genus": "g"', [(-1, -1, "unreadable")]), ("genuses", '[{"genus" "g"}]', [(-1, -1, "unreadable")]), ("genuses", '{"a": 1}]', [(-1, -1, "unreadable")]), ("genuses", '"[1"', [(-1, -1, "unreadable")]),
    ("ring_types", "Icy , Rocky", [(0, -1, "Icy"), (1, -1, "Rocky")]), ("ring_types", '{"rings": {"type": "Icy", "name": "A", "signals": [{"type": "Low", "count": 2}, null]}}', [(0, -1, "Icy"), (0, 0, "Low")]),
    ("ring_types", '[{"name": "A"}, {"type": "Icy", "signals": {"hotspots": [{"type": "Void"}]}}]', [(0, -1, ""), (1, -1, "Icy"), (1, 0, "Void")]), ("ring_types", '"Icy,Rocky"', [(0, -1, "Icy"), (1, -1, "Rocky")]),
    ("ring_types", '["Icy", "Icy"]', [(0, -1, "Icy"), (1, -1, "Icy")]), ("ring_types", '{"rings": [], "type": "x"}', []),
]


def test_shapes(spark):
    data = [(i, f, t) for i, (f, t, _) in enumerate(CASES)] * 2 + [(None, "genuses", '["a"]')]
    df = spark.createDataFrame(data, "key long, field string, text string").withColumn("leaf", F.lit("clash"))
    want = sorted(((i, f, *r) for i, (f, _, e) in enumerate(CASES) for r in e), key=repr)
    assert rows(flatten(df, SHAPES)) == want


def test_tables_of_any_depth(spark):
    record = {"genus": "g", "seen": {"by": "x", "n": 2}, "species": [{"name": "s", "samples": [{"lat": 1.5, "tags": ["a", None, "b"]}, {}]}, None, "t"]}
    df = spark.createDataFrame([(1, "genuses", json.dumps([record, record])), (1, "genuses", json.dumps([record, record])), (2, "genuses", json.dumps({"genuses": [{"genus": "h"}]})), (3, "genuses", "[broken")], "key long, field string, text string")
    got = {at: t for (_, at), t in tables(df, SHAPES).items()}
    assert sorted(got) == ["genuses", "genuses.species", "genuses.species.samples", "genuses.species.samples.tags"]
    assert rows(got["genuses"].select("key", "parent", "ordinals", "genus", "`seen.by`", "`seen.n`", "others")) == [(1, [], [0], "g", "x", "2", None), (1, [], [1], "g", "x", "2", None), (2, [], [0], "h", None, None, None)]
    assert rows(got["genuses.species"].where("ordinals[0] = 1").select("key", "parent", "ordinals", "bare", "name")) == [(1, [1], [1, 0], None, "s"), (1, [1], [1, 2], "t", None)]
    assert rows(got["genuses.species.samples"].where("parent = array(0, 0)").select("ordinals", "lat")) == [([0, 0, 0], "1.5"), ([0, 0, 1], None)]
    assert rows(got["genuses.species.samples.tags"].where("parent = array(0, 0, 0)").select("ordinals", "bare")) == [([0, 0, 0, 0], "a"), ([0, 0, 0, 2], "b")]
    # every child meets its parent
    a, b = got["genuses.species.samples"], got["genuses.species"].select("key", "version", F.col("ordinals").alias("parent"))
    assert a.join(b, ["key", "version", "parent"], "left_anti").count() == 0
    few = tables(df, SHAPES, columns={("genuses", "genuses"): ["genus"]})["genuses", "genuses"]
    assert rows(few.where("key = 1 AND ordinals[0] = 0").select("genus", "others")) == [("g", {"seen.by": "x", "seen.n": "2"})]
    assert tables(df.limit(0), SHAPES) == {}
    odd = spark.createDataFrame([(1, "genuses", '[{"key": "a", "Genus": "b", "genus": "c", "bare": "d"}]')], "key long, field string, text string")
    assert [(c, v) for c, v in tables(odd, SHAPES)["genuses", "genuses"].first().asDict().items() if isinstance(v, str)] == [("Genus", "b"), ("bare~2", "d"), ("genus~2", "c"), ("key~2", "a")]


def test_two_texts_of_one_key_and_depth(spark):
    deep = "[" * 5000 + "]" * 5000
    df = spark.createDataFrame([(1, "genuses", '["a"]'), (1, "genuses", '["b"]'), (2, "genuses", deep)], "key long, field string, text string")
    assert rows(flatten(df, SHAPES)) == [(1, "genuses", 0, -1, "a"), (1, "genuses", 0, -1, "b")]
    assert flatten(df.limit(0), SHAPES).count() == 0


def leaves(v, path=()):
    yield (path, OBJECT if isinstance(v, dict) else ARRAY if isinstance(v, list) else v if v is None or isinstance(v, str) else (json.dumps(v),))
    for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
        yield from leaves(x, (*path, k))


trees = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text(max_size=5), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=3), c, max_size=4), max_leaves=15)


@settings(max_examples=150, deadline=None)
@given(trees, st.booleans())
def test_events_tell_the_whole_document(tree, wide):
    assert list(events(json.dumps(tree, indent=2 if wide else None))) == list(leaves(tree))


@settings(max_examples=150, deadline=None)
@given(st.text('[]{}",:1ae nul-.', max_size=14))
def test_malformed_as_a_strict_parser_says(text):
    try:
        json.loads(text, parse_constant=lambda x: math.nan if 0 else (_ for _ in ()).throw(ValueError))
    except ValueError:
        with pytest.raises(Malformed):
            list(events(text))
    else:
        list(events(text))
