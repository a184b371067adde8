import random

import pytest

from astrolode.llm.groups import linked_groups


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def brute(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x:
                root(x)
        if a and b:
            ra, rb = root(a), root(b)
            up[max(ra, rb, key=str.encode)] = min(ra, rb, key=str.encode)
    return sorted((x, root(x)) for x in list(up))


def shapes(rng):
    name = lambda kind, i: f"{kind}{i:03d}"
    out = [(name("path", i), name("path", i + 1)) for i in range(70)]
    out += [(name("ring", i), name("ring", (i + 1) % 37)) for i in range(37)]
    out += [("tri1", "tri2"), ("tri2", "tri3"), ("tri3", "tri1"), ("two1", "two2"), ("two2", "two1")]
    out += [("hub", name("leaf", i)) for i in range(90)]
    out += [(name("dense", i), name("dense", rng.randrange(30))) for i in range(30) for _ in range(5)]
    out += [(name("k", i), name("k", j)) for i in range(6) for j in range(i)]
    out += [(name("comb", i), name("comb", i + 1)) for i in range(25)] + [(name("comb", i), name("tooth", i)) for i in range(25)]
    out += [("ünder", "zone"), ("Zone", "zone"), ("self", "self"), ("alone", None), (None, "other"), ("", "x"), (None, None), ("", "")]
    out += [("lobe", "lobe2"), ("lobe2", "lobe3"), ("lobe3", "lobe"), ("lobe", "lobe4"), ("lobe4", "lobe5"), ("lobe5", "lobe")]
    return out + rng.sample(out, 40) + [(b, a) for a, b in rng.sample(out, 40)]


def test_equals_union_find(spark):
    rng = random.Random(8)
    pairs = shapes(rng)
    df = spark.createDataFrame([(a, b, 1) for a, b in pairs], "a string, b string, code int")
    for edges in (1 << 20, 0):  # the core is solved by one task, or contracted to nothing
        assert rows(linked_groups(df, "a", "b", core_edges=edges)) == brute(pairs)


@pytest.mark.parametrize("pairs", [[], [(None, None)], [("a", "a")], [("b", "a")]])
def test_small(spark, pairs):
    assert rows(linked_groups(spark.createDataFrame(pairs, "a string, b string"), "a", "b")) == brute(pairs)
