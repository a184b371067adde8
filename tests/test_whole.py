"""Operators and queries that must do the whole job, against brute force."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows

from astrolode.operators import joins
from astrolode.plans import catalogue, model
from astrolode.sources import ledger

XYZ = ["x", "y", "z"]


def voted(p, known, k=5):
    near = sorted((sum((a - b) ** 2 for a, b in zip(p[1:4], q[1:4], strict=True)) ** 0.5, q[4]) for q in known)[:k]
    votes = Counter(lab for _, lab in near)
    return min(votes, key=lambda v: (-votes[v], v))


@pytest.mark.parametrize("held", [150, 3, 0])
def test_votes_of_the_nearest_however_far(spark, held):
    rng = random.Random(3)
    # a dense heap, a sparse halo, and rows far from all of them
    at = lambda i, w: (i, *[round(rng.uniform(-w, w), 2) for _ in range(3)])
    known = [(*at(i, 30 if i % 2 else 3000), i % 4) for i in range(held)]
    asked = [at(1000 + i, 40 if i % 3 else 4000) for i in range(60)] + [(2000, 90000.0, 0.0, 0.0)]
    a = spark.createDataFrame([*asked, (3000, None, 0.0, 0.0), (3001, float("nan"), 0.0, 0.0)], "id int, x double, y double, z double")
    b = spark.createDataFrame([*known, (9999, 0.0, 0.0, 0.0, None), (9998, None, 0.0, 0.0, 1)], "id int, x double, y double, z double, lab int")
    got = joins.nearest_votes(a, b, ident="id", xyz=XYZ, label="lab")
    assert rows(got) == sorted([(p[0], voted(p, known)) for p in asked] if held else [], key=repr)


def test_neighbour_votes(spark, tmp_path):
    rng = random.Random(4)
    systems = [(i, *[rng.uniform(-9000, 9000) for _ in range(3)], i % 5 if i % 3 else None) for i in range(300)]
    pq.write_table(pa.table(dict(zip(["system_id", *XYZ, "region_id"], map(list, zip(*systems, strict=True)), strict=True))), tmp_path / "system_known.parquet")
    known = [s for s in systems if s[4] is not None]
    want = [(s[0], voted(s, known)) for s in systems if s[4] is None]
    assert rows(catalogue.queries()["neighbour_votes"](spark, str(tmp_path))) == sorted(want, key=repr)


def linked(tmp_path, n=30):
    """A chain of names of which only the first is placed, and one with a placed name at both ends."""
    pairs = [(f"a{i:02d}", f"a{i + 1:02d}") for i in range(n)] + [("p0", "p1"), ("p2", "p1"), ("p2", "p3"), ("a00", None), ("a00", "a00")]
    placed = {"a00": [1], "p0": [2], "p3": [3], "twice": [4, 5]}
    pq.write_table(pa.table({"system_a": [a for a, _ in pairs], "system_b": [b for _, b in pairs]}), tmp_path / "system_catalog_alias.parquet")
    pq.write_table(pa.table({"system": [k for k, v in placed.items() for _ in v], "system_id": [x for v in placed.values() for x in v]}), tmp_path / "system_exobio.parquet")
    near = defaultdict(set)
    for a, b in pairs:
        if b and a != b:
            near[a].add(b)
            near[b].add(a)
    return near, placed


def test_agreed_labels(spark, tmp_path):
    near, placed = linked(tmp_path)
    held = {k: placed.get(k, [None])[0] for k in near}
    for _ in range(12):
        told = {k: {held[x] for x in near[k]} - {None} for k in near}
        held = {k: v if v is not None or len(told[k]) != 1 else min(told[k]) for k, v in held.items()}
    assert held["a12"] == 1 and held["a13"] is None
    assert rows(catalogue.queries()["agreed_labels"](spark, str(tmp_path))) == sorted(held.items(), key=repr)


def test_alias_reach(spark, tmp_path):
    near, placed = linked(tmp_path)
    hops = dict.fromkeys(placed, 0)
    for n in range(1, 9):
        hops |= {x: n for k in [k for k, h in hops.items() if h == n - 1] for x in near[k] if x not in hops}
    assert hops["a08"] == 8 and "a09" not in hops
    assert rows(catalogue.queries()["alias_reach"](spark, str(tmp_path))) == sorted(hops.items(), key=repr)


def test_feed_changed_in_its_middle(tmp_path):
    feed, state = tmp_path / "feed", str(tmp_path / "state")
    feed.write_bytes(b"a" * (1 << 18))
    os.utime(feed, (1000, 1000))
    ledger.note_load(str(feed), state)
    assert not ledger.needs_load(str(feed), state)
    feed.write_bytes(b"a" * (1 << 17) + b"b" + b"a" * ((1 << 17) - 1))
    os.utime(feed, (1000, 1000))
    assert ledger.needs_load(str(feed), state)


@pytest.fixture(scope="module")
def sky(tmp_path_factory):
    """Stars of a flat box around both ends of the routes, and their mean distance."""
    rng = np.random.default_rng(7)
    folder, low, high = tmp_path_factory.mktemp("sky"), np.array([-40_000.0, -3000.0, 5000.0]), np.array([0.0, 3000.0, 50_000.0])
    at = rng.uniform(low, high, (15_000, 3)).round(3)
    pq.write_table(pa.table({"system": [f"s{i:05d}" for i in range(len(at))], **{c: at[:, k] for k, c in enumerate(XYZ)}}), folder / "system_exobio.parquet")
    return str(folder), at, (np.prod(at.max(0) - at.min(0)) / len(at)) ** (1 / 3)


def test_route_against_breadth_first_search(spark, sky):
    folder, at, spacing = sky
    jump, goal = 3.3 * spacing, np.array(model.FAR)
    to_goal = np.linalg.norm(at - goal, axis=1)
    front, seen, levels = np.array([model.SHIP]), np.zeros(len(at), bool), 0
    while len(front):
        levels += 1
        new = np.zeros(len(at), bool)
        for p in front:
            new |= ~seen & (np.linalg.norm(at - p, axis=1) <= jump)
        seen |= new
        if (to_goal[new] <= jump).any():
            break
        front = at[new]
    got = sorted(catalogue.queries()["route"](spark, folder).collect())
    assert len(got) == levels >= 12
    steps = np.array([model.SHIP, *[(r.x, r.y, r.z) for r in got], goal])
    assert (np.linalg.norm(np.diff(steps, axis=0), axis=1) <= jump + 1e-6).all()


def test_carrier_path_against_brute_force(spark, sky):
    folder, at, spacing = sky
    goal, here, want = np.array(model.FAR), np.array(model.SHIP), []
    to_goal = np.linalg.norm(at - goal, axis=1)
    while len(want) < 100 and np.linalg.norm(here - goal) > 1:
        hop = np.linalg.norm(at - here, axis=1)
        able = (hop <= 4.2 * spacing) & (hop >= 0.5) & (to_goal < np.linalg.norm(here - goal))
        if not able.any():
            break
        best = int(np.argmin(np.where(able, to_goal, np.inf)))
        here = at[best]
        want.append((len(want) + 1, f"s{best:05d}"))
    assert len(want) >= 10
    assert rows(catalogue.queries()["carrier_path"](spark, folder).select("hop", "name")) == sorted(want, key=repr)
