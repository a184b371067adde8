import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from astrolode.llm import mixing


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=4), st.integers(0, 90))
def test_knapsack_is_as_near_as_any(lengths, target):
    got, exact = mixing.knapsack(lengths, {}, target, 0, sum(k * n for k, n in lengths.items()) + target)
    assert exact and all(0 < n <= lengths[k] for k, n in got.items())
    sums = [sum(k * n for k, n in zip(lengths, c, strict=True)) for c in itertools.product(*[range(n + 1) for n in lengths.values()])]
    assert abs(sum(k * n for k, n in got.items()) - target) == min(abs(s - target) for s in sums)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(0, 20), max_size=8), st.integers(0, 9000), st.integers(-1, 5), st.integers(0, 300))
def test_fit_keeps_its_bounds(lengths, target, most, exact):
    f = mixing.fit(lengths, target, most, exact)
    real = {k: n for k, n in lengths.items() if k and n}
    assert all(f.base + -(-n // real[k]) <= max(most, 0) for k, n in f.extra.items()) and f.base <= max(most, 0)
    drawn = sum(k * (n * f.base + f.extra.get(k, 0)) for k, n in real.items())
    reach = max(most, 0) * sum(k * n for k, n in real.items())
    assert drawn == reach if target >= reach else abs(drawn - target) <= max(real)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 25), st.integers(1, 2), min_size=1, max_size=3), st.integers(0, 200), st.integers(2, 4))
def test_fit_is_as_near_as_any_number_of_copies(lengths, target, most):
    f = mixing.fit(lengths, target, most)
    sums = [sum(k * c for k, c in zip(lengths, cs, strict=True)) for cs in itertools.product(*[range(n * most + 1) for n in lengths.values()])]
    drawn = sum(k * (n * f.base + f.extra.get(k, 0)) for k, n in lengths.items())
    assert abs(drawn - target) == min(abs(s - target) for s in sums)


def test_draws(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 20)
    rng = random.Random(2)
    docs = [(i, rng.choice(["big", "big", "small", None]), rng.choice([0, 7, 7, 7, 11, 40])) for i in range(600)]
    targets = [("m", "big", 0.5, 1, 0.5), ("m", "small", 0.5, 2, 1.0), ("m", "none", 0.1, 3, 1.0), ("n", "small", 0.2, 5, 2.0), ("n", None, 0.2, 5, 2.0), ("n", "big", None, 1, 1.0), ("n", "big", 0.1, None, 1.0)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    goals = spark.createDataFrame(targets, "mix string, source string, target_share double, max_repeats int, size_factor double")
    drawn = mixing.draw(sized, goals)
    total, got = sum(t for _, _, t in docs), {}
    size = {i: (s, t) for i, s, t in docs}
    for r in drawn.collect():
        assert size[r.doc_id] == (r.source, r.n_tokens) and r.n_tokens > 0
        got[r.mix, r.source] = got.get((r.mix, r.source), 0) + r.n_tokens * r.copies
    assert drawn.groupBy("mix", "doc_id").count().where("count > 1").count() == 0
    for mix, source, share, most, factor in targets:
        if None not in (source, share, most) and source != "none":
            have = sum(t for _, s, t in docs if s == source)
            want = min(round(share * factor * total), most * have)
            assert abs(got.get((mix, source), 0) - want) <= 3
            assert drawn.where((drawn.mix == mix) & (drawn.source == source) & (drawn.copies > most)).count() == 0
    again = mixing.draw(sized.repartition(7), goals)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, drawn.collect()))
    report = {(r.mix, r.source): r for r in mixing.shares(drawn, sized, goals).collect()}
    assert report["m", "none"].drawn_tokens == 0 and abs(sum(r.actual_share or 0 for k, r in report.items() if k[0] == "m") - 1) < 1e-5


def test_no_documents(spark):
    sized = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    goals = spark.createDataFrame([("m", "a", 1.0, 2, 1.0)], "mix string, source string, target_share double, max_repeats int, size_factor double")
    assert mixing.draw(sized, goals).count() == 0 and mixing.shares(mixing.draw(sized, goals), sized, goals).first().actual_share is None


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=4), st.integers(0, 200), st.integers(1, 3), st.sampled_from([1, 1000, 99_991]), st.integers(0, 40), st.sampled_from([0, 40]))
def test_fit_is_as_near_as_any_at_any_size(lengths, target, most, scale, off, few):
    lengths, target = {k * scale: n for k, n in lengths.items()}, target * scale + off
    held, mixing.FEW = mixing.FEW, few if scale < 99_991 else 40
    try:
        f = mixing.fit(lengths, target, most)
    finally:
        mixing.FEW = held
    sums = [sum(k * c for k, c in zip(lengths, cs, strict=True)) for cs in itertools.product(*[range(n * most + 1) for n in lengths.values()])]
    drawn = sum(k * (n * f.base + f.extra.get(k, 0)) for k, n in lengths.items())
    assert abs(drawn - target) == min(abs(s - target) for s in sums)
    assert all(f.base * n + f.extra.get(k, 0) <= most * n for k, n in lengths.items())


def test_long_documents():
    drawn = lambda f, have: sum(k * (n * f.base + f.extra.get(k, 0)) for k, n in have.items())
    for have, target, most in (({12_000: 1, 11_000: 1, 9000: 1}, 20_000, 1), ({300_000: 1, 290_000: 1, 210_000: 1}, 500_000, 1), ({300_000: 1, 290_000: 1, 210_000: 1}, 500_000, 3)):
        assert drawn(mixing.fit(have, target, most), have) == target
    rng = random.Random(6)
    books = {rng.randrange(50_000, 500_000): 1 for _ in range(2000)}
    for target in (123_456_789, 20_000_003):
        assert drawn(mixing.fit(books, target, 1), books) == target


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.tuples(st.integers(0, 3), st.integers(0, 3)), max_size=4), st.integers(-120, 120), st.integers(1, 400))
def test_knapsack_adds_and_takes_off(change, goal, window):
    add, drop = ({k: v[i] for k, v in change.items()} for i in (0, 1))
    window = max(window, abs(goal))
    got, exact = mixing.knapsack(add, drop, goal, 0, window)
    assert all(-drop[k] <= n <= add[k] for k, n in got.items())
    sums = [sum(k * n for k, n in zip(change, c, strict=True)) for c in itertools.product(*[range(-drop[k], add[k] + 1) for k in change])]
    missed = abs(sum(k * n for k, n in got.items()) - goal)
    assert missed == min(abs(s - goal) for s in sums) if exact else missed <= abs(goal)


def test_many_copies_need_little_memory():
    import tracemalloc

    even = {k: 1000 for k in range(2, 6000, 2)}  # no draw hits an odd target
    tracemalloc.start()
    for target in (131_071, 2_000_000_001):
        f = mixing.fit(even, target, 1)
        assert abs(sum(k * (n * f.base + f.extra.get(k, 0)) for k, n in even.items()) - target) == 1
    gaps = {k: 50 for k in range(3000, 9000, 3)} | {4001: 1}  # of the sums one above a multiple of three, all are missed
    f = mixing.fit(gaps, 90_000_001, 1)
    assert abs(sum(k * (n * f.base + f.extra.get(k, 0)) for k, n in gaps.items()) - 90_000_001) == 1
    assert mixing.always_missed(gaps, 90_000_001) == 1
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=4), st.integers(0, 150))
def test_always_missed_is_a_bound(held, target):
    sums = [sum(k * n for k, n in zip(held, c, strict=True)) for c in itertools.product(*[range(n + 1) for n in held.values()])]
    assert mixing.always_missed(held, target) <= min(abs(s - target) for s in sums)
