"""Mixing sources to target shares of a size in tokens."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.skew import hottest, salted_join
from ..storage import Scratch

#: Documents of one length that are ranked in one task.
RANKED = 20_000

#: Parts of lengths, at most, whose sums are listed; 40 make a million sums for each half of them.
FEW = 40

#: Bits of the sums of one search (8 MB).
MOST_BITS = 1 << 26


@dataclass(frozen=True)
class Fill:
    """How often all documents of a source are taken, and how many further copies of each length, spread evenly."""

    base: int
    extra: dict[int, int]


def fit(lengths: dict[int, int], target: int, most: int, most_bits: int = MOST_BITS) -> Fill:
    """The draw of documents whose tokens come nearest to target; lengths: number of documents by length in tokens.

    It begins with the same part of the copies of each length, which misses the target by less than one document of
    each length, and then with single documents up to the longest. What is left is a bounded knapsack over copies that
    are added and copies that are taken off. Its sums are followed within a window around zero that grows fourfold
    until no draw can come nearer: either the draw misses by always_missed(), or the window held every sum there is. Few
    documents are searched by the sums of two halves, whatever their lengths.

    The window ends at most_bits bits (8 MB). A draw that misses then is the nearest found, not proven nearest; that
    takes many documents whose sums leave gaps as wide as the window, which no table of lengths seen so far has.
    """
    lengths = {k: n for k, n in lengths.items() if k > 0 and n > 0}
    total = sum(k * n for k, n in lengths.items())
    most = max(0, most)
    if not total or not most or target <= 0:
        return Fill(0, {})
    if target >= most * total:
        return Fill(most, {})
    held = {k: n * most for k, n in lengths.items()}
    least = always_missed(held, target)
    taken, left = _begin(held, target)
    if abs(left) > least:
        few = halves(_parts(held), target) if len(_parts(held)) <= FEW else None
        if few is not None:
            taken = few
        else:
            window, best, change = 4 * max(*lengths, abs(left)), left, {}
            while abs(best) > least and window <= most_bits:
                other, exact = knapsack({k: n - taken[k] for k, n in held.items()}, taken, left, least, window, abs(best))
                off = left - sum(k * n for k, n in other.items())
                if abs(off) < abs(best):
                    best, change = off, other
                if exact:
                    break
                window *= 4
            taken = {k: n + change.get(k, 0) for k, n in taken.items()}
    base = min(taken.get(k, 0) // n for k, n in lengths.items())
    extra = {k: taken.get(k, 0) - base * n for k, n in lengths.items()}
    return Fill(base, {k: n for k, n in extra.items() if n})


def always_missed(held: dict[int, int], target: int) -> int:
    """Tokens by which every draw misses the target at least, as far as remainders tell; held: copies by length.

    The rarest lengths are set apart, one after the other; all others have a common divisor, and what the rare ones
    leave when divided by it decides how near a sum can come. Divisors grow as lengths are set apart.
    """
    rare = sorted(held, key=lambda k: (held[k], k))
    rest = [0]
    for k in reversed(rare):
        rest.append(math.gcd(rest[-1], k))
    rest.reverse()  # rest[i]: the common divisor of all but the first i
    worst, before = 0, 0
    for i, m in enumerate(rest[:-1]):
        if m > before:
            before, sums, full = m, 1, (1 << m) - 1  # the bits of sums are the remainders of sums of the rare ones
            for k, n in _parts({k: min(held[k], m // math.gcd(k, m) - 1) for k in rare[:i]}):
                if sums == full:
                    break
                by = k * n % m
                sums |= (sums << by | sums >> m - by) & full
            at = target % m
            turned = (sums >> at | sums << m - at) & full  # bit 0: a sum with the remainder of the target
            worst = max(worst, 0 if turned & 1 else min((turned & -turned).bit_length() - 1, m - turned.bit_length() + 1))
    return worst


def _begin(held: dict[int, int], target: int) -> tuple[dict[int, int], int]:
    """Copies of each length in proportion, then single ones of the greatest remainders; and what is left to target."""
    total = sum(k * n for k, n in held.items())
    taken = {k: n * target // total for k, n in held.items()}
    left = target - sum(k * n for k, n in taken.items())
    for k in sorted(held, key=lambda k: (-(held[k] * target % total), -k)):
        if k <= left and taken[k] < held[k]:
            taken[k] += 1
            left -= k
    return taken, left


def _parts(held: dict[int, int], top: int | None = None) -> list[tuple[int, int]]:
    """(length, copies) in sizes that make up every number of copies; those longer than top in all are left out."""
    out = []
    for k, n in sorted(held.items()):
        size = 1
        while n > 0 and (top is None or k * size <= top):
            out.append((k, min(size, n)))
            n -= size
            size *= 2
    return out


def halves(parts: list[tuple[int, int]], target: int) -> dict[int, int]:
    """The nearest sum of any of the parts, from the sorted sums of two halves; of equally near sums the lower."""
    two = parts[::2], parts[1::2]
    steps = [[np.zeros(1, np.int64)], [np.zeros(1, np.int64)]]
    for half, sums in zip(two, steps, strict=True):
        for k, n in half:
            more = np.union1d(sums[-1], sums[-1] + k * n)
            sums.append(more[more <= 2 * target])
    a, b = steps[0][-1], steps[1][-1]
    at = np.searchsorted(b, target - a)
    under, over = b[np.maximum(at - 1, 0)], b[np.minimum(at, b.size - 1)]
    pairs = np.concatenate([a + under, a + over])
    i = int(np.lexsort((pairs, np.abs(pairs - target)))[0])
    out = dict.fromkeys((k for k, _ in parts), 0)
    for half, sums, value in zip(two, steps, (a[i % a.size], (under if i < a.size else over)[i % a.size]), strict=True):
        for (k, n), before in zip(half[::-1], sums[-2::-1], strict=True):
            j = np.searchsorted(before, value)
            if j == before.size or before[j] != value:
                value -= k * n
                out[k] += n
    return out


def knapsack(add: dict[int, int], drop: dict[int, int], goal: int, near: int, window: int, better: int | None = None) -> tuple[dict[int, int], bool]:
    """Copies to add (or, below 0, to take off) so that their tokens come nearest to goal, and whether none come nearer.

    add, drop: how many copies of each length may be added and taken off. Sums from -window to window are the bits of
    one integer; each part shifts them. The search ends with the first sum within near of goal. The nearest is exact
    if no part and no sum was left out, that is if all that can be added, and all that can be taken off, lies within
    the window. With ``better``, sums that miss the goal by as much or more are not traced: nothing is changed then. The way to the sum is traced by halving the parts: the sums that the first half reaches meet those from
    which the second half leads to the end. A few integers are held at a time, however many parts there are.
    """
    mask = (1 << 2 * window + 1) - 1
    parts = sorted([(k, n) for k, n in _parts(add, window)] + [(-k, n) for k, n in _parts(drop, window)], key=lambda p: (abs(p[0]) * p[1], p))
    exact = all(sum(k * n for k, n in d.items()) <= window for d in (add, drop))

    def shifted(sums: int, by: int) -> int:
        return sums | (sums << by & mask if by > 0 else sums >> -by)

    first = 1 << window
    wanted = ((1 << 2 * near + 1) - 1) << max(0, goal + window - near)
    sums, used = first, 0
    while used < len(parts) and not sums & wanted:
        sums = shifted(sums, parts[used][0] * parts[used][1])
        used += 1
    out: dict[int, int] = {}
    found = _nearest_bit(sums, goal + window)
    todo = [(0, used, window, found)] if better is None or abs(found - window - goal) < better else []
    while todo:
        lo, hi, start, end = todo.pop()
        if start == end:
            continue
        if hi - lo == 1:
            k, n = parts[lo]
            out[abs(k)] = out.get(abs(k), 0) + (n if k > 0 else -n)
            continue
        mid = (lo + hi) // 2
        ahead, back = 1 << start, 1 << end
        for k, n in parts[lo:mid]:
            ahead = shifted(ahead, k * n)
        for k, n in parts[mid:hi][::-1]:
            back = shifted(back, -k * n)
        both = ahead & back
        at = (both & -both).bit_length() - 1
        todo += [(lo, mid, start, at), (mid, hi, at, end)]
    return {k: n for k, n in out.items() if n}, exact


def _nearest_bit(bits: int, at: int) -> int:
    """The position of the set bit nearest to at, the lower of equally near ones."""
    below = (bits & ((1 << at + 1) - 1)).bit_length() - 1
    over = bits >> at + 1
    above = at + 1 + (over & -over).bit_length() - 1 if over else None
    if below < 0:
        return above
    return below if above is None or at - below <= above - at else above


_PLAN = "source string, n_tokens long, n long, part int, base int, extra long"


def plan(counts: DataFrame, goals: DataFrame) -> DataFrame:
    """source, n_tokens, n, part, base, extra: the fill of each goal, by length; lengths that are not taken are left out.

    counts: source, n_tokens, n. goals: part, source, target, most. One task fits one goal, from the numbers of its
    source by length, which are at most as many as the longest text has tokens.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        have = dict(zip(rows["n_tokens"].tolist(), rows["n"].tolist(), strict=True))
        f = fit(have, int(rows["target"].iloc[0]), int(rows["most"].iloc[0]))
        got = [(rows["source"].iloc[0], k, n, rows["part"].iloc[0], f.base + f.extra.get(k, 0) // n, f.extra.get(k, 0) % n) for k, n in have.items() if f.base or f.extra.get(k, 0)]
        return pd.DataFrame(got, columns=["source", "n_tokens", "n", "part", "base", "extra"])

    return counts.join(F.broadcast(goals), "source").groupBy("part").applyInPandas(one, _PLAN)


def draw(sized: DataFrame, targets: DataFrame, *, key: str = "doc_id", seed: int = 17) -> DataFrame:
    """mix, source, key, n_tokens, copies: how often each document is taken into each mix.

    sized: key (unique), source, n_tokens. targets: mix, source, target_share, max_repeats, size_factor; a table of
    mixes, small enough for the driver. A source's budget is target_share * size_factor * the tokens of all documents,
    as far as max_repeats allows.

    1. Documents are counted by source and exact length.
    2. fit() plans, in one task for each mix and source, how many documents of each length are taken.
    3. Each document meets the plans of its source and length, gathered in one row; lengths with very many documents
       are salted. Of each length the documents with the least seeded hashes are taken; where one length has very
       many, they are ranked in parts.

    Documents without tokens are never taken. Targets with a null source, share, factor or max_repeats take nothing;
    several rows for one mix and source each make their own draw, added up. Sources without documents give no rows.
    """
    spark = sized.sparkSession
    scratch = Scratch(spark, "mix")
    rows = [r.asDict() for r in targets.select("mix", "source", "target_share", "max_repeats", "size_factor").collect()]
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    whole = [(i, g["mix"], g["source"], round(g["target_share"] * g["size_factor"] * total), g["max_repeats"]) for i, g in enumerate(rows) if None not in (g["source"], g["target_share"], g["size_factor"], g["max_repeats"])]
    goals = F.broadcast(spark.createDataFrame(whole, "part int, mix string, source string, target long, most int"))  # a row for each mix and source
    counts = scratch.write(sized.where("n_tokens > 0").join(goals.select("source").distinct(), "source", "left_semi").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")), "counts")
    planned = plan(counts, goals.select("part", "source", "target", "most"))
    each = scratch.write(planned.groupBy("source", "n_tokens", "n").agg(F.collect_list(F.struct("part", "base", "extra")).alias("plans")), "plan")  # as many as there are mixes
    at = ["source", "n_tokens"]
    met = salted_join(sized.select(key, *at), each, at, spread=F.xxhash64(key), hot=hottest(counts, at, "n")).select(key, *at, "n", F.inline("plans"))
    met = met.join(goals.select("part", "mix"), "part")
    full = met.where("extra = 0").select("mix", "source", key, "n_tokens", F.col("base").alias("copies"))
    some = met.where("extra > 0").withColumn("order", F.xxhash64(F.lit(seed), "part", key))
    some = some.withColumn("bucket", F.pmod("order", F.ceil(F.col("n") / RANKED).cast("long")))
    at = ["part", "source", "n_tokens", "bucket"]
    before = some.groupBy(*at).agg(F.count(F.lit(1)).alias("held"))
    before = before.withColumn("before", F.sum("held").over(W.partitionBy(*at[:3]).orderBy("bucket")) - F.col("held")).drop("held")
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy(*at).orderBy("order", key))).join(before, at)
    once_more = (F.col("before") + F.col("rank") <= F.col("extra")).cast("int")
    parts = ranked.select("mix", "source", key, "n_tokens", (F.col("base") + once_more).alias("copies")).where("copies > 0")
    drawn = full.unionByName(parts)
    if len({(g["mix"], g["source"]) for g in rows}) < len(rows):
        drawn = drawn.groupBy("mix", "source", key, "n_tokens").agg(F.sum("copies").cast("int").alias("copies"))
    return drawn


def shares(drawn: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: the target, what there is, what was drawn, and its actual share of the mix."""
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_tokens"))
    there = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"))
    took = drawn.groupBy("mix", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn_tokens"), F.sum("copies").alias("draws"), F.count(F.lit(1)).alias("drawn_documents"), F.max("copies").alias("most_copies"))
    out = targets.join(there, "source", "left").join(took, ["mix", "source"], "left").crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    sums = F.sum(F.coalesce("drawn_tokens", F.lit(0))).over(W.partitionBy("mix"))
    return out.select(
        "mix", "source", "target_share", F.round(F.col("target_share") * F.col("size_factor") * F.col("all_tokens")).cast("long").alias("target_tokens"),
        zero("documents"), zero("tokens"), zero("drawn_documents"), zero("draws"), zero("drawn_tokens"), zero("most_copies"),
        F.round(F.coalesce("drawn_tokens", F.lit(0)) / F.nullif(sums, F.lit(0)), 6).alias("actual_share"),
    )
