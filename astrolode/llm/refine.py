"""Records that differ only in their writing, found by refining a partition step by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hottest, salted_join
from ..storage import Scratch


def refined_classes(records: DataFrame, key: str, invariants: list[Column], exact: Column, *, columns: list[str]) -> DataFrame:
    """key, exact (as ``record``), first_key and copies of every row whose class under exact has two or more members.

    Each of the invariants, from the cheapest to the costliest, must be equal wherever exact is equal. Rows are parted
    by the first; within the classes that have another member by the second, and so on; singletons leave at once, so
    that exact is evaluated only on rows that agree in all invariants with another. columns: what invariants and exact
    read. Classes are known by a hash of their invariants: two that clash stay together until exact parts them. Counts
    are aggregated before they move, and a class with any share of the rows is salted when its rows meet its count.
    Rows with a null key or a null exact value are left out; a row that stands there twice is one member.
    """
    scratch = Scratch(records.sparkSession, "refine")
    rows = records.where(F.col(key).isNotNull()).select(key, *columns).withColumn("__class", F.lit(0).cast("long"))
    before = None
    for i, invariant in enumerate(invariants):
        held = scratch.write(rows.withColumn("__class", F.xxhash64("__class", invariant)), f"level{i}")
        if before is not None:
            scratch.drop(before)
        before = held
        counts = held.groupBy("__class").agg(F.count(F.lit(1)).alias("__n"))
        rows = salted_join(held, counts.where("__n > 1").select("__class"), ["__class"], "left_semi", spread=F.xxhash64(key), hot=hottest(counts, ["__class"], "__n"))
    rows = scratch.write(rows.select(F.col(key), exact.alias("record")).where("record IS NOT NULL"), "exact")
    if before is not None:
        scratch.drop(before)
    groups = rows.groupBy("record").agg(F.min(key).alias("first_key"), F.count_distinct(key).alias("copies"), F.count(F.lit(1)).alias("__n")).where("copies > 1")
    return salted_join(rows, groups.drop("__n"), ["record"], spread=F.xxhash64(key), hot=hottest(groups, ["record"], "__n")).distinct()


# The full-width forms of the visible ASCII characters, dashes that stand for a minus sign, wide and
# narrow spaces, and invisible characters, which are dropped.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))
_DASHES = "‐‑‒–—−﹣"
_SPACES = "\u00a0\u2007\u2009\u200a\u202f\u3000"
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
_FROM, _TO = _WIDE + _DASHES + _SPACES + _INVISIBLE, _NARROW + "-" * len(_DASHES) + " " * len(_SPACES)


def plain_writing(records: DataFrame, columns: list[str]) -> DataFrame:
    """records with these columns in narrow, lower-case characters without invisible ones."""
    ascii = lambda c: F.length(c) == F.octet_length(c)
    return records.withColumns({c: F.lower(F.when(ascii(c), F.col(c)).otherwise(F.translate(F.col(c), _FROM, _TO))) for c in columns})


def designation_key(catalogue: str, columns: list[str], signed: tuple[str, ...] = ("dz",)) -> tuple[list[Column], Column]:
    """Invariants and the exact key by which designations of a catalogue, in plain writing, are refined.

    The invariants are the catalogue with the histogram of the digits (and so their number), then the digits in their
    order; the exact key also tells the division into numbers, the component letter and the sign.

    A record is its catalogue, its numbers in their order and its component letter, whatever the white space, case,
    punctuation, width of characters and the order of catalogue and number; for signed catalogues also the sign before
    the first number. Several columns may hold the designation, with or without the catalogue, in any order; a null or
    blank one is passed over. Without a catalogue the letters in the columns tell it.
    """
    words = lambda c: F.regexp_extract_all(F.col(c), F.lit(r"(\p{L}+|\p{Nd}+)"), F.lit(1))
    blank = F.array().cast("array<string>")
    named = F.nullif(F.regexp_replace(F.coalesce(F.col(catalogue), F.lit("")), r"[^\p{L}]", ""), F.lit(""))
    told = F.concat(*[F.filter(F.coalesce(words(c), blank), lambda w: w.rlike(r"^\p{L}{2,}$")) for c in columns])
    name = F.when(named.isNotNull(), named).otherwise(F.coalesce(F.try_element_at(told, F.lit(1)), F.lit("")))
    digits = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[^\p{Nd}]+", "")
    histogram = lambda c: F.array_join(F.sort_array(F.split(digits(c), "")), "")

    def content(c: str) -> Column:
        sign = F.when(name.isin(*signed), F.regexp_extract(F.col(c), r"^[^\p{Nd}]*?([-+])\s*\p{Nd}", 1)).otherwise(F.lit(""))
        held = F.array_join(F.filter(words(c), lambda w: w != name), " ")
        return F.when(held != "", F.concat(sign, held))

    both = lambda f: F.array_join(F.array_distinct(F.array_sort(F.filter(F.array(*[f(c) for c in columns]), lambda x: x.isNotNull() & (x != "")))), "|")
    return [F.concat_ws(":", name, both(histogram)), both(digits)], F.nullif(F.concat_ws(":", name, both(content)), F.lit(":"))
