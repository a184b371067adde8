"""Column functions for the scalar idioms of the catalogue: all of them stay in generated code."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _c(x: C | float | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


# --- null handling and casts ---------------------------------------------------------------------------------------


def blank_to_null(x: C) -> Column:
    """The trimmed text; null for a blank one."""
    return F.nullif(F.trim(_c(x)), F.lit(""))


def as_int(x: C) -> Column:
    """A number or text as BIGINT, rounded half to even as the source engine does; null where it is no number."""
    return F.bround(_c(x).try_cast("decimal(38,9)"), 0).cast("long")


def ratio(a: C, b: C) -> Column:
    """a / b as DOUBLE; null where b is null or 0."""
    return _c(a).cast("double") / F.nullif(_c(b).cast("double"), F.lit(0.0))


def replace_first(x: C, pattern: str, by: str) -> Column:
    """Replaces the first match only (Spark's own function replaces all); pattern has no groups, by no references."""
    return F.regexp_replace(_c(x), f"(?s)^(.*?)(?:{pattern})(.*)$", f"$1{by}$2")


def stable_id(name: C) -> Column:
    """A negative 33-bit surrogate of a name, ignoring case and outer blanks; the same on every engine run."""
    return -(F.pmod(F.xxhash64(F.lower(F.trim(_c(name)))), F.lit(1 << 32)) + 1)


# --- rates ---------------------------------------------------------------------------------------------------------


def shrunk_ratio(observed: C, expected: C, prior: float = 20.0, cap: float | None = 1.0, digits: int = 4) -> Column:
    """(observed + prior) / (expected + prior), rounded, at most cap."""
    r = F.round((_c(observed) + F.lit(float(prior))) / (_c(expected) + F.lit(float(prior))), digits)
    return F.least(r, F.lit(float(cap))) if cap is not None else r


def laplace(k: C, n: C) -> Column:
    """(k + 1) / (n + 2)."""
    return (_c(k) + F.lit(1.0)) / (_c(n) + F.lit(2.0))


def logistic(x: C, clamp: float = 50.0) -> Column:
    """1 / (1 + exp(-x)), with x kept within +-clamp."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-clamp), F.least(F.lit(clamp), _c(x)))))


def banded(x: C, limits: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the first limit above x, else the last label; null for null."""
    out = F.when(_c(x) < F.lit(limits[0]), labels[0])
    for limit, label in zip(limits[1:], labels[1:-1], strict=True):
        out = out.when(_c(x) < F.lit(limit), label)
    return out.when(_c(x).isNotNull(), labels[-1])


def stepped(x: C, step: float, low: float, high: float) -> Column:
    """x rounded down to a multiple of step and kept within low and high, as INT."""
    return F.least(F.greatest(F.floor(_c(x) / F.lit(step)) * F.lit(step), F.lit(low)), F.lit(high)).cast("int")


# --- space ---------------------------------------------------------------------------------------------------------

P3 = Sequence[Column | str | float]


def distance3(a: P3, b: P3) -> Column:
    """Euclidean distance of two points given by three columns or numbers each."""
    return F.sqrt(sum(((_c(p) - _c(q)) * (_c(p) - _c(q)) for p, q in zip(a, b, strict=True)), F.lit(0.0)))


def in_box(a: P3, b: P3, half: float) -> Column:
    """Whether a lies in the axis-parallel box of that half width around b; this reaches the scan."""
    out = F.lit(True)
    for p, q in zip(a, b, strict=True):
        out = out & _c(p).between(_c(q) - F.lit(half), _c(q) + F.lit(half))
    return out


def along(p: P3, start: Sequence[float], end: Sequence[float]) -> tuple[Column, Column]:
    """The place of p along the line from start (0) to end (1), and its squared distance from the line."""
    d = [e - s for s, e in zip(start, end, strict=True)]
    length2 = sum(x * x for x in d) or 1.0
    t = sum(((_c(x) - F.lit(s)) * F.lit(k) for x, s, k in zip(p, start, d, strict=True)), F.lit(0.0)) / F.lit(length2)
    off = sum(((_c(x) - F.lit(s) - t * F.lit(k)) * (_c(x) - F.lit(s) - t * F.lit(k)) for x, s, k in zip(p, start, d, strict=True)), F.lit(0.0))
    return t, off


def in_spheroid(p: P3, a: Sequence[float], b: Sequence[float], total: float) -> Column:
    """Whether the distances of p to the two foci add up to at most total."""
    return distance3(p, list(a)) + distance3(p, list(b)) <= F.lit(total)


def half_width(apart: C | float, way: C | float) -> Column:
    """How far from the line between two foci a point can lie whose distances to them add up to way; 0 if way is too short.

    The farthest one lies above the middle: half the way is the hypotenuse, half of what the foci are apart one side.
    """
    return F.sqrt(F.greatest((_c(way) - _c(apart)) * (_c(way) + _c(apart)), F.lit(0.0))) / 2


def great_circle(lat1: C, lon1: C, lat2: C, lon2: C, radius: C | float) -> Column:
    """Distance along the surface of a sphere; angles in degrees."""
    p, q = F.radians(_c(lat1)), F.radians(_c(lat2))
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), 2)
    return 2 * _c(radius) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def galactic_xyz(parallax_mas: C, lon: C, lat: C) -> tuple[Column, Column, Column]:
    """Position in light years from a parallax and galactic longitude and latitude in degrees."""
    r = F.lit(3261.56) / _c(parallax_mas)
    l, b = F.radians(_c(lon)), F.radians(_c(lat))  # noqa: E741
    return -r * F.cos(b) * F.sin(l), r * F.sin(b), r * F.cos(b) * F.cos(l)


def compass(dx: C, dz: C) -> Column:
    """The eighth of the horizon that a step along x (east) and z (north) leads to; null for no step."""
    names = F.array(*[F.lit(n) for n in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    eighth = F.pmod(F.floor(F.degrees(F.atan2(_c(dx), _c(dz))) / 45 + 0.5), F.lit(8)).cast("int")
    return F.when((_c(dx) != 0) | (_c(dz) != 0), F.get(names, eighth))


def jump_range(optimal_mass: C, fuel: C, dry_mass: C, load: C, power: float, scale: float) -> Column:
    """How far a drive carries a ship: optimal mass over total mass, times (fuel / scale) to the power 1 / power."""
    return _c(optimal_mass) / (_c(dry_mass) + _c(fuel) + _c(load)) * F.pow(_c(fuel) / F.lit(scale), F.lit(1.0 / power))


# --- system addresses ----------------------------------------------------------------------------------------------
# The corner of the grid, the edge of a sector in light years, and the mass codes.
ORIGIN, SECTOR_LY, MASS_CODES = (-49985.0, -40985.0, -24105.0), 1280.0, "abcdefgh"


def mass_index(address: C) -> Column:
    """0 to 7, for mass codes a to h: the low three bits of an address."""
    return _c(address).bitwiseAND(F.lit(7)).cast("int")


def mass_code(address: C) -> Column:
    return F.substring(F.lit(MASS_CODES), mass_index(address) + 1, F.lit(1))


def _shifted(address: Column, by: Column, bits: Column) -> Column:
    return F.call_function("shiftright", address, by.cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int")) - 1)


def boxel_cell(address: C) -> tuple[Column, Column, Column]:
    """x, y and z of the boxel: fields of 14-m, 13-m and 14-m bits above the mass code, z lowest."""
    a, m = _c(address), mass_index(address)
    return _shifted(a, 30 - m * 2, 14 - m), _shifted(a, 17 - m, 13 - m), _shifted(a, F.lit(3), 14 - m)


def boxel_number(address: C) -> Column:
    """What follows the cell's fields: the index within the boxel."""
    return F.call_function("shiftright", _c(address), (44 - mass_index(address) * 3).cast("int"))


def sector_of(address: C) -> Column:
    """The id of the 1280-ly cell: x + 128 y + 16384 z."""
    m = mass_index(address)
    x, y, z = (F.call_function("shiftright", v, 7 - m) for v in boxel_cell(address))
    return x + y * 128 + z * 16384


def sector_at(x: C, y: C, z: C) -> Column:
    """The id of the cell that holds a position."""
    i, j, k = (F.floor((_c(v) - F.lit(o)) / F.lit(SECTOR_LY)).cast("long") for v, o in zip((x, y, z), ORIGIN, strict=True))
    return i + j * 128 + k * 16384


def boxel_centre(address: C) -> tuple[Column, Column, Column]:
    """The middle of the boxel; its edge is 10 * 2^m light years."""
    edge = F.pow(F.lit(2.0), mass_index(address)) * 10
    return tuple((v + 0.5) * edge + F.lit(o) for v, o in zip(boxel_cell(address), ORIGIN, strict=True))


def boxel_letters(number: C) -> Column:
    """Three letters of a boxel's number in base 26, as in 'AB-C'."""
    n, a = _c(number), F.lit(ord("A"))
    letter = lambda v: F.char((v % 26 + a).cast("int"))
    return F.concat(letter(n), letter(F.floor(n / 26)), F.lit("-"), letter(F.floor(n / 676)))


# Fixed value: how systematic names are written.
NAME = r"^(.+) ([A-Z][A-Z]-[A-Z]) ([a-h])(?:(\d+)-)?(\d+)$"


def name_parts(name: C) -> dict[str, Column]:
    """Sector, cube letters, mass code, sub-cube and index of a systematic name; all null for other names."""
    part = lambda i: F.nullif(F.regexp_extract(_c(name), NAME, i), F.lit(""))
    return {"sector": part(1), "cube": part(2), "mass": part(3), "sub": part(4).cast("int"), "number": part(5).cast("int")}


# --- names ---------------------------------------------------------------------------------------------------------


def title_words(x: C, small: Sequence[str] = ("of", "the", "and")) -> Column:
    """A name with single blanks, each word in upper case at its head; small words stay small unless they come first."""
    words = F.split(F.trim(F.regexp_replace(_c(x), r"\s+", " ")), " ")
    head = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(*small), F.lower(w)).otherwise(head(w))), " ")


def without_prefix(x: C, prefix: C) -> Column:
    """x without a leading prefix and a blank; '' if it is the prefix; x itself if it doesn't begin so."""
    a, p = _c(x), _c(prefix)
    return F.when(a == p, F.lit("")).when(F.startswith(a, F.concat(p, F.lit(" "))), F.substring(a, F.length(p) + 2, F.length(a))).otherwise(a)


# --- SQL texts -----------------------------------------------------------------------------------------------------


def fill_template(text: str, fragments: dict[str, str], names: dict[str, str] | None = None) -> str:
    """text with each {{NAME}} replaced by its fragment (which may hold others) and each ${name} by an identifier.

    Unknown names and fragments that hold themselves are errors; identifiers must be plain words.
    """

    def fragment(m: re.Match, held: tuple[str, ...]) -> str:
        if m[1] in held or m[1] not in fragments:
            raise ValueError(f"unknown or repeated fragment {m[1]}")
        return re.sub(r"\{\{(\w+)\}\}", lambda k: fragment(k, (*held, m[1])), fragments[m[1]])

    def name(m: re.Match) -> str:
        if not re.fullmatch(r"[A-Za-z_]\w*", (names or {}).get(m[1], "")):
            raise ValueError(f"no plain name for {m[1]}")
        return names[m[1]]

    return re.sub(r"\$\{(\w+)\}", name, re.sub(r"\{\{(\w+)\}\}", lambda m: fragment(m, ()), text))
