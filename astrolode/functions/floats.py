"""Single-precision ladders: values that must equal a mark to the last bit, or miss it by one."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import C, _c


def ladder(start: C, top: C, steps: int = 7, least: float | None = None) -> Column:
    """FLOAT values from start in equal steps towards top (not reached), each step at least ``least``.

    The start is rounded to single precision first, the sums are in double precision, and the results rounded again.
    """
    low = _c(start).cast("float").cast("double")
    step = (_c(top).cast("double") - low) / F.lit(float(steps))
    step = F.greatest(step, F.lit(float(least))) if least is not None else step
    return F.array(*[(low + step * F.lit(float(k))).cast("float") for k in range(steps)])


def touches(values: Column, marks: Sequence[float], near: Column | None = None) -> Column:
    """'ON' if a value equals a mark in single precision, 'ONE_OFF' if ``near`` holds and one is a mark's neighbour, else 'OFF'.

    The neighbours of the marks are worked out when the plan is made; no row passes through Python.
    """
    exact = np.array(marks, np.float32)
    beside = np.concatenate([np.nextafter(exact, np.float32(0)), np.nextafter(exact, np.float32(np.inf))])
    listed = lambda xs: F.array(*[F.lit(float(x)).cast("float") for x in xs])
    out = F.when(F.arrays_overlap(values, listed(exact)), "ON")
    if near is not None:
        out = out.when(near & F.arrays_overlap(values, listed(beside)), "ONE_OFF")
    return out.otherwise("OFF")


def flag(flags: C, bit: int) -> Column:
    """One bit of a number."""
    return F.call_function("shiftright", _c(flags), F.lit(bit)).bitwiseAND(F.lit(1)) == 1


def folded_cost(distances: C, base: float, per: float, load: float, capacity: float) -> Column:
    """What a row of legs costs if the load that is left lowers each further leg: round(base + d * per * (1 + load / capacity))."""
    step = lambda a, d: F.struct((a["spent"] + F.round(F.lit(base) + d * F.lit(per) * (1 + a["load"] / F.lit(capacity)))).alias("spent"), F.greatest(a["load"] - F.round(F.lit(base) + d * F.lit(per) * (1 + a["load"] / F.lit(capacity))), F.lit(0.0)).alias("load"))
    return F.aggregate(_c(distances), F.struct(F.lit(0.0).alias("spent"), F.lit(float(load)).alias("load")), step, lambda a: a["spent"])
