"""References to records that do not exist at the time of the reference."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bitmaps import Bitmap
from ..storage import Scratch
from .skew import hottest, salted_join

#: Rows of both sides that a key range is meant to hold before repeated keys are merged.
RANGE_ROWS = 1 << 17

_LEFT = "target string, key string, month int, n long, known boolean, open_from long, first_from long"


def _uncovered(children: pa.Table, parents: pa.Table) -> pa.Table:
    """Of one key range: the (key, month) pairs whose key isn't live through all of the month.

    Keys of both sides get integer codes by their place in the sorted dictionary of the range. Each month has a
    bitmap of the codes it refers to and one of the codes that are live from before its first instant without end.
    """
    keys = pa.concat_arrays([c for t in (parents, children) for c in t["key"].chunks]).dictionary_encode()
    n, code = len(keys.dictionary), keys.indices.to_numpy(zero_copy_only=False)
    at_parent, at_child = code[: parents.num_rows], code[parents.num_rows :]
    never = np.iinfo(np.int64).max
    open_from, first_from, known = np.full(n, never), np.full(n, never), np.zeros(n, bool)
    open_from[at_parent] = parents["open_from"].fill_null(never).to_numpy()
    first_from[at_parent] = parents["first_from"].to_numpy()
    known[at_parent] = True
    month, start = children["month"].to_numpy(), children["month_start"].to_numpy()
    order = np.argsort(month, kind="stable")
    codes, months, numbers, n_of = [], [], [], children["n"].to_numpy()
    for part in np.split(order, np.flatnonzero(np.diff(month[order])) + 1):
        if part.size:
            left = Bitmap.of(at_child[part]).and_not(Bitmap.of(np.flatnonzero(open_from <= start[part[0]]))).codes()
            count = np.zeros(n, np.int64)
            count[at_child[part]] = n_of[part]
            codes.append(left)
            numbers.append(count[left])
            months.append(np.full(left.size, month[part[0]], np.int32))
    left = np.concatenate(codes) if codes else np.empty(0, np.int64)
    target = (children if children.num_rows else parents)["target"][0].as_py() if n else ""
    return pa.table(
        {
            "target": pa.array([target] * left.size, pa.string()), "key": keys.dictionary.take(pa.array(left)), "month": pa.array(np.concatenate(months) if months else [], pa.int32()), "n": pa.array(np.concatenate(numbers) if numbers else [], pa.int64()),
            "known": pa.array(known[left]), "open_from": pa.array(open_from[left], pa.int64()), "first_from": pa.array(first_from[left], pa.int64()),
        }
    )


def dangling(refs: DataFrame, parents: DataFrame, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """References without a live parent, with the reason: child_field, child_id, ref_month, reason; distinct rows.

    refs: child_field, child_id, target, key, at. parents: target, key, live_from, live_to (null: still live). Keys are
    compared as text. A parent is live at a time t if live_from <= t and live_to is null or > t. The reason is
    'missing' without any parent row of the key, else 'late' if all of them begin after t, else 'deleted'.

    1. Both sides are merged before they move: references to (key, month), parents to one row per key.
    2. In each key range, bitmaps of integer codes give referenced AND NOT live-through-the-month; bits that survive are
       decoded. A cleared bit proves that all references of that key and month are sound.
    3. The rows behind surviving bits are checked exactly: against the first instant of the key, and, for the few keys
       that ended and began again, against their closed spans.

    Null keys refer to nothing and are left out. A null time has no month (null) and nothing is live at it. A parent
    without live_from is never live. Empty tables give no rows, or 'missing' for every reference. Hot keys are merged
    in step 1 and salted in step 3. Other columns of the inputs are ignored.
    """
    spark = refs.sparkSession
    micros = F.unix_micros
    refs = refs.select("child_field", "child_id", "target", F.col("key").cast("string").alias("key"), "at", F.coalesce(F.year("at") * 12 + F.month("at") - 1, F.lit(-1)).alias("month")).where(F.col("key").isNotNull())
    spans = parents.select("target", F.col("key").cast("string").alias("key"), "live_from", "live_to").where(F.col("key").isNotNull())
    early = -(1 << 62)

    n = max(1, -(-(refs.count() + spans.count()) // range_rows))
    ranged = lambda df: df.withColumn("range", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int"))
    start = F.when(F.col("month") < 0, F.lit(early)).otherwise(micros(F.make_timestamp(F.floor(F.col("month") / 12).cast("int"), F.col("month") % 12 + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0))))
    wanted = ranged(refs.groupBy("target", "key", "month").agg(F.count(F.lit(1)).alias("n")).withColumn("month_start", start))
    live = ranged(
        spans.groupBy("target", "key").agg(
            F.min(F.when(F.col("live_to").isNull(), micros("live_from"))).alias("open_from"), F.min(F.coalesce(micros("live_from"), F.lit(early))).alias("first_from")
        )
    )
    left = wanted.groupBy("target", "range").cogroup(live.groupBy("target", "range")).applyInArrow(_uncovered, _LEFT)
    left = Scratch(spark, "dangling").write(left, "uncovered")  # read for its hot keys and for its rows

    on = ["target", "key", "month"]
    found = salted_join(refs, left.drop("n"), on, spread=F.xxhash64("child_id", "at"), hot=hottest(left, on, "n"))
    t = micros("at")
    found = found.where(F.coalesce(t < F.col("open_from"), F.lit(True))).withColumn(
        "reason", F.when(~F.col("known"), "missing").when(t < F.col("first_from"), "late").otherwise("deleted")
    ).select("child_field", "child_id", "target", "key", "at", "reason")
    closed = spans.where("live_from IS NOT NULL AND live_to IS NOT NULL").groupBy("target", "key", "live_to").agg(F.min("live_from").alias("live_from"))
    hot = hottest(left.where("known").groupBy("target", "key").agg(F.sum("n").alias("n")), ["target", "key"], "n")
    dead = salted_join(found, closed, ["target", "key"], "left_anti", spread=F.xxhash64("child_id", "at"), hot=hot, condition=(F.col("reason") == "deleted") & (F.col("live_from") <= F.col("at")) & (F.col("live_to") > F.col("at")))
    day = F.date_from_unix_date(F.floor(F.unix_seconds("at") / 86400).cast("int"))  # of UTC, whatever the session's zone
    return dead.select("child_field", "child_id", F.date_format(day, "yyyy-MM").alias("ref_month"), "reason").distinct()
