"""Carriers that jump with notice: where each is, what is pending, and until when it cools down."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds after a jump in which no other can begin.
COOLDOWN_S = 300

STATES = "carrier long, place string, pending string, departs timestamp, cool_at timestamp, phase string"
_STATE = "place string, pending string, departs long, cool_at long, last long"


def _row(carrier: int, held: list, now: int) -> pd.DataFrame:
    place, pending, departs, cool_at, _ = held
    phase = "pending" if pending is not None else "cooling" if cool_at is not None and cool_at > now else "ready"
    stamp = lambda v: None if v is None else pd.Timestamp(v, unit="ms", tz="UTC")
    return pd.DataFrame({"carrier": [carrier], "place": [place], "pending": [pending], "departs": [stamp(departs)], "cool_at": [stamp(cool_at)], "phase": [phase]})


def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Requests, cancellations and arrivals in the order of their times; a timer tells when the carrier is ready again.

    An arrival ends what was pending and starts the cooldown; a cancellation only ends what was pending. Events that are
    older than the last one are passed over.
    """
    held = list(state.get) if state.exists else [None, None, None, None, None]
    if state.hasTimedOut:
        now = max(held[3] or 0, held[2] or 0)
        held[3] = None if held[3] is not None and held[3] <= now else held[3]
        state.update(tuple(held))
        yield _row(key[0], held, now)
        return
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["at", "event"], kind="stable")
    for r in rows.itertuples(index=False):
        t = int(pd.Timestamp(r.at).value // 1_000_000)
        if held[4] is not None and t < held[4]:
            continue
        if r.event == "CarrierJumpRequest":
            held[1], held[2] = r.place, None if pd.isna(r.departs) else int(pd.Timestamp(r.departs).value // 1_000_000)
        elif r.event == "CarrierJumpCancelled":
            held[1] = held[2] = None
        elif r.event in ("CarrierJump", "CarrierLocation"):
            if r.event == "CarrierJump":
                held[3] = t + COOLDOWN_S * 1000
            if r.event == "CarrierJump" or held[0] is None or held[1] == r.place:
                held[1] = held[2] = None
            held[0] = r.place
        held[4] = t
    if held[3] is not None and held[3] > state.getCurrentWatermarkMs():
        state.setTimeoutTimestamp(held[3])
    state.update(tuple(held))
    yield _row(key[0], held, held[4] or 0)


def followed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """events: carrier, event, at, place, departs. The state of each carrier as an update stream."""
    slim = events.select("carrier", "event", "at", "place", F.col("departs").cast("timestamp").alias("departs")).where("at IS NOT NULL AND carrier IS NOT NULL").withWatermark("at", late)
    return slim.groupBy("carrier").applyInPandasWithState(step, STATES, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
