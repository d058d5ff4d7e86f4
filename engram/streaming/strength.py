"""Strengths of a stream of touches, kept up to date by Structured Streaming.

The state of a row is (strength, last, accesses); an event later than the watermark's delay is dropped, one that comes
out of order within it counts as if no time had passed, as a clock that runs backwards does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import memory as M

OUTPUT = "rid long, strength double, last double, accesses long"
STATE = "strength double, last double, accesses long"


def fold_events(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    strength, last, n = state.get if state.exists else (None, None, 0)
    for f in frames:
        for ts, kind, boost in f.sort_values(["at", "seq"])[["at", "kind", "boost"]].itertuples(index=False):
            if strength is None:  # the first event of a row is its birth
                strength, last = M.INITIAL, ts
            now = max(last, ts)
            strength *= 2.0 ** (-(now - last) / M.HALF_LIFE)
            last = now
            if kind == "reset":
                strength = 0.0
            else:
                strength, n = min(strength + boost, M.MAX_STRENGTH), n + 1
    state.update((strength, last, n))
    yield pd.DataFrame([(key[0], strength, last, n)], columns=["rid", "strength", "last", "accesses"])


def strengths(touches: DataFrame, delay: str = "1 hour") -> DataFrame:
    """touches: a stream of rid, ts (timestamp), seq, kind (touch or reset), boost. Gives rid, strength (as of last), last, accesses, in update mode."""
    timed = touches.withWatermark("ts", delay).select(
        F.col("rid").cast("long").alias("rid"), F.col("ts").cast("double").alias("at"), F.col("seq").cast("long").alias("seq"), "kind", F.col("boost").cast("double").alias("boost")
    )
    return timed.groupBy("rid").applyInPandasWithState(fold_events, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def touches_per_window(touches: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """rid, window start and end, and touches in it: a windowed count with late data up to the delay."""
    counted = touches.withWatermark("ts", delay).where("kind = 'touch'").groupBy(F.window("ts", window).alias("w"), "rid").agg(F.count("*").alias("touches"))
    return counted.select("rid", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "touches")
