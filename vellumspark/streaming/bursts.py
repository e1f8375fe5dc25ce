"""Streaming forms: windowed counts with a watermark, and rage clicks with their pause as state.

Late events: rows older than the watermark are dropped by the windowed count. The rage-click state keeps the
last clicks of each element, so rows of a batch are sorted first; a click older than the last one fired on
its element cannot fire.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_errors(ev: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events of each type per window of the event time. Times without a zone are read as UTC."""
    timed = ev.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("people"))


def rage_clicks(clicks: DataFrame, within_ms: int = 1000, least: int = 3, pause_ms: int = 5000) -> DataFrame:
    """session, target, ms of every burst that fires. State per element: the clicks within reach and the last one fired."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        fired = []
        for ms in sorted(int(x) for b in batches for x in b["ms"]):
            held = [x for x in held if ms - x < within_ms] + [ms]
            if len(held) >= least and (last is None or ms - last > pause_ms):
                fired.append(ms)
                last = ms
        state.update((held, last))
        if fired:
            yield pd.DataFrame({"session": key[0], "target": key[1], "ms": fired})

    return clicks.groupBy("session", "target").applyInPandasWithState(update, "session long, target string, ms long", "held array<long>, last long", "append", GroupStateTimeout.NoTimeout)
