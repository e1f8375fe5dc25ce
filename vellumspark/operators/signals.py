"""Stateful signals over ordered events: attempts, sessions, retries, bursts, recoveries, milestones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attempts(ev: DataFrame, opens: Column, ends: Column, adds: Column) -> DataFrame:
    """Numbers attempts: one starts at an open or after an end. Added files count once per attempt."""
    order = Window.partitionBy("session").orderBy("ts", "event_id")
    ended_before = F.coalesce(F.lag(F.when(ends, 1).otherwise(0)).over(order), F.lit(1))
    start = F.when(opens | (ended_before == 1), 1).otherwise(0)
    numbered = ev.withColumn("attempt", F.sum(start).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("session", "attempt").agg(
        F.count("*").alias("events"), F.max(F.when(adds, 1).otherwise(0)).alias("file_added"), F.max(F.when(ends, F.col("event"))).alias("result")
    )


def gap_sessions(ev: DataFrame, gap_seconds: int) -> DataFrame:
    """Visits of a session key, split where nothing happened for the gap."""
    order = Window.partitionBy("session").orderBy("ts", "event_id")
    quiet = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp")) > gap_seconds * 1_000_000
    numbered = ev.withColumn("visit", F.sum(F.when(F.coalesce(quiet, F.lit(True)), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("session", "visit").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events"))


def left_unfinished(ev: DataFrame, opens: Column, ends: Column) -> DataFrame:
    """Per (session, tool) the last start that no end followed."""
    times = ev.groupBy("session", "tool").agg(F.max(F.when(opens, F.col("ts"))).alias("started"), F.max(F.when(ends, F.col("ts"))).alias("ended"))
    return times.filter("started IS NOT NULL AND (ended IS NULL OR ended < started)").select("session", "tool", "started")


def bursts(clicks: DataFrame, within_ms: int = 1000, least: int = 3) -> DataFrame:
    """Clicks that complete a burst on one element: least clicks with now - t < within_ms."""
    order = Window.partitionBy("session", "target").orderBy("ms").rangeBetween(-(within_ms - 1), 0)
    return clicks.withColumn("n", F.count("*").over(order)).filter(F.col("n") >= least)


def _cool(pause_ms: int):
    def cool(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fired, last = [], None
        for ms in sorted(pdf["ms"]):
            if last is None or ms - last > pause_ms:
                fired.append(ms)
                last = ms
        return pd.DataFrame({"session": key[0], "target": key[1], "ms": fired})

    return cool


def rage_clicks(clicks: DataFrame, within_ms: int = 1000, least: int = 3, pause_ms: int = 5000) -> DataFrame:
    """Bursts that fire: not within pause_ms of the last one fired on the element. Only candidates reach Python."""
    kind = clicks.schema["session"].dataType.simpleString()
    found = bursts(clicks, within_ms, least).select("session", "target", "ms")
    return found.groupBy("session", "target").applyInPandas(_cool(pause_ms), f"session {kind}, target string, ms long")


def repeats(ev: DataFrame, keys: list[str]) -> DataFrame:
    """The second and later events of a key, numbered."""
    order = Window.partitionBy(*keys).orderBy("ts", "event_id")
    return ev.withColumn("nth", F.row_number().over(order)).filter("nth >= 2")


def follows_within(ev: DataFrame, event: Column, before: Column, seconds: float, inclusive: bool = False) -> DataFrame:
    """Events that come within some seconds after the last ``before`` event of the session: an as-of join by window."""
    order = Window.partitionBy("session").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    marked = ev.withColumn("last_ts", F.last(F.when(before, F.col("ts")), ignorenulls=True).over(order))
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / 1e6
    near = (gap <= seconds) if inclusive else (gap < seconds)
    return marked.filter(event).withColumn("gap", gap).filter((F.col("gap") >= 0) & near)


def first_action(ev: DataFrame, action: Column) -> DataFrame:
    """Per session seconds to the first action, or none."""
    per = ev.groupBy("session").agg(F.min("ts").alias("begun"), F.min(F.when(action, F.col("ts"))).alias("acted"))
    seconds = (F.unix_micros(F.col("acted").cast("timestamp")) - F.unix_micros(F.col("begun").cast("timestamp"))) / 1e6
    return per.select("session", F.round(seconds, 3).alias("seconds"), F.col("acted").isNull().alias("none"))


def milestones(ev: DataFrame, value: Column, marks: list[int]) -> DataFrame:
    """When each session first reached each mark."""
    reached = ev.withColumn("mark", F.explode(F.array(*[F.lit(m) for m in marks]))).filter(value >= F.col("mark"))
    return reached.groupBy("session", "mark").agg(F.min("ts").alias("reached"))

