"""Product-event analytics over rows of (event_id, ts, session, event, tool, target, locale, kind, value).

People are distinct sessions. Windows are relative to an ``as_of`` time, so that results can be repeated. Reports
that end in a limit break ties by their group columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def since(ev: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rows of the days up to as_of; a plain range on ts, so it reaches the scan."""
    return ev.filter(f"ts > timestamp_ntz'{as_of}' - interval '{days}' day AND ts <= timestamp_ntz'{as_of}'")


def people_by(ev: DataFrame, keys: list[str], where: Column | str | None = None, limit: int | None = None) -> DataFrame:
    """people and events per group, most people first."""
    found = ev.filter(where) if where is not None else ev
    counted = found.groupBy(*keys).agg(F.countDistinct("session").alias("people"), F.count("*").alias("events"))
    return counted.orderBy(F.desc("people"), F.desc("events"), *keys).limit(limit) if limit else counted


def sessions_with(ev: DataFrame, counts: dict[str, Column], having: Column | str) -> DataFrame:
    """Conditional counts per (tool, session), kept where ``having`` holds."""
    return ev.groupBy("tool", "session").agg(*[F.count_if(c).alias(n) for n, c in counts.items()]).filter(having)


def before_after(ev: DataFrame, moment: str, events: list[str]) -> DataFrame:
    """people and events before and after a moment."""
    period = F.when(F.col("ts") > F.lit(moment).cast("timestamp_ntz"), "after").otherwise("before")
    return people_by(ev.filter(F.col("event").isin(events)).withColumn("period", period), ["period", "event"])


def timeline(ev: DataFrame, sessions: DataFrame) -> DataFrame:
    """All events of the given sessions with their order in the session."""
    order = Window.partitionBy("session").orderBy("ts", "event_id")
    return ev.join(sessions, "session", "left_semi").select("session", "ts", "event_id", "event", F.row_number().over(order).alias("step"))


def growth(ev: DataFrame, as_of: str, flag: Column) -> DataFrame:
    """People of this and the last week, by cohort."""
    recent = since(ev, as_of, 14)
    period = F.when(F.expr(f"ts > timestamp_ntz'{as_of}' - interval '7' day"), "this_week").otherwise("last_week")
    return recent.groupBy(period.alias("period"), F.when(flag, "flagged").otherwise("rest").alias("cohort")).agg(F.countDistinct("session").alias("people"), F.count("*").alias("events"))


def fit_by(ev: DataFrame, keys: list[str], over: float) -> DataFrame:
    """people, events, mean value and how many exceed a bound."""
    return ev.groupBy(*keys).agg(
        F.countDistinct("session").alias("people"),
        F.count("*").alias("events"),
        F.round(F.avg("value"), 6).alias("mean_value"),
        F.count_if(F.col("value") > over).alias("over"),
    )


def shown_and_clicked(ev: DataFrame, shown: Column, clicked: Column) -> DataFrame:
    """Sessions that saw a hint, and sessions that used it, in one row."""
    return ev.agg(F.countDistinct(F.when(shown, F.col("session"))).alias("shown"), F.countDistinct(F.when(clicked, F.col("session"))).alias("clicked"))


def funnel(ev: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Sessions that reached each step, per tool. One row per (tool, session) first, so no distinct is expanded per step."""
    reached = ev.groupBy("tool", "session").agg(*[F.bool_or(c).alias(n) for n, c in steps.items()])
    return reached.groupBy("tool").agg(*[F.count_if(F.col(n)).alias(n) for n in steps])


def give_up(ev: DataFrame) -> DataFrame:
    """Progress at which sessions leave: last value per (tool, session), banded by tens."""
    last = ev.groupBy("tool", "session").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    banded = last.withColumn("progress", (F.floor(F.col("value") / 10) * 10).cast("long"))
    return banded.groupBy("tool", "progress").agg(F.count("*").alias("people"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("most"))


def traffic(ev: DataFrame, excluded: list[str], top: int) -> DataFrame:
    """Events per day of the busiest places, without the excluded ones."""
    kept = ev.filter(~F.col("locale").isin(excluded))
    best = kept.groupBy("locale").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "locale").limit(top)
    daily = kept.groupBy(F.to_date("ts").alias("day"), "locale").agg(F.count("*").alias("events"))
    return daily.join(best, "locale").select("day", "locale", "events", "total")
