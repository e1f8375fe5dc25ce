"""Queries over the event table, through roles: session = user, tool and target from the property k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.operators import analytics as A
from vellumspark.operators import signals as S
from vellumspark.plans.registry import query
from vellumspark.session import table

AS_OF = "2024-01-31 00:00:00"
MOMENT = "2024-01-16 00:00:00"

EV = """ev AS (SELECT event_id, ts, user_id AS session, event_type AS event, k, 't' || (k % 8) AS tool, 'target' || (k % 5) AS target,
 ['ET', 'UZ', 'KE', 'US', 'DE'][(user_id % 5)::INT + 1] AS locale, value, epoch_us(ts) AS us
 FROM (SELECT *, regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events))"""


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with named roles."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("user_id").alias("session"),
        F.col("event_type").alias("event"),
        k.alias("k"),
        F.concat(F.lit("t"), (k % 8).cast("string")).alias("tool"),
        F.concat(F.lit("target"), (k % 5).cast("string")).alias("target"),
        F.element_at(F.array(*[F.lit(x) for x in ("ET", "UZ", "KE", "US", "DE")]), (F.col("user_id") % 5 + 1).cast("int")).alias("locale"),
        "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
    )


def is_(name: str):
    return F.col("event") == name


WEEK = f"ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{AS_OF}'"
MONTH = f"ts > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND ts <= TIMESTAMP '{AS_OF}'"


def people_sql(keys: str, where: str, limit: int | None = None) -> str:
    end = f" ORDER BY people DESC, events DESC, {keys} LIMIT {limit}" if limit else ""
    return f"WITH {EV} SELECT {keys}, count(DISTINCT session) AS people, count(*) AS events FROM ev WHERE {where} GROUP BY {keys}{end}"


@query("a01_errors_by_type", people_sql("tool, event", f"{WEEK} AND event = 'error'", 60))
def a01(spark, d):
    return A.people_by(A.since(ev(spark, d), AS_OF, 7), ["tool", "event"], is_("error"), 60)


@query(
    "a02_sessions_with_file_and_error",
    f"WITH {EV} SELECT tool, session, count(*) FILTER (event = 'click') AS files_added, count(*) FILTER (event = 'error') AS errors, count(*) FILTER (event = 'purchase') AS done FROM ev WHERE {WEEK} GROUP BY ALL HAVING errors > 0 AND files_added > 0",
)
def a02(spark, d):
    return A.sessions_with(A.since(ev(spark, d), AS_OF, 7), {"files_added": is_("click"), "errors": is_("error"), "done": is_("purchase")}, "errors > 0 AND files_added > 0")


@query("a03_errors_with_context", people_sql("tool, event, target, locale, k", f"{WEEK} AND event = 'error'", 100))
def a03(spark, d):
    return A.people_by(A.since(ev(spark, d), AS_OF, 7), ["tool", "event", "target", "locale", "k"], is_("error"), 100)


@query("a04_rage_by_target", people_sql("tool, target", f"{WEEK} AND event = 'click'", 40))
def a04(spark, d):
    return A.people_by(A.since(ev(spark, d), AS_OF, 7), ["tool", "target"], is_("click"), 40)


@query("a05_search_misses", people_sql("locale, k", f"{MONTH} AND event = 'view' AND value < 5", 50))
def a05(spark, d):
    return A.people_by(A.since(ev(spark, d), AS_OF, 30), ["locale", "k"], is_("view") & (F.col("value") < 5), 50)


@query("a06_before_after", f"WITH {EV} SELECT CASE WHEN ts > TIMESTAMP '{MOMENT}' THEN 'after' ELSE 'before' END AS period, event, count(DISTINCT session) AS people, count(*) AS events FROM ev WHERE event IN ('error', 'purchase', 'click') GROUP BY ALL")
def a06(spark, d):
    return A.before_after(ev(spark, d), MOMENT, ["error", "purchase", "click"])


@query("a07_timeline", f"WITH {EV} SELECT session, ts, event_id, event, row_number() OVER (PARTITION BY session ORDER BY ts, event_id)::INT AS step FROM ev WHERE session IN (SELECT session FROM ev WHERE event = 'error' AND value > 45 AND tool = 't3')")
def a07(spark, d):
    events = ev(spark, d)
    return A.timeline(events, events.filter((F.col("event") == "error") & (F.col("value") > 45) & (F.col("tool") == "t3")).select("session").distinct())


@query(
    "a08_growth",
    f"WITH {EV} SELECT CASE WHEN ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN 'this_week' ELSE 'last_week' END AS period, CASE WHEN locale = 'ET' THEN 'flagged' ELSE 'rest' END AS cohort, count(DISTINCT session) AS people, count(*) AS events FROM ev WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AND ts <= TIMESTAMP '{AS_OF}' GROUP BY ALL",
)
def a08(spark, d):
    return A.growth(ev(spark, d), AS_OF, F.col("locale") == "ET")


FIT = "count(DISTINCT session) AS people, count(*) AS events, round(avg(value), 6) AS mean_value, count(*) FILTER (value > {}) AS over FROM ev"


@query("a09_target_fit", f"WITH {EV} SELECT target, event, {FIT.format(50)} GROUP BY target, event")
def a09(spark, d):
    return A.fit_by(ev(spark, d), ["target", "event"], 50)


@query("a10_duration_by_band", f"WITH {EV} SELECT CASE WHEN k <= 5 THEN '1-5' WHEN k <= 20 THEN '6-20' WHEN k <= 100 THEN '21-100' ELSE '>100' END AS band, {FIT.format(120)} GROUP BY band")
def a10(spark, d):
    from vellumspark.functions.bands import count_band

    return A.fit_by(ev(spark, d).withColumn("band", count_band(F.col("k"))), ["band"], 120)


@query("a11_notices", people_sql("event, tool", f"{MONTH} AND (event = 'signup' OR (event = 'view' AND value > 100) OR (event = 'click' AND target = 'target2'))"))
def a11(spark, d):
    found = is_("signup") | (is_("view") & (F.col("value") > 100)) | (is_("click") & (F.col("target") == "target2"))
    return A.people_by(A.since(ev(spark, d), AS_OF, 30), ["event", "tool"], found)


@query("a12_rejected_by_kind", people_sql("target", f"{WEEK} AND event = 'error' AND value < 30", 30))
def a12(spark, d):
    return A.people_by(A.since(ev(spark, d), AS_OF, 7), ["target"], is_("error") & (F.col("value") < 30), 30)


@query("a13_hint_ab", f"WITH {EV} SELECT count(DISTINCT CASE WHEN event = 'view' AND tool = 't1' THEN session END) AS shown, count(DISTINCT CASE WHEN event = 'click' AND tool = 't1' THEN session END) AS clicked FROM ev")
def a13(spark, d):
    at = F.col("tool") == "t1"
    return A.shown_and_clicked(ev(spark, d), is_("view") & at, is_("click") & at)


@query("a13b_saved_after_handoff", f"WITH {EV} SELECT tool, session, count(*) FILTER (event = 'signup') AS handed, count(*) FILTER (event = 'purchase') AS saved FROM ev GROUP BY ALL HAVING handed > 0 AND saved > 0")
def a13b(spark, d):
    return A.sessions_with(ev(spark, d), {"handed": is_("signup"), "saved": is_("purchase")}, "handed > 0 AND saved > 0")


STEPS = {"opened": "view", "added": "click", "pressed": "signup", "succeeded": "purchase", "errored": "error"}


@query("a14_funnel", f"WITH {EV} SELECT tool, " + ", ".join(f"count(DISTINCT CASE WHEN event = '{v}' THEN session END) AS {n}" for n, v in STEPS.items()) + " FROM ev GROUP BY tool")
def a14(spark, d):
    return A.funnel(ev(spark, d), {n: is_(v) for n, v in STEPS.items()})


@query(
    "a15_give_up",
    f"WITH {EV}, l AS (SELECT tool, session, arg_max(value, (ts, event_id)) AS value FROM ev GROUP BY ALL) SELECT tool, (floor(value / 10) * 10)::BIGINT AS progress, count(*) AS people, round(avg(value), 6) AS mean_value, max(value) AS most FROM l GROUP BY ALL",
)
def a15(spark, d):
    return A.give_up(ev(spark, d))


@query(
    "a16_traffic",
    f"WITH {EV}, kept AS (SELECT * FROM ev WHERE locale <> 'UZ'), best AS (SELECT locale, count(*) AS total FROM kept GROUP BY 1 ORDER BY total DESC, locale LIMIT 3) SELECT ts::DATE AS day, locale, count(*) AS events, any_value(total) AS total FROM kept JOIN best USING (locale) GROUP BY 1, 2",
)
def a16(spark, d):
    return A.traffic(ev(spark, d), ["UZ"], 3)


# ---- stateful signals


@query(
    "b13_attempts",
    f"""WITH {EV}, e AS (SELECT *, coalesce(lag(CASE WHEN event IN ('purchase', 'error') THEN 1 ELSE 0 END) OVER o, 1) AS ended FROM ev WINDOW o AS (PARTITION BY session ORDER BY ts, event_id)),
    n AS (SELECT *, sum(CASE WHEN event = 'view' OR ended = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS attempt FROM e)
    SELECT session, attempt::BIGINT AS attempt, count(*) AS events, max(CASE WHEN event = 'click' THEN 1 ELSE 0 END) AS file_added, max(CASE WHEN event IN ('purchase', 'error') THEN event END) AS result FROM n GROUP BY ALL""",
)
def b13(spark, d):
    return S.attempts(ev(spark, d), is_("view"), F.col("event").isin("purchase", "error"), is_("click"))


@query(
    "b14_gap_sessions",
    f"""WITH {EV}, e AS (SELECT *, CASE WHEN us - lag(us) OVER o <= 7200000000 THEN 0 ELSE 1 END AS new FROM ev WINDOW o AS (PARTITION BY session ORDER BY ts, event_id)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS visit FROM e)
    SELECT session, visit, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM n GROUP BY ALL""",
)
def b14(spark, d):
    return S.gap_sessions(ev(spark, d), 7200)


@query(
    "b15_left_unfinished",
    f"WITH {EV}, t AS (SELECT session, tool, max(CASE WHEN event = 'view' THEN ts END) AS started, max(CASE WHEN event IN ('purchase', 'error') THEN ts END) AS ended FROM ev GROUP BY ALL) SELECT session, tool, started FROM t WHERE started IS NOT NULL AND (ended IS NULL OR ended < started)",
)
def b15(spark, d):
    return S.left_unfinished(ev(spark, d), is_("view"), F.col("event").isin("purchase", "error"))


CLICKS = f"WITH {EV}, c AS (SELECT session, target, us // 1000000 AS ms FROM ev WHERE event = 'click')"  # seconds stand for milliseconds, as the table is sparse


def clicks(spark, d):
    return ev(spark, d).filter("event = 'click'").select("session", "target", F.expr("us div 1000000").alias("ms"))


@query("b16_burst_candidates", f"{CLICKS} SELECT * FROM (SELECT session, target, ms, count(*) OVER (PARTITION BY session, target ORDER BY ms RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS n FROM c) WHERE n >= 3")
def b16(spark, d):
    return S.bursts(clicks(spark, d), 86400, 3)


@query("b16_rage_clicks")
def b16_fired(spark, d):
    return S.rage_clicks(clicks(spark, d), 86400, 3, 200000)


@query("b17_same_input_retry", f"WITH {EV} SELECT * FROM (SELECT session, k, event_id, row_number() OVER (PARTITION BY session, k ORDER BY ts, event_id)::INT AS nth FROM ev WHERE event = 'click') WHERE nth >= 2")
def b17(spark, d):
    return S.repeats(ev(spark, d).filter("event = 'click'"), ["session", "k"]).select("session", "k", "event_id", "nth")


FOLLOW = f"""WITH {EV}, e AS (SELECT *, last_value(CASE WHEN event = '{{before}}' THEN us END IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_us FROM ev)
    SELECT session, event_id, (us - last_us) / 1e6 AS gap FROM e WHERE event = '{{event}}' AND us - last_us >= 0 AND (us - last_us) / 1e6 {{op}} {{seconds}}"""


@query("b18_quick_retry", FOLLOW.format(before="purchase", event="click", op="<", seconds=3600))
def b18(spark, d):
    return S.follows_within(ev(spark, d), is_("click"), is_("purchase"), 3600).select("session", "event_id", "gap")


@query("b19_auto_download_recovery", FOLLOW.format(before="signup", event="view", op="<=", seconds=7200))
def b19(spark, d):
    return S.follows_within(ev(spark, d), is_("view"), is_("signup"), 7200, inclusive=True).select("session", "event_id", "gap")


@query(
    "b21_first_interaction",
    f"WITH {EV}, p AS (SELECT session, min(us) AS begun, min(CASE WHEN event = 'click' THEN us END) AS acted FROM ev GROUP BY 1) SELECT session, round((acted - begun) / 1e6, 3) AS seconds, acted IS NULL AS none FROM p",
)
def b21(spark, d):
    return S.first_action(ev(spark, d), is_("click"))


@query("b22_scroll_milestones", f"WITH {EV}, m AS (SELECT unnest([25, 50, 75, 100]) AS mark) SELECT session, mark, min(ts) AS reached FROM ev JOIN m ON ev.k + 1 >= m.mark WHERE event = 'view' GROUP BY ALL")
def b22(spark, d):
    return S.milestones(ev(spark, d).filter("event = 'view'"), F.col("k") + 1, [25, 50, 75, 100])
