"""Gates on what clients send: spam, formula injection, data points, feedback and event bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def looks_like_spam(text: Column) -> Column:
    """More than one address, digits only, or one character ten times running."""
    return F.coalesce((F.regexp_count(text, F.lit("(?i)https?://")) > 1) | text.rlike("^[0-9]+$") | text.rlike(r"(.)\1{9,}"), F.lit(False))


def sheet_safe(text: Column) -> Column:
    """A quote before what a spreadsheet would read as a formula."""
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def data_point(event: Column, props: Column) -> Column:
    """Positional form of an event: index, up to 20 texts and 20 numbers. Keys that begin with x_ go last.

    props is a map of strings; locale, tool and session lead the texts, what reads as a finite number is a number.
    """
    lead = F.array(*[F.substring(F.coalesce(F.try_element_at(props, F.lit(k)), F.lit("")), 1, 100) for k in ("locale", "tool", "session")])
    rest = F.filter(F.map_entries(props), lambda e: ~e["key"].isin("locale", "tool", "session"))
    rest = F.concat(F.filter(rest, lambda e: ~e["key"].startswith("x_")), F.filter(rest, lambda e: e["key"].startswith("x_")))
    number = lambda e: F.when(e["value"].rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.trim(e["value"]).try_cast("double"))
    texts = F.transform(F.filter(rest, lambda e: number(e).isNull()), lambda e: F.substring(F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))), 1, 200))
    numbers = F.transform(F.filter(rest, lambda e: number(e).isNotNull()), number)
    return F.struct(F.substring(event, 1, 96).alias("index"), F.slice(F.concat(lead, texts), 1, 20).alias("texts"), F.slice(numbers, 1, 20).alias("numbers"))


def gate_events(requests: DataFrame, blocked: tuple[str, ...] = ("UZ",), most_bytes: int = 8192) -> DataFrame:
    """Requests (method, origin, host, country, body) with the reason they are refused, or their event."""
    parsed = F.from_json("body", "event string, props map<string,string>", {"mode": "PERMISSIVE"})
    name = F.trim(F.get_json_object("body", "$.event"))
    reason = (
        F.when(F.upper("method") != "POST", "method")
        .when(F.col("origin").isNull() | (F.col("origin") != F.concat(F.lit("https://"), F.col("host"))), "origin")
        .when(F.octet_length("body") > most_bytes, "size")
        .when(name.isNull() | (name == ""), "event")
        .when(F.col("country").isin(*blocked), "country")
    )
    return requests.withColumn("reason", reason).withColumn("event", F.when(F.col("reason").isNull(), name)).withColumn("props", F.when(F.col("reason").isNull(), parsed["props"]))


def gate_feedback(rows: DataFrame, kinds: tuple[str, ...] = ("bug", "idea", "question", "waitlist"), least: int = 3) -> DataFrame:
    """Feedback (kind, message, email, honeypot) cut to its limits, with the reason it is refused."""
    message = F.substring(F.trim("message"), 1, 1000)
    email = F.substring(F.coalesce(F.col("email"), F.lit("")), 1, 200)
    reason = (
        F.when(~F.col("kind").isin(*kinds), "kind")
        .when((F.coalesce("honeypot", F.lit("")) != "") & (F.col("honeypot") != email), "honeypot")
        .when((F.col("kind") == "waitlist") & (email == ""), "email")
        .when((F.col("kind") != "waitlist") & (F.length(message) < least), "short")
        .when(looks_like_spam(message), "spam")
    )
    return rows.select("*", message.alias("clean_message"), email.alias("clean_email"), reason.alias("reason"))
