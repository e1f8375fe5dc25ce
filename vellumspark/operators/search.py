"""Ranked search over a small index of names, tags and descriptions, with typing errors allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.functions.text import CJK

NONE = 99


def tolerance(word: Column) -> Column:
    n = F.length(word)
    return F.when(n <= 4, 1).when(n <= 8, 2).otherwise(3)


def word_distance(word: Column, phrase: Column) -> Column:
    """Least edit distance of a word to the words of a phrase, NONE beyond the word's tolerance."""
    best = F.array_min(F.transform(F.split(phrase, r"[\s-]+"), lambda w: F.levenshtein(word, w)))
    return F.when(best <= tolerance(word), best).otherwise(NONE)


def phrase_distance(query: Column, phrase: Column) -> Column:
    """Sum of the query's words' distances; one that finds nothing makes it NONE."""
    each = F.transform(F.split(query, r"\s+"), lambda w: word_distance(w, phrase))
    return F.when(F.exists(each, lambda x: x >= NONE), NONE).otherwise(F.aggregate(each, F.lit(0), lambda a, x: a + x))


def best_distance(query: Column, phrases: Column) -> Column:
    found = F.transform(phrases, lambda p: F.least(word_distance(query, p), phrase_distance(query, p)))
    return F.coalesce(F.array_min(found), F.lit(NONE))


def score(query: Column, names: Column, tags: Column, description: Column) -> Column:
    """Tiers: whole name, whole tag, beginnings, parts, CJK tags inside the query, near misses, description."""
    cjk = f"[{CJK}]"
    inside = F.filter(tags, lambda t: (F.length(t) >= 2) & t.rlike(cjk) & F.contains(query, t))
    near_name, near_tag = best_distance(query, names), best_distance(query, tags)
    near = F.least(near_name, near_tag)
    fuzzy = ~query.rlike("[0-9]") & (near < NONE)
    return (
        F.when(F.array_contains(names, query), 100)
        .when(F.array_contains(tags, query), 90)
        .when(F.exists(names, lambda n: F.startswith(n, query)), 80)
        .when(F.exists(tags, lambda t: F.startswith(t, query)), 70)
        .when(F.exists(names, lambda n: F.contains(n, query)), 60)
        .when(F.exists(tags, lambda t: F.contains(t, query)), 50)
        .when(query.rlike(cjk) & (F.size(inside) > 0), 40 + F.least(F.lit(9), F.coalesce(F.array_max(F.transform(inside, lambda t: F.length(t))), F.lit(0))))
        .when(fuzzy, 46 - 4 * near + F.when(near_name <= near_tag, 1).otherwise(0))
        .when(F.contains(description, query), 20)
        .otherwise(0)
    )


def search(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query, key, score for every hit. The index (names, tags, description) is a catalogue of bounded size and is broadcast.

    Queries under three characters (two if CJK) need a whole name or tag.
    """
    cleaned = queries.select("query", F.lower(F.trim("query")).alias("q")).filter(F.length("q") >= 2)
    least = F.when(F.col("q").rlike(f"[{CJK}]"), 2).otherwise(3)
    scored = cleaned.join(F.broadcast(index)).withColumn("score", score(F.col("q"), F.col("names"), F.col("tags"), F.col("description")))
    return scored.filter((F.col("score") >= 90) | ((F.length("q") >= least) & (F.col("score") > 0))).select("query", "key", "score")
