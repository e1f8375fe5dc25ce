"""Multiset metrics of texts: bags of tokens per document and side, their meets and differences, order, and comparison of runs.

A bag is rows (doc_id, token, n). Two bags meet in a full outer join on (doc_id, token); A & B is the sum of
least counts, A - B the sum of what exceeds.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bag(df: DataFrame, tokens: Column) -> DataFrame:
    return df.select("doc_id", F.explode(tokens).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc_id, token, a, b: counts on both sides."""
    left, right = a.select("doc_id", "token", F.col("n").alias("a")), b.select("doc_id", "token", F.col("n").alias("b"))
    return left.join(right, ["doc_id", "token"], "full_outer").na.fill(0, ["a", "b"])


def agreed(a: DataFrame, b: DataFrame) -> DataFrame:
    """The bag both readers have: the reference."""
    return pair(a, b).select("doc_id", "token", F.least("a", "b").alias("n")).filter("n > 0")


def recall(reference: DataFrame, output: DataFrame) -> DataFrame:
    """Per document the tokens kept, missing and extra, and the share kept."""
    met = pair(reference, output)
    sums = met.groupBy("doc_id").agg(
        F.sum("a").alias("reference"), F.sum(F.least("a", "b")).alias("kept"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("missing"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("extra")
    )
    return sums.withColumn("recall", F.when(F.col("reference") > 0, F.round(F.col("kept") / F.col("reference"), 6)))


def grams(words: Column, n: int) -> Column:
    """Adjacent n-grams of an array, joined by spaces."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))


def glued(reference_words: DataFrame, output: DataFrame) -> DataFrame:
    """Output words that the reference lacks but that join two of its adjacent words. reference_words: doc_id, words (array)."""
    joined = reference_words.select("doc_id", F.explode(grams(F.col("words"), 2)).alias("pair")).withColumn("token", F.replace("pair", F.lit(" "), F.lit(""))).groupBy("doc_id", "token").agg(F.count("*").alias("pairs"))
    known = bag(reference_words, F.col("words"))
    return output.join(known, ["doc_id", "token"], "left_anti").join(joined, ["doc_id", "token"]).select("doc_id", "token", F.least("n", "pairs").alias("n"))


def split_words(reference: DataFrame, output_words: DataFrame) -> DataFrame:
    """Adjacent output words whose joining the reference has and the output lacks."""
    joined = output_words.select("doc_id", F.explode(grams(F.col("words"), 2)).alias("pair")).withColumn("token", F.replace("pair", F.lit(" "), F.lit(""))).groupBy("doc_id", "token").agg(F.count("*").alias("pairs"))
    missing = reference.join(bag(output_words, F.col("words")), ["doc_id", "token"], "left_anti")
    return missing.join(joined, ["doc_id", "token"]).select("doc_id", "token", F.least("n", "pairs").alias("n"))


def spaced_letters(text: Column) -> Column:
    """Letters in runs of three or more single letters."""
    runs = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}])((?:\p{L} ){2,}\p{L})(?![\p{L}\p{N}])"), F.lit(1))
    return F.aggregate(runs, F.lit(0), lambda s, x: s + F.length(F.replace(x, F.lit(" "), F.lit(""))))


def longest_rise(values: list[int]) -> int:
    """Length of the longest strictly rising subsequence."""
    ends: list[int] = []
    for v in values:
        at = bisect_left(ends, v)
        ends[at : at + 1] = [v]
    return len(ends)


def order_kept(a: DataFrame, b: DataFrame, n: int = 4, least: int = 20) -> DataFrame:
    """Share of anchors (n-grams unique on both sides) that stand in the same order; null below ``least`` anchors.

    a and b: doc_id, words. Anchors are found by joins; only their places reach Python, one document at a time.
    """

    def unique(df: DataFrame, place: str) -> DataFrame:
        at = df.select("doc_id", F.posexplode(grams(F.col("words"), n)).alias(place, "gram"))
        return at.groupBy("doc_id", "gram").agg(F.count("*").alias("c"), F.min(place).alias(place)).filter("c = 1").drop("c")

    anchors = unique(a, "x").join(unique(b, "y"), ["doc_id", "gram"]).select("doc_id", "x", "y")

    def rise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        best = longest_rise(pdf.sort_values("x")["y"].tolist())
        return pd.DataFrame({"doc_id": [key[0]], "anchors": [len(pdf)], "in_order": [best], "share": [best / len(pdf) if len(pdf) >= least else None]})

    return anchors.groupBy("doc_id").applyInPandas(rise, "doc_id long, anchors long, in_order long, share double")


def percentile(df: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """key, value: the element at place floor(share * n) (from 0, the last at most) of each group's sorted values.

    Values are counted before the shuffle, so a group that holds most rows takes no more than its different values.
    """
    counted = df.groupBy(key, value).agg(F.count("*").alias("n"))
    by = Window.partitionBy(key)
    running = counted.select(key, F.col(value).alias("value"), F.sum("n").over(by.orderBy(value)).alias("until"), F.sum("n").over(by).alias("total"))
    at = F.least(F.col("total") - 1, F.floor(F.col("total") * share))
    return running.filter(F.col("until") > at).groupBy(key).agg(F.min("value").alias("value"))


def broken_paragraphs(lines: DataFrame) -> DataFrame:
    """Paragraph ends in mid-sentence whose next begins in lower case. lines: doc_id, n, line."""
    after = F.lead("line").over(Window.partitionBy("doc_id").orderBy("n"))
    cut = F.col("line").rlike("[a-z,]$") & F.col("following").rlike("^[a-z]")
    return lines.withColumn("following", after).groupBy("doc_id").agg(F.count_if(cut).alias("broken"), F.count("*").alias("paragraphs"))


def weighted_summary(rows: DataFrame, group: str, metric: str, size: str, worst: int = 8) -> DataFrame:
    """Size-weighted mean per group and its worst documents."""
    place = Window.partitionBy(group).orderBy(metric, "doc_id")
    ranked = rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= worst)
    means = rows.groupBy(group).agg(F.round(F.sum(F.col(metric) * F.col(size)) / F.sum(size), 6).alias("mean"), F.count("*").alias("documents"))
    return ranked.join(means, group).select(group, "mean", "documents", "place", "doc_id", metric)


def change(old: Column, new: Column, tolerance: float) -> Column:
    """better, worse or same, beyond a tolerance."""
    return F.when(new - old > tolerance, "better").when(old - new > tolerance, "worse").otherwise("same")


def compare_runs(old: DataFrame, new: DataFrame, metrics: dict[str, float]) -> DataFrame:
    """Per document lost, gained, worse, better, mixed or same. old and new: doc_id and the metrics."""
    a = old.select("doc_id", F.lit(True).alias("_old"), *[F.col(m).alias(f"{m}_old") for m in metrics])
    b = new.select("doc_id", F.lit(True).alias("_new"), *[F.col(m).alias(f"{m}_new") for m in metrics])
    moves = F.array(*[change(F.col(f"{m}_old"), F.col(f"{m}_new"), t) for m, t in metrics.items()])
    worse, better = F.array_contains(moves, "worse"), F.array_contains(moves, "better")
    verdict = F.when(F.col("_new").isNull(), "lost").when(F.col("_old").isNull(), "gained").when(worse & better, "mixed").when(worse, "worse").when(better, "better").otherwise("same")
    return a.join(b, "doc_id", "full_outer").select("doc_id", verdict.alias("verdict"))


def merge_shards(shards: list[DataFrame]) -> DataFrame:
    """Union of shards; a document in several shards is an error, found by a grouped count when the result is used."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    seen = F.count("*").over(Window.partitionBy("doc_id"))
    checked = out.withColumn("_seen", seen)
    return checked.withColumn("_ok", F.when(F.col("_seen") > 1, F.raise_error(F.concat(F.lit("document in several shards: "), F.col("doc_id").cast("string")))).otherwise(F.lit("ok"))).filter("_ok = 'ok'").drop("_seen", "_ok")


def fingerprint(rows: DataFrame, name: str, digest: str) -> DataFrame:
    """16 hex digits over all (name, digest), whatever their order: digests of rows are added up, then hashed.

    Adding replaces one sorted list of all rows, which no single task could hold.
    """
    own = F.conv(F.substring(F.sha2(F.concat(F.col(name).cast("string"), F.lit("\u0001"), F.col(digest)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(own), F.lit(0).cast("decimal(38,0)")).alias("s"))
    return total.select(F.substring(F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string")), 256), 1, 16).alias("fingerprint"))


def kept_by_all(rows: DataFrame, groups: int) -> DataFrame:
    """Documents that every one of the engines converted. rows: doc_id, engine."""
    return rows.groupBy("doc_id").agg(F.countDistinct("engine").alias("n")).filter(F.col("n") == groups).select("doc_id")


def stratified(rows: DataFrame, stratum: str, key: str, quota: int, seed: int) -> DataFrame:
    """A fixed draw of up to quota rows per stratum, ordered by a hash of seed and key; copies of a key count once."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    order = Window.partitionBy(stratum).orderBy("draw", key)
    single = rows.select(stratum, key).distinct().withColumn("draw", draw)
    return single.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= quota).drop("draw")


def holdout(rows: DataFrame, seen: DataFrame, stratum: str, key: str, quota: int, seed: int) -> DataFrame:
    """A stratified draw from what was not seen before."""
    return stratified(rows.join(seen.select(key), key, "left_anti"), stratum, key, quota, seed)


def missing_keys(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Keys that one side lacks, with which."""
    a, b = base.select(key).distinct(), other.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))
