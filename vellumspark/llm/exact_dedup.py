"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z. A Misra-Gries summary (Spark's
``approx_top_k``) finds digests that may be frequent; their groups are counted exactly, and these
winners, at most ``heavy_limit`` rows, are broadcast so that the copies are settled map-side. All other
digests take an ordinary shuffle: a group there has at most about rows / ``heavy_limit`` copies (or
``heavy_min``); its best row and size are aggregated before the shuffle and joined back, so no group is ever
held together.

Defined cases: a null text counts as empty, and empty texts are copies of each other; a null id loses
against any other; of rows that share both text and the largest id one stays; texts of any length are hashed
whole; extra columns are ignored, whatever their names, and the filtering form passes them on; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import ascii_lower, cut, text_digest, text_or_empty, without


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (a number that tells repeated rows apart), text_sha256."""
    return docs.select(
        docs[id_col].alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.sha2(ascii_lower(text_or_empty(docs, text_col)).cast("binary"), 256).alias("text_sha256"),
    )


def heavy_digests(keyed: DataFrame, tracked: int, heavy_limit: int, heavy_min: int) -> list[str]:
    """Candidates from the Misra-Gries summary; a bounded list."""
    found = keyed.agg(F.expr(f"approx_top_k(text_sha256, {heavy_limit}, {tracked})").alias("top")).first()
    return [x["item"] for x in (found["top"] or []) if x["item"] is not None and x["count"] >= heavy_min]


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tracked: int = 8192,
    heavy_limit: int = 1024,
    heavy_min: int = 32,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = cut(digests(docs, id_col, text_col))
    spark = docs.sparkSession
    best = F.max(F.struct("doc_id", "row"))
    candidates = heavy_digests(keyed, tracked, heavy_limit, heavy_min)
    listed = F.broadcast(spark.createDataFrame([(x,) for x in candidates], "text_sha256 string"))
    winners = cut(keyed.join(listed, "text_sha256", "left_semi").groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("group_size")))
    heavy = keyed.join(F.broadcast(winners), "text_sha256")
    others = keyed.join(listed, "text_sha256", "left_anti")
    several = others.groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("group_size")).filter("group_size > 1")
    light = others.join(several, "text_sha256", "left").withColumns({"best": F.coalesce("best", F.struct("doc_id", "row")), "group_size": F.coalesce("group_size", F.lit(1))})
    columns = [
        F.col("doc_id"),
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("text_sha256"),
    ]
    return heavy.select(*columns).unionByName(light.select(*columns))


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The documents that exact_dedup keeps, with all their columns; rows that share an id but not a text are told apart."""
    copies = cut(exact_dedup(docs).filter("group_size > 1").select("doc_id", F.unhex("text_sha256").alias("digest"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stays")))
    keys = copies.groupBy(F.col("doc_id").alias("id"), "digest", "stays").agg(F.count("*").alias("n"))
    dropped, again = cut(keys.filter("NOT stays").select("id", "digest")), cut(keys.filter("stays AND n > 1").select("id", "digest"))
    return without(docs, text_digest(ascii_lower(text_or_empty(docs))), dropped, again)


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
