"""Structural quality scores of converted documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: characters that end a sentence.
TERMINAL = ".!?:;…。！？：；؟)\"'”’»]"


def tables_check(tables: Column) -> Column:
    """Score of an array of tables (rows, cols, chars, in_textbox, regular)."""
    real = F.filter(tables, lambda t: ~t["in_textbox"] & (t["chars"] > 30))
    ghosts = F.size(F.filter(tables, lambda t: t["in_textbox"] & (t["chars"] > 30)))
    strips = F.size(F.filter(real, lambda t: (t["rows"] == 1) & (t["cols"] >= 2)))
    odd = F.size(F.filter(real, lambda t: ~t["regular"]))
    score = F.when(ghosts > 0, 1 - 0.6 * ghosts / F.greatest(F.lit(1), ghosts + F.size(real))).otherwise(1.0)
    score = score * F.when(strips >= 3, F.greatest(F.lit(0.65), F.pow(F.lit(0.96), strips))).otherwise(1.0)
    return score * F.when(odd > 0, F.greatest(F.lit(0.7), 1 - 0.1 * odd)).otherwise(1.0)


def paragraphs_check(body: Column, cells: Column, boxes: Column) -> Column:
    """Share of the text that can be edited; 0 for an empty document."""
    total = body + cells + boxes
    return F.when(total == 0, 0.0).otherwise((body + cells) / total)


def flow_check(lines: DataFrame) -> DataFrame:
    """doc_id, flow: penalties for hard breaks and for long lines that end in mid-sentence. lines: doc_id, line, breaks."""
    text = F.trim("line")
    judged = (F.length(text) >= 50) & ~text.rlike(r"[0-9" + "".join("\\" + c for c in TERMINAL) + "]$")
    fragments = F.when(judged, F.when(text.endswith("-"), 2).otherwise(1)).otherwise(0)
    sums = lines.filter(text != "").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(fragments).alias("fragments"), F.sum("breaks").alias("breaks"))
    broken = F.least(F.lit(0.4), F.col("breaks") / F.col("n") * 0.5)
    cut = F.least(F.lit(0.5), F.greatest(F.lit(0.0), F.col("fragments") / F.col("n") - 0.08) * 1.4)
    return sums.select("doc_id", F.round(F.greatest(F.lit(0.0), 1 - broken - cut), 6).alias("flow"))


def index_of(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted index from 0 to 100, one decimal; parts are rounded to three first, weights normalised."""
    whole = sum(w for _, w in parts.values())
    return F.round(F.greatest(F.lit(0.0), sum((F.round(c, 3) * (100 * w / whole) for c, w in parts.values()), F.lit(0.0))), 1)


def docx_index(tables: Column, paragraphs: Column, flow: Column) -> Column:
    return index_of({"tables": (tables, 0.20), "paragraphs": (paragraphs, 0.45), "flow": (flow, 0.35)})


def markdown_index(tables: Column, flow: Column) -> Column:
    return index_of({"tables": (tables, 0.36), "flow": (flow, 0.64)})


def sheet_consistency(rows: DataFrame) -> DataFrame:
    """Per sheet the most frequent number of cells (the smaller of equals) and 1 - 1.2 x the share of other rows. rows: sheet, cells."""
    counted = rows.groupBy("sheet", "cells").agg(F.count("*").alias("n"))
    best = counted.groupBy("sheet").agg(F.max(F.struct("n", (-F.col("cells")).alias("cells"))).alias("b"), F.sum("n").alias("total"))
    return best.select("sheet", (-F.col("b.cells")).alias("mode"), F.round(F.greatest(F.lit(0.0), 1 - 1.2 * (1 - F.col("b.n") / F.col("total"))), 6).alias("consistency"))


def confidence(scanned: Column, pages: Column, math: Column, chars: Column, median: Column, rtl: Column, lines: Column, visuals: Column) -> Column:
    """Conversion confidence from 0 to 100 with its grade."""
    lost = (
        F.least(F.lit(50.0), 60 * F.coalesce(F.try_divide(scanned, pages), F.lit(0)))
        + F.when(F.coalesce(F.try_divide(math, chars), F.lit(0)) > 0.03, 25).otherwise(0)
        + F.when(median < 9, 10).otherwise(0)
        + F.when(F.coalesce(F.try_divide(rtl, lines), F.lit(0)) > 0.3, 10).otherwise(0)
        + F.when(visuals > 5, 5).otherwise(0)
    )
    value = F.round(F.greatest(F.lit(0.0), 100 - lost), 1)
    return F.struct(value.alias("value"), F.when(value >= 80, "high").when(value >= 55, "medium").otherwise("low").alias("grade"))


def markdown_signals(text: Column) -> Column:
    """Counts of headings, list items, table rows and whether marks are unpaired."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    return F.struct(
        count(r"(?m)^#{1,6} ").alias("headings"),
        count(r"(?m)^[-*] ").alias("items"),
        count(r"(?m)^\|.*\|$").alias("table_rows"),
        ((count(r"\*\*") % 2 == 1) | (count(r"\$\$") % 2 == 1)).alias("unpaired"),
    )
