"""Finer operators on lines, cells, numbers and anchors."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions.text import mask_digits

BYTE_RANGE = re.compile(rb"/ByteRange\s*\[\s*(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s*\]")


def token_at(text: Column, at: Column, patterns: dict[str, str]) -> Column:
    """The personal-data match that covers a place (from 0), else the word there."""
    covers = F.when(F.lit(False), "")
    for pattern in patterns.values():
        found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
        start = lambda m: F.call_function("instr", text, m)
        hit = F.try_element_at(F.filter(found, lambda m: (start(m) <= at + 1) & (start(m) + F.length(m) > at + 1)), F.lit(1))
        covers = covers.when(hit.isNotNull(), hit)
    left = F.regexp_extract(F.substring(text, F.lit(1), at), r"(\S*)\z", 1)
    right = F.regexp_extract(F.substring(text, at + 1, F.length(text)), r"^(\S*)", 1)
    return F.coalesce(covers, F.concat(left, right))


def tokens_at(docs: DataFrame, places: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """The token at each place of the documents. places: doc_id, at."""
    return docs.join(places, "doc_id").select("doc_id", "at", token_at(F.col("text"), F.col("at"), patterns).alias("token"))


def doubled_words(words: DataFrame, near: float) -> DataFrame:
    """Words that an earlier line of the page holds, close by. words: page, line, x, y, text. A range join within the page."""
    a, b = words.alias("a"), words.alias("b")
    same = (F.col("a.page") == F.col("b.page")) & (F.col("b.line") < F.col("a.line")) & (F.abs(F.col("a.x") - F.col("b.x")) <= near) & (F.abs(F.col("a.y") - F.col("b.y")) <= near) & F.contains(F.col("b.text"), F.col("a.text"))
    return a.join(b, same, "left_semi")


def recipient_values(rows: DataFrame) -> DataFrame:
    """Per column of a recipient table the filled, distinct and skipped cells. rows: n, cells."""
    cells = rows.select("n", F.posexplode("cells").alias("column_no", "value")).withColumn("value", F.trim("value"))
    filled = F.when(F.col("value") != "", F.col("value"))
    return cells.groupBy("column_no").agg(F.count(filled).alias("filled"), F.countDistinct(filled).alias("different"), F.count_if(filled.isNull()).alias("skipped"))


def page_number_offsets(lines: DataFrame, least: int = 3) -> DataFrame:
    """Per document the offset of printed page numbers from the page's place, met most often (the smaller of equals). lines: doc_id, page, text."""
    numbers = lines.filter(F.trim("text").rlike("^[0-9]{1,4}$")).select("doc_id", "page", (F.trim("text").cast("int") - F.col("page")).alias("offset"))
    counted = numbers.groupBy("doc_id", "offset").agg(F.countDistinct("page").alias("pages")).filter(F.col("pages") >= least)
    best = counted.groupBy("doc_id").agg(F.max(F.struct("pages", (-F.col("offset")).alias("o"))).alias("b"))
    return best.select("doc_id", (-F.col("b.o")).alias("offset"), F.col("b.pages").alias("pages"))


def furniture_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Masked lines on a third of a document's pages, three at least. pages: doc_id, n_pages."""
    counted = lines.groupBy("doc_id", mask_digits(F.trim("text")).alias("masked")).agg(F.countDistinct("page").alias("pages"))
    return counted.join(pages, "doc_id").filter((F.col("masked") != "") & (F.col("pages") >= F.greatest(F.lit(3), F.col("n_pages") / 3))).select("doc_id", "masked", "pages")


def list_marks(lines: DataFrame) -> DataFrame:
    """Per document the numbers that stand as list marks."""
    mark = F.regexp_extract("line", r"^\s*([0-9]{1,3})[.)](?![0-9])", 1)
    return lines.select("doc_id", mark.alias("mark")).filter("mark <> ''").groupBy("doc_id").agg(F.count("*").alias("marks"), F.countDistinct("mark").alias("different"))


def beyond(old: Column, new: Column, size: Column, share: float, least: int) -> Column:
    """Whether a count rose beyond a share of the size, or beyond a least number."""
    return new - old > F.greatest(F.lit(float(least)), size * share)


def place_table(truth: DataFrame, output: DataFrame) -> DataFrame:
    """table_id, offset, matched: the row offset at which most cells of a table match. Both: table_id, row, col, text.

    Equal cells are joined by column and text, so offsets that match nothing are never made.
    """
    a, b = truth.select("table_id", "col", "text", F.col("row").alias("a")), output.select("table_id", "col", "text", F.col("row").alias("b"))
    votes = a.join(b, ["table_id", "col", "text"]).groupBy("table_id", (F.col("b") - F.col("a")).alias("offset")).agg(F.countDistinct("a", "col").alias("matched"))
    best = votes.groupBy("table_id").agg(F.max(F.struct("matched", (-F.abs("offset")).alias("near"), "offset")).alias("x"))
    return best.select("table_id", F.col("x.offset").alias("offset"), F.col("x.matched").alias("matched"))


def changed_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per page the share of its lines that the other version lacks; a page that is missing changed wholly. Both: doc_id, page, line."""
    def bag(x: DataFrame, name: str) -> DataFrame:
        return x.groupBy("doc_id", "page", "line").agg(F.count("*").alias(name))

    met = bag(old, "a").join(bag(new, "b"), ["doc_id", "page", "line"], "full_outer").na.fill(0, ["a", "b"])
    sums = met.groupBy("doc_id", "page").agg(F.sum(F.least("a", "b")).alias("same"), F.sum(F.greatest("a", "b")).alias("all_lines"))
    return sums.select("doc_id", "page", F.round(1 - F.col("same") / F.col("all_lines"), 6).alias("changed"))


def guard_gold(diff: DataFrame, approvals: DataFrame) -> DataFrame:
    """Gold files with removed lines and no approval. diff: file, sign, line; approvals: file."""
    removed = diff.filter(F.col("sign") == "-").groupBy("file").agg(F.count("*").alias("removed"))
    return removed.join(approvals, "file", "left_anti")


def left_margin(lines: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Per page the edge that most lines share within the tolerance, if three lines and 40 % do."""
    edge = F.round(F.col("x") / tolerance).cast("long")
    counted = lines.groupBy("doc_id", "page", edge.alias("edge")).agg(F.count("*").alias("n"), F.min("x").alias("x"))
    total = F.sum("n").over(Window.partitionBy("doc_id", "page"))
    order = Window.partitionBy("doc_id", "page").orderBy(F.desc("n"), "edge")
    best = counted.withColumn("total", total).withColumn("k", F.row_number().over(order)).filter("k = 1")
    return best.filter((F.col("n") >= 3) & (F.col("n") >= 0.4 * F.col("total"))).select("doc_id", "page", F.col("x").alias("margin"))


def cell_of(items: DataFrame, columns: DataFrame) -> DataFrame:
    """The grid column of each item: the right-most one that starts at or before it. items: page, x; columns: page, col, start."""
    both = items.select("page", F.col("x").alias("at"), "item", F.lit(None).cast("int").alias("col")).unionByName(columns.select("page", F.col("start").alias("at"), F.lit(None).cast("long").alias("item"), F.col("col").cast("int").alias("col")))
    before = Window.partitionBy("page").orderBy("at", F.col("item").isNotNull(), "col").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("col", F.last("col", ignorenulls=True).over(before)).filter("item IS NOT NULL").select("page", "item", "col")


def question_bands(lines: DataFrame, least_gap: float = 16.0) -> DataFrame:
    """Numbered questions of a worksheet with their band down to the next. lines: doc_id, y, x, text; numbers must rise, 16 points apart."""
    anchors = lines.withColumn("number", F.regexp_extract("text", r"^\s*([0-9]{1,3})[.)](?![0-9])", 1).try_cast("int")).filter("number IS NOT NULL")
    order = Window.partitionBy("doc_id").orderBy(F.desc("y"))
    kept = anchors.withColumn("before", F.lag("number").over(order)).withColumn("gap", F.lag("y").over(order) - F.col("y")).filter("before IS NULL OR (number > before AND gap >= %f)" % least_gap)
    return kept.withColumn("until", F.lead("y").over(order)).select("doc_id", "number", F.col("y").alias("top"), F.col("until").alias("bottom"))


def signatures(content: bytes) -> int:
    """Distinct byte ranges from 0 around a hole of hex digits inside the file."""
    found = set()
    for m in BYTE_RANGE.finditer(content):
        a, b, c, d = map(int, m.groups())
        hole = content[a + b : c].strip()
        if a == 0 and b < c <= c + d <= len(content) and hole[:1] == b"<" and re.fullmatch(rb"<[0-9a-fA-F]+>", hole):
            found.add((a, b, c, d))
    return len(found)


def count_signatures(files: DataFrame) -> DataFrame:
    schema = "path string, signatures int"
    return files.select("path", "content").mapInPandas(lambda it: (pd.DataFrame({"path": b["path"], "signatures": [signatures(bytes(c)) for c in b["content"]]}) for b in it), schema)
