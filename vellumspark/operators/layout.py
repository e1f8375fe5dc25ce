"""Structure from positioned text: lines, paragraphs, columns, tables, headings, repeated furniture, Markdown.

Items are rows (doc_id, page, seq, x, y, width, size, text); y grows upwards. What depends on the order in
which items are met runs per page in Arrow batches of whole pages; document aggregates and everything after them are joins
and windows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions.text import mask_digits, word_count

LINE = "doc_id long, page int, line int, y double, x double, size double, text string"


def page_lines(items: pd.DataFrame, tolerance: float = 6.0) -> list[pd.DataFrame]:
    """Greedy lines of one page: an item joins the first line whose first y is within the tolerance."""
    heads: list[float] = []
    members: list[list[int]] = []
    for i, y in items.sort_values(["y", "x"], ascending=[False, True])["y"].items():
        for k, h in enumerate(heads):
            if abs(h - y) <= tolerance:
                members[k].append(i)
                break
        else:
            heads.append(y)
            members.append([i])
    return [items.loc[m].sort_values("x", kind="stable") for m in members]


ITEM = ("x", "y", "width", "size", "text", "seq")


def _tails(texts: pa.Array, gap: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a line built up to each item ends with a space: as its last text that isn't empty does, or since then a space was put in."""
    n = len(first)
    told = np.flatnonzero((pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0) | first)
    last = np.repeat(told, np.diff(np.append(told, n)))
    put = np.maximum.accumulate(np.where(gap, np.arange(n), -1))
    return pc.ends_with(texts, " ").to_numpy(zero_copy_only=False)[last] | (put > last)


def built_lines(pages: pa.Table, tolerance: float) -> pa.RecordBatch:
    """Lines of whole pages (doc_id, page, items). An item, from the top, joins the line of the one before unless it is further than the tolerance below that line's first y; a gap over 0.15 of the size is a space."""
    items = pages.column("items").combine_chunks()
    owner = np.repeat(np.arange(len(items)), items.value_lengths().to_numpy(zero_copy_only=False))
    x, y, width, size = (items.flatten().field(c).to_numpy(zero_copy_only=False).astype(float) for c in ITEM[:4])
    seq = items.flatten().field("seq").to_numpy(zero_copy_only=False)
    # from the top, and of each height one: heads of lines are more than the tolerance apart, so only the last can take an item
    order = np.lexsort((seq, x, -y, owner))
    o, h = owner[order], y[order]
    new = np.ones(len(order), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    at, page, head, line, lines_ = np.flatnonzero(new), -1, 0.0, -1, []
    for p, v in zip(o[at].tolist(), h[at].tolist()):
        if p != page:
            page, head, line = p, v, 0
        elif not head - v <= tolerance:
            head, line = v, line + 1
        lines_.append(line)
    number = np.repeat(np.array(lines_, int), np.diff(np.append(at, len(order))))
    # along each line
    again = np.lexsort((x[order], number, o))
    order, number = order[again], number[again]
    owner, x, y, width, size = (v[order] for v in (owner, x, y, width, size))
    texts = pc.fill_null(items.flatten().field("text").take(pa.array(order)).cast(pa.large_string()), "")
    first = np.ones(len(order), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])
    gap = ~first
    gap[1:] &= x[1:] - (x[:-1] + width[:-1]) > 0.15 * size[1:]
    space = gap.copy()
    space[1:] &= ~_tails(texts, gap, first)[:-1]
    pieces = pc.binary_join_element_wise(pc.if_else(pa.array(space), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())), texts, pa.scalar("", pa.large_string()))
    at = np.flatnonzero(first)
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(at, len(order)), pa.int64()), pieces), pa.scalar("", pa.large_string()))
    own = pa.array(owner[at])
    doc, page_ = (pages.column(c).combine_chunks().take(own) for c in ("doc_id", "page"))
    found = [doc.cast(pa.int64()), page_.cast(pa.int32()), pa.array(number[at], pa.int32()), pa.array(y[at]), pa.array(x[at]), pa.array(np.fmax.reduceat(size, at)), joined.cast(pa.string())]
    return pa.RecordBatch.from_arrays(found, [c.split()[0] for c in LINE.split(", ")])


def lines(items: DataFrame, tolerance: float = 6.0) -> DataFrame:
    """One row per line in reading order."""
    return lines_of_pages(items.groupBy("doc_id", "page").agg(F.collect_list(F.struct(*ITEM)).alias("items")), tolerance)


def lines_of_pages(pages: DataFrame, tolerance: float = 6.0) -> DataFrame:
    """The same from one row per page: doc_id, page, items (an array of the items' other columns). Some 100,000 items are built at a time, whole pages."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column("items").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(ends):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 100_000, "right")))
                yield built_lines(pa.Table.from_batches([batch.slice(start, stop - start)]), tolerance)
                start = stop

    return pages.filter(F.size("items") > 0).mapInArrow(build, LINE)


def upper_median(value: str) -> Column:
    """sorted[floor(n / 2)]: the upper of the two middle values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def median_sizes(items: DataFrame) -> DataFrame:
    return items.groupBy("doc_id").agg(F.coalesce(upper_median("size"), F.lit(10.0)).alias("median"))


def paragraphs(rows: DataFrame, pitch: float = 1.6, indent: float = 0.8) -> DataFrame:
    """Numbers paragraphs: one starts where the pitch is wide, the line is indented, or the page begins."""
    order = Window.partitionBy("doc_id").orderBy("page", "line")
    before_y, before_x, before_page = F.lag("y").over(order), F.lag("x").over(order), F.lag("page").over(order)
    start = before_page.isNull() | (before_page != F.col("page")) | (before_y - F.col("y") > pitch * F.col("size")) | (F.col("x") - before_x > indent * F.col("size"))
    return rows.withColumn("paragraph", F.sum(start.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def repeated_at_place(rows: DataFrame, pages: DataFrame, most: int = 60, near: float = 0.03) -> DataFrame:
    """Texts that stand at the same height on two thirds of a document's pages, three at least. pages: doc_id, n_pages, height."""
    text = F.trim("text")
    short = rows.withColumn("text", text).filter((F.length("text") <= most) & (F.col("text") != "") & ~F.col("text").rlike("^[0-9]+$"))
    once = short.groupBy("doc_id", "page", "text").agg(F.max("y").alias("y"))
    need = F.greatest(F.lit(3), F.ceil(F.col("n_pages") * 2 / 3))
    middle = once.groupBy("doc_id", "text").agg(upper_median("y").alias("middle"), F.count("*").alias("n")).join(pages, "doc_id").filter(F.col("n") >= need)
    held = once.join(middle, ["doc_id", "text"]).filter(F.abs(F.col("y") - F.col("middle")) <= near * F.col("height"))
    return held.groupBy("doc_id", "text").agg(F.count("*").alias("pages"), F.first("n_pages").alias("n_pages")).filter(F.col("pages") >= need).select("doc_id", "text", "pages")


def repeated_patterns(rows: DataFrame, pages: DataFrame, edge: int = 3) -> DataFrame:
    """Edge lines that repeat once digits are masked, on two thirds of the pages, three at least."""
    top = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line"))
    end = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("line")))
    edges = rows.withColumn("a", top).withColumn("b", end).filter((F.col("a") <= edge) | (F.col("b") <= edge))
    counted = edges.groupBy("doc_id", mask_digits(F.trim("text")).alias("pattern")).agg(F.countDistinct("page").alias("pages"))
    return counted.join(pages, "doc_id").filter((F.col("pages") >= F.greatest(F.lit(3), F.ceil(F.col("n_pages") * 2 / 3))) & (F.col("pattern") != "")).select("doc_id", "pattern", "pages")


def table_scores(rows: Column, columns: Column, stub: Column) -> Column:
    """(align, fill, confidence) of a table given as an array of arrays of cells."""
    filled = F.transform(rows, lambda r: F.size(F.filter(r, lambda c: F.trim(c) != "")))
    need = F.when(stub > 0.5, 1).otherwise(F.ceil(columns * 0.6))
    count = F.size(rows)
    align = F.size(F.filter(filled, lambda n: n >= need)) / count
    fill = F.aggregate(filled, F.lit(0.0), lambda a, n: a + n / columns) / count
    bonus = F.least(count / 10, F.lit(1.0)) * 0.15
    confidence = F.least(align * F.when(stub > 0.5, 0.70).otherwise(0.55) + fill * F.when(stub > 0.5, 0.15).otherwise(0.30) + bonus, F.lit(1.0))
    return F.struct(align.alias("align"), fill.alias("fill"), confidence.alias("confidence"))


def prose_not_data(rows: Column) -> Column:
    """A table whose body has no number and two or more words per cell (1.15 in eight or more columns)."""
    cells = F.filter(F.flatten(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))), lambda c: F.trim(c) != "")
    words = F.aggregate(F.transform(cells, word_count), F.lit(0), lambda a, n: a + n)
    density = F.try_divide(words, F.size(cells))
    wide = F.size(F.try_element_at(rows, F.lit(1))) >= 8
    return (F.size(rows) >= 2) & (F.size(cells) > 0) & ~F.exists(cells, lambda c: c.rlike("[0-9]")) & (density >= F.when(wide, 1.15).otherwise(2.0))


def page_direction(rows: DataFrame) -> DataFrame:
    """rtl per page: over half the lines have an RTL letter first."""
    return rows.groupBy("doc_id", "page").agg((F.avg(F.col("text").rlike(r"^[^A-Za-z]*[\x{0590}-\x{08FF}]").cast("int")) > 0.5).alias("rtl"))


def in_columns(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """The column region of each line: a range join on left <= x < right within the page."""
    own = regions.select(F.col("doc_id").alias("_doc"), F.col("page").alias("_page"), F.col("left").alias("_left"), F.col("right").alias("_right"), "region")
    same = (F.col("doc_id") == F.col("_doc")) & (F.col("page") == F.col("_page")) & (F.col("x") >= F.col("_left")) & (F.col("x") < F.col("_right"))
    return rows.join(own, same, "left").drop("_doc", "_page", "_left", "_right")


def column_gaps(items: DataFrame, bins: int = 100, page_width: float = 600.0, least_share: float = 0.0) -> DataFrame:
    """Widest empty band of each page's coverage profile: the gutter between two columns."""
    covered = items.withColumn("bin", F.explode(F.sequence(F.floor(F.col("x") / page_width * bins).cast("int"), F.floor((F.col("x") + F.col("width")) / page_width * bins).cast("int"))))
    counted = covered.groupBy("doc_id", "page", "bin").agg(F.count("*").alias("n"))
    after = F.lead("bin").over(Window.partitionBy("doc_id", "page").orderBy("bin"))
    gaps = counted.withColumn("gap", after - F.col("bin") - 1).filter("gap > 0")
    return gaps.groupBy("doc_id", "page").agg(F.max(F.struct(F.col("gap"), (-F.col("bin")).alias("at"))).alias("best")).select("doc_id", "page", (-F.col("best.at") + 1).alias("from_bin"), F.col("best.gap").alias("bins"))


def stitch_tables(tables: DataFrame) -> DataFrame:
    """Numbers runs of tables on consecutive pages with equal columns and nothing between. tables: doc_id, page, cols, clear_above, clear_below."""
    order = Window.partitionBy("doc_id").orderBy("page")
    goes_on = (F.lag("page").over(order) == F.col("page") - 1) & (F.lag("cols").over(order) == F.col("cols")) & F.lag("clear_below").over(order) & F.col("clear_above")
    start = F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)
    numbered = tables.withColumn("run", F.sum(start).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "run").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.first("cols").alias("cols"))


def heading_level(size: Column, median: Column) -> Column:
    ratio = size / median
    return F.when(ratio >= 2.2, 1).when(ratio >= 1.7, 2).when(ratio >= 1.3, 3)


def markdown(rows: DataFrame, medians: DataFrame) -> DataFrame:
    """Each document as Markdown: headings by size, list items, paragraphs of joined lines."""
    sized = rows.join(medians, "doc_id").withColumn("level", heading_level(F.col("size"), F.col("median")))
    numbered = paragraphs(sized)
    bullet = F.col("text").rlike("^[•◦▪‣●○]")
    block = F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text")).when(bullet, F.concat(F.lit("- "), F.trim(F.regexp_replace("text", "^[•◦▪‣●○]", "")))).otherwise(F.col("text"))
    lines_ = numbered.withColumn("block", block)
    joined = lines_.groupBy("doc_id", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "block"))), lambda x: x["block"]), " ").alias("block"))
    return joined.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "block"))), lambda x: x["block"]), "\n\n").alias("markdown"))


def conversion_stats(rows: DataFrame) -> DataFrame:
    """Counters of each document."""
    return rows.groupBy("doc_id").agg(
        F.countDistinct("page").alias("total_pages"),
        F.count("*").alias("total_lines"),
        F.sum(F.length("text")).alias("total_chars"),
        F.count_if(F.col("text").rlike(r"[\x{0590}-\x{08FF}]")).alias("rtl_lines"),
        F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[\x{2200}-\x{22FF}=<>±×÷]"))), F.lit(0)).cast("long").alias("math_chars"),
    )
