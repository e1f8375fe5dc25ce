"""Page lists as rows: merging, interleaving, splitting, ordering, numbering, grids and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(files: DataFrame, blanks: str = "none") -> DataFrame:
    """Pages of each job's files (job, file, pages) one after another: job, pos, file, page. blanks: none, odd or always, after each file but the last.

    Offsets are a running sum over a job's files, so pages are expanded after it, in parallel.
    """
    order = Window.partitionBy("job").orderBy("file")
    last = F.lead("file").over(order).isNull()
    blank = {"none": F.lit(0), "odd": F.col("pages") % 2, "always": F.lit(1)}[blanks]
    sized = files.withColumn("blank", F.when(last, 0).otherwise(blank).cast("long"))
    placed = sized.withColumn("offset", F.coalesce(F.sum(F.col("pages") + F.col("blank")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pages = F.sequence(F.lit(1).cast("long"), F.col("pages") + F.col("blank"))
    rows = placed.filter("pages + blank > 0").select("job", "file", "pages", "offset", F.explode(pages).alias("page"))
    return rows.select("job", (F.col("offset") + F.col("page")).alias("pos"), "file", F.when(F.col("page") <= F.col("pages"), F.col("page")).alias("page"))


def alternate(pages: DataFrame, reverse_others: bool = False) -> DataFrame:
    """One page of each file in turn. pages: doc, file, page."""
    back = reverse_others & (F.col("file") > 1) if reverse_others else F.lit(False)
    k = F.when(back, F.count("*").over(Window.partitionBy("doc", "file")) - F.col("page") + 1).otherwise(F.col("page"))
    return pages.withColumn("k", k).withColumn("pos", F.row_number().over(Window.partitionBy("doc").orderBy("k", "file"))).drop("k")


def extract(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted pages (doc, pos, page) that exist, numbered anew in their order."""
    found = wanted.join(pages.select("doc", "page"), ["doc", "page"], "left_semi")
    return found.withColumn("new_page", F.row_number().over(Window.partitionBy("doc").orderBy("pos"))).select("doc", "page", "new_page")


def organize(order: DataFrame) -> DataFrame:
    """Order lists (doc, pos, kind, page, rotation, width, height) with their defaults: blank pages are 612 x 792."""
    return order.select(
        "doc", "pos", F.when(F.col("kind") == "source", F.col("page")).alias("page"), F.pmod(F.coalesce("rotation", F.lit(0)), F.lit(360)).alias("rotation"),
        F.when(F.col("kind") == "blank", F.coalesce("width", F.lit(612.0))).alias("width"), F.when(F.col("kind") == "blank", F.coalesce("height", F.lit(792.0))).alias("height"),
    )


def rotate(pages: DataFrame, turns: DataFrame) -> DataFrame:
    """Angles set by the last turn (doc, seq, page, angle) of each page."""
    last = turns.groupBy("doc", "page").agg(F.max_by("angle", "seq").alias("angle"))
    return pages.join(last, ["doc", "page"], "left").withColumn("angle", F.pmod(F.coalesce("angle", F.lit(0)), F.lit(360)))


def page_numbers(pages: DataFrame, first: int, start_at: int, total: bool, skip_first: bool = False, prefix: str = "", suffix: str = "") -> DataFrame:
    """Labels of the pages from ``first`` on. pages: doc, page, page_count."""
    begin = max(first, 2) if skip_first and first <= 1 else first
    number = F.col("page") - begin + start_at
    last = start_at + F.col("page_count") - begin
    label = F.concat(F.lit(prefix), number.cast("string"), F.concat(F.lit(" / "), last.cast("string")) if total else F.lit(""), F.lit(suffix))
    return pages.filter(F.col("page") >= begin).select("doc", "page", label.alias("label"))


def booklet(pages: DataFrame) -> DataFrame:
    """Sheet, side and slot of each page of a folded booklet. pages: doc, page, page_count."""
    total = (F.ceil(F.col("page_count") / 4) * 4).cast("long")
    p = F.col("page")
    mirror = F.least(p, total + 1 - p)
    sheet = F.floor((mirror + 1) / 2).cast("long")
    side = F.when(mirror % 2 == 1, "front").otherwise("back")
    left = F.when(side == "front", p > total / 2).otherwise(p <= total / 2)
    return pages.select("doc", "page", sheet.alias("sheet"), side.alias("side"), F.when(left, "left").otherwise("right").alias("slot"))


def fit_scale(width: Column, height: Column, room_width: Column, room_height: Column, mode: str) -> Column:
    """fill takes the larger ratio, actual is 1, fit never enlarges."""
    if mode == "actual":
        return F.lit(1.0)
    x, y = room_width / width, room_height / height
    return F.greatest(x, y) if mode == "fill" else F.least(F.lit(1.0), x, y)


def halves(pages: DataFrame, rtl: bool = True) -> DataFrame:
    """Pages in two halves unless skipped; the right one first when rtl. pages: doc, page, skip."""
    names = ["right", "left"] if rtl else ["left", "right"]
    parts = F.when(F.col("skip"), F.array(F.lit("whole"))).otherwise(F.array(*[F.lit(n) for n in names]))
    return pages.select("doc", "page", F.posexplode(parts).alias("part", "half")).withColumn("pos", F.row_number().over(Window.partitionBy("doc").orderBy("page", "part"))).select("doc", "page", "half", "pos")


def crop(boxes: DataFrame, pad: float = 0.02) -> DataFrame:
    """Crop edges per document: medians of the pages' edges, padded and held within the page. boxes: doc, left, right."""
    middle = lambda c: F.percentile(c, F.lit(0.5))
    return boxes.groupBy("doc").agg(F.round(F.greatest(middle("left") - pad, F.lit(0.0)), 6).alias("left"), F.round(F.least(middle("right") + pad, F.lit(1.0)), 6).alias("right"))


def tiles(pages: DataFrame, across: int, down: int) -> DataFrame:
    """Centres of a watermark grid on each page. pages: doc, page, width, height."""
    grid = pages.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    return grid.select("doc", "page", "i", "j", F.round(F.col("width") * (F.col("i") + 0.5) / across, 6).alias("x"), F.round(F.col("height") * (F.col("j") + 0.5) / down, 6).alias("y"))


def drop_same_images(images: DataFrame) -> DataFrame:
    """Each image with the first one of the same length and digest. images: doc, image, size, digest."""
    first = F.min("image").over(Window.partitionBy("doc", "size", "digest"))
    return images.withColumn("kept", first)


def field_names(fields: DataFrame) -> DataFrame:
    """Clean names, made unique by a number. fields: doc, seq, name."""
    clean = F.trim(F.translate(F.regexp_replace(F.coalesce("name", F.lit("")), r"[\x{00}-\x{1F}]", ""), ".", "_"))
    named = fields.withColumn("clean", F.when(clean == "", F.concat(F.lit("Field "), F.col("seq").cast("string"))).otherwise(clean))
    nth = F.row_number().over(Window.partitionBy("doc", "clean").orderBy("seq"))
    return named.withColumn("nth", nth).select("doc", "seq", F.when(F.col("nth") > 1, F.concat("clean", F.lit(" ("), F.col("nth").cast("string"), F.lit(")"))).otherwise(F.col("clean")).alias("unique_name"))
