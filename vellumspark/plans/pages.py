"""Queries of the page-list, layout, web and streaming operators. Document lines stand for pages and items."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.operators import layout as L
from vellumspark.operators import pagelists as P
from vellumspark.operators import web as H
from vellumspark.plans.registry import query
from vellumspark.plans.text import LINES, docs, lines
from vellumspark.session import checkpoint_dir, table
from vellumspark.streaming import bursts

# ---- page lists: parts are files, their size the page count; four files make a job


def files(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.select(F.floor(F.col("p_partkey") / 4).cast("long").alias("job"), F.col("p_partkey").alias("file"), (F.col("p_size") % 7).cast("long").alias("pages"))


def file_pages(spark: SparkSession, d: str) -> DataFrame:
    own = files(spark, d).filter("pages > 0")
    return own.select(F.col("job").alias("doc"), (F.col("file") % 4).cast("int").alias("file"), F.explode(F.sequence(F.lit(1).cast("long"), "pages")).alias("page"))


def doc_pages(spark: SparkSession, d: str) -> DataFrame:
    """doc, page, page_count."""
    own = table(spark, d, "part").select(F.col("p_partkey").alias("doc"), (F.col("p_size") % 9 + 1).cast("long").alias("page_count"))
    return own.withColumn("page", F.explode(F.sequence(F.lit(1).cast("long"), "page_count")))


FILES = "f AS (SELECT p_partkey // 4 AS job, p_partkey AS file, p_size % 7 AS pages FROM part)"
FILE_PAGES = f"WITH {FILES}, p AS (SELECT job AS doc, (file % 4)::INT AS file, unnest(range(1, pages + 1)) AS page FROM f)"
DOC_PAGES = "WITH d AS (SELECT p_partkey AS doc, (p_size % 9 + 1)::BIGINT AS page_count, unnest(range(1, p_size % 9 + 2)) AS page FROM part)"


@query(
    "p01_merge",
    f"""WITH {FILES}, b AS (SELECT *, CASE WHEN lead(file) OVER w IS NULL THEN 0 ELSE pages % 2 END AS blank FROM f WINDOW w AS (PARTITION BY job ORDER BY file)),
    o AS (SELECT *, coalesce(sum(pages + blank) OVER (PARTITION BY job ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM b), x AS (SELECT job, file, pages, off, unnest(range(1, pages + blank + 1)) AS page FROM o)
    SELECT job, (off + page)::BIGINT AS pos, file, CASE WHEN page <= pages THEN page END AS page FROM x""",
)
def p01(spark, d):
    return P.merge(files(spark, d), "odd")


@query("p02_alternate", f"{FILE_PAGES} SELECT doc, file, page, row_number() OVER (PARTITION BY doc ORDER BY page, file)::INT AS pos FROM p")
def p02(spark, d):
    return P.alternate(file_pages(spark, d))


@query("p03_extract", f"{DOC_PAGES}, w AS (SELECT doc, p AS page, row_number() OVER (PARTITION BY doc ORDER BY i)::INT AS new_page FROM (SELECT DISTINCT doc, page_count FROM d), (VALUES (1, 9), (2, 2), (3, 1), (4, 5)) v(i, p) WHERE p <= page_count) SELECT * FROM w")
def p03(spark, d):
    pages = doc_pages(spark, d)
    wanted = pages.select("doc").distinct().select("doc", F.posexplode(F.array(*[F.lit(x).cast("long") for x in (9, 2, 1, 5)])).alias("pos", "page"))
    return P.extract(pages, wanted)


@query("p04_organize", f"{DOC_PAGES} SELECT doc, page AS pos, CASE WHEN page % 3 <> 0 THEN page END AS page, ((page * -90) % 360 + 360) % 360 AS rotation, CASE WHEN page % 3 = 0 THEN 612.0::DOUBLE END AS width, CASE WHEN page % 3 = 0 THEN 792.0::DOUBLE END AS height FROM d")
def p04(spark, d):
    order = doc_pages(spark, d).select(
        "doc", F.col("page").alias("pos"), F.when(F.col("page") % 3 == 0, "blank").otherwise("source").alias("kind"), "page", (F.col("page") * -90).alias("rotation"), F.lit(None).cast("double").alias("width"), F.lit(None).cast("double").alias("height")
    )
    return P.organize(order)


@query("p05_rotate", f"{DOC_PAGES} SELECT doc, page, page_count, CASE WHEN page % 2 = 0 THEN 270 ELSE 0 END AS angle FROM d")
def p05(spark, d):
    pages = doc_pages(spark, d)
    even = pages.filter("page % 2 = 0")
    turns = even.select("doc", F.lit(1).alias("seq"), "page", F.lit(90).alias("angle")).unionByName(even.select("doc", F.lit(2).alias("seq"), "page", F.lit(-90).alias("angle")))
    return P.rotate(pages, turns)


@query("p06_page_numbers", f"{DOC_PAGES} SELECT doc, page, '- ' || (page - 2 + 5) || ' / ' || (5 + page_count - 2) || ' -' AS label FROM d WHERE page >= 2")
def p06(spark, d):
    return P.page_numbers(doc_pages(spark, d), 1, 5, True, skip_first=True, prefix="- ", suffix=" -")


@query("p07_booklet", f"{DOC_PAGES}, t AS (SELECT *, (ceil(page_count / 4) * 4)::BIGINT AS total FROM d), m AS (SELECT *, least(page, total + 1 - page) AS mirror FROM t), s AS (SELECT *, CASE WHEN mirror % 2 = 1 THEN 'front' ELSE 'back' END AS side FROM m) SELECT doc, page, (mirror + 1) // 2 AS sheet, side, CASE WHEN (side = 'front') = (page > total / 2) THEN 'left' ELSE 'right' END AS slot FROM s")
def p07(spark, d):
    return P.booklet(doc_pages(spark, d))


@query("p08_fit_scale", f"{DOC_PAGES}, s AS (SELECT doc, page, 300.0 + page * 100 AS w, 800.0 AS h FROM d) SELECT doc, page, round(least(1.0, 539.0 / w, 736.0 / h), 6) AS fit, round(greatest(539.0 / w, 736.0 / h), 6) AS fill FROM s")
def p08(spark, d):
    w, h, x, y = F.lit(300.0) + F.col("page") * 100, F.lit(800.0), F.lit(539.0), F.lit(736.0)
    return doc_pages(spark, d).select("doc", "page", F.round(P.fit_scale(w, h, x, y, "fit"), 6).alias("fit"), F.round(P.fit_scale(w, h, x, y, "fill"), 6).alias("fill"))


@query("p09_halves", f"{DOC_PAGES}, h AS (SELECT doc, page, CASE WHEN page = 1 THEN 'whole' ELSE half END AS half, i FROM d, (VALUES (0, 'right'), (1, 'left')) v(i, half) WHERE page > 1 OR i = 0) SELECT doc, page, half, row_number() OVER (PARTITION BY doc ORDER BY page, i)::INT AS pos FROM h")
def p09(spark, d):
    return P.halves(doc_pages(spark, d).withColumn("skip", F.col("page") == 1))


@query("p10_crop", f"{DOC_PAGES} SELECT doc, round(greatest(median(0.01::DOUBLE * page) - 0.02::DOUBLE, 0.0::DOUBLE), 6) AS left, round(least(median(0.9::DOUBLE + 0.02::DOUBLE * page) + 0.02::DOUBLE, 1.0::DOUBLE), 6) AS right FROM d GROUP BY doc")
def p10(spark, d):
    boxes = doc_pages(spark, d).select("doc", (F.lit(0.01) * F.col("page")).alias("left"), (F.lit(0.9) + F.lit(0.02) * F.col("page")).alias("right"))
    return P.crop(boxes)


@query("p11_tiles", f"{DOC_PAGES} SELECT doc, page, i::INT AS i, j::INT AS j, round(600.0 * (i + 0.5) / 3, 6) AS x, round(800.0 * (j + 0.5) / 2, 6) AS y FROM d, range(3) a(i), range(2) b(j)")
def p11(spark, d):
    return P.tiles(doc_pages(spark, d).withColumn("width", F.lit(600.0)).withColumn("height", F.lit(800.0)), 3, 2)


@query("p13_same_images", "SELECT source AS doc, doc_id AS image, length(text)::BIGINT AS size, md5(text) AS digest, min(doc_id) OVER (PARTITION BY source, length(text), md5(text)) AS kept FROM documents")
def p13(spark, d):
    images = docs(spark, d).select(F.col("source").alias("doc"), F.col("doc_id").alias("image"), F.length("text").cast("long").alias("size"), F.md5(F.col("text").cast("binary")).alias("digest"))
    return P.drop_same_images(images)


@query("p16_field_names", "WITH n AS (SELECT p_brand AS doc, p_partkey AS seq, CASE WHEN p_partkey % 5 = 0 THEN 'Field ' || p_partkey ELSE replace(p_name, ' ', '_') END AS clean FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY doc, clean ORDER BY seq) AS nth FROM n) SELECT doc, seq, CASE WHEN nth > 1 THEN clean || ' (' || nth || ')' ELSE clean END AS unique_name FROM k")
def p16(spark, d):
    named = table(spark, d, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("seq"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.translate("p_name", " ", ".")).alias("name"))
    return P.field_names(named)


# ---- layout: the words of each line are items of 6 points a letter, 40 lines a page


def pages_of_items(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, page, items: made as arrays where texts are read, so that pages, not words, meet in the shuffle."""
    forty = F.regexp_extract_all("text", F.lit(r"((?:[^\n]*(?:\n|\z)){1,40})"), F.lit(1))
    own = docs(spark, d).select("doc_id", F.posexplode(forty).alias("page", "own")).filter(r"rlike(own, r'[^\n]')").select("doc_id", "page", F.split("own", "\n").alias("own"))
    # x is 30 points a word: what counts is the order and the gaps
    word = lambda i: lambda w, seq: F.struct((seq * 30.0).alias("x"), (F.lit(800.0) - i * 15).alias("y"), (F.length(w) * 3.0).alias("width"), F.when((i == 0) & (F.col("page") == 0), 18.0).otherwise(10.0).alias("size"), w.alias("text"), seq.alias("seq"))
    words = F.flatten(F.transform("own", lambda line, i: F.transform(F.when(line != "", F.split(line, " ")).otherwise(F.array().cast("array<string>")), word(i))))
    return own.select("doc_id", "page", words.alias("items")).groupBy("doc_id", "page").agg(F.flatten(F.collect_list("items")).alias("items"))


def layout_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines straight from the text, in the form that L.lines gives."""
    own = lines(spark, d).filter("line <> ''").withColumn("page", F.floor((F.col("n") - 1) / 40).cast("int"))
    return own.select("doc_id", "page", ((F.col("n") - 1) % 40).alias("line"), (F.lit(800.0) - ((F.col("n") - 1) % 40) * 15).alias("y"), F.when(F.col("n") % 6 == 0, 24.0).otherwise(0.0).alias("x"), F.when(F.col("n") == 1, 18.0).otherwise(10.0).alias("size"), F.col("line").alias("text"))


LAYOUT = f"{LINES}, r AS (SELECT doc_id, ((n - 1) // 40)::INT AS page, ((n - 1) % 40)::INT AS line, 800.0 - ((n - 1) % 40) * 15 AS y, CASE WHEN n % 6 = 0 THEN 24.0 ELSE 0.0 END AS x, CASE WHEN n = 1 THEN 18.0 ELSE 10.0 END AS size, line AS text FROM l WHERE line <> '')"


@query("l01_lines")
def l01(spark, d):
    return L.lines_of_pages(pages_of_items(spark, d)).select("doc_id", "page", "line", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("l09_median_size", f"WITH {LAYOUT}, k AS (SELECT doc_id, list_sort(list(size)) AS s FROM r GROUP BY 1) SELECT doc_id, s[len(s) // 2 + 1]::DOUBLE AS median FROM k")
def l09(spark, d):
    return L.median_sizes(layout_lines(spark, d))


@query(
    "l14_paragraphs",
    f"""WITH {LAYOUT}, b AS (SELECT *, lag(page) OVER o AS pp, lag(y) OVER o AS py, lag(x) OVER o AS px FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY page, line)),
    s AS (SELECT doc_id, page, line, CASE WHEN pp IS NULL OR pp <> page OR py - y > 1.6 * size OR x - px > 0.8 * size THEN 1 ELSE 0 END AS st FROM b) SELECT doc_id, page, line, sum(st) OVER (PARTITION BY doc_id ORDER BY page, line ROWS UNBOUNDED PRECEDING)::BIGINT AS paragraph FROM s""",
)
def l14(spark, d):
    return L.paragraphs(layout_lines(spark, d)).select("doc_id", "page", "line", "paragraph")




@query(
    "l16_table_scores",
    "WITH c AS (SELECT doc_id, 3 + 2 + CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 3 END AS filled FROM documents), s AS (SELECT doc_id, 1.0::DOUBLE AS align, round(filled / 9, 6) AS fill, round(least(1.0 * 0.55 + filled / 9 * 0.30 + 0.3 * 0.15, 1.0), 6) AS confidence FROM c) SELECT * FROM s",
)
def l16(spark, d):
    i = F.col("doc_id")
    rows = F.array(
        F.array(F.lit("A"), F.lit("B"), F.lit("C")),
        F.array(F.lit("x"), (i % 3).cast("string"), F.lit("")),
        F.array(F.lit("y"), F.when(i % 2 == 0, "").otherwise("7"), F.lit("z z z")),
    )
    s = docs(spark, d).select("doc_id", L.table_scores(rows, F.lit(3), F.lit(0.0)).alias("s"))
    return s.select("doc_id", F.round("s.align", 6).alias("align"), F.round("s.fill", 6).alias("fill"), F.round("s.confidence", 6).alias("confidence"))


@query("l17_prose_tables", f"WITH {LINES} SELECT doc_id, n, NOT regexp_matches(line, '[0-9]') AND len(list_filter(regexp_split_to_array(line, '[ \\t]+'), lambda w: w <> '')) >= 2 AS prose FROM l WHERE trim(line, ' ') <> ''")
def l17(spark, d):
    rows = F.array(F.array(F.lit("head")), F.array(F.col("line")))
    return lines(spark, d).filter("trim(line) <> ''").select("doc_id", "n", L.prose_not_data(rows).alias("prose"))


def repeated_lines(spark, d):
    """Every page of four lines or more begins with a running head and ends with its number."""
    own = lines(spark, d).withColumn("page", F.floor((F.col("n") - 1) / 4).cast("int"))
    k = (F.col("n") - 1) % 4
    text = F.when(k == 0, F.concat(F.lit("Running head "), (F.col("doc_id") % 3).cast("string"))).when(k == 3, F.concat(F.lit("page "), F.col("page").cast("string"))).otherwise(F.col("line"))
    return own.select("doc_id", "page", k.alias("line"), (F.lit(800.0) - k * 15).alias("y"), text.alias("text"))


REPEATED = f"{LINES}, r AS (SELECT doc_id, ((n - 1) // 4)::INT AS page, ((n - 1) % 4)::INT AS line, 800.0 - ((n - 1) % 4) * 15 AS y, CASE (n - 1) % 4 WHEN 0 THEN 'Running head ' || (doc_id % 3) WHEN 3 THEN 'page ' || ((n - 1) // 4) ELSE line END AS text FROM l), p AS (SELECT doc_id, count(DISTINCT page) AS n_pages FROM r GROUP BY 1)"


def page_counts(rows):
    return rows.groupBy("doc_id").agg(F.countDistinct("page").alias("n_pages"), F.lit(842.0).alias("height"))


@query(
    "l21_repeated_text",
    f"""WITH {REPEATED}, s AS (SELECT doc_id, page, trim(text, ' ') AS text, max(y) AS y FROM r WHERE length(trim(text, ' ')) <= 60 AND trim(text, ' ') <> '' AND NOT regexp_matches(trim(text, ' '), '^[0-9]+$') GROUP BY ALL),
    m AS (SELECT doc_id, text, list_sort(list(y))[count(*) // 2 + 1] AS mid, count(*) AS n, any_value(n_pages) AS n_pages FROM s JOIN p USING (doc_id) GROUP BY ALL HAVING count(*) >= greatest(3, ceil(any_value(n_pages) * 2 / 3)))
    SELECT doc_id, text, count(*) AS pages FROM s JOIN m USING (doc_id, text) WHERE abs(y - mid) <= 0.03 * 842 GROUP BY ALL HAVING count(*) >= greatest(3, ceil(any_value(n_pages) * 2 / 3))""",
)
def l21(spark, d):
    rows = repeated_lines(spark, d)
    return L.repeated_at_place(rows, page_counts(rows))


@query(
    "l22_repeated_patterns",
    f"""WITH {REPEATED}, e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line) AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY line DESC) AS b FROM r),
    c AS (SELECT doc_id, regexp_replace(trim(text, ' '), '[0-9]+', '#', 'g') AS pattern, count(DISTINCT page) AS pages FROM e WHERE a <= 3 OR b <= 3 GROUP BY ALL)
    SELECT doc_id, pattern, pages FROM c JOIN p USING (doc_id) WHERE pages >= greatest(3, ceil(n_pages * 2 / 3)) AND pattern <> ''""",
)
def l22(spark, d):
    rows = repeated_lines(spark, d)
    return L.repeated_patterns(rows, page_counts(rows).drop("height"))


@query("l10_column_gaps")
def l10(spark, d):
    # every word, in pieces of eight letters, takes the next of 19 places of 30 points; lines go on below
    own = lines(spark, d).filter("line <> ''").withColumn("page", F.floor((F.col("n") - 1) / 40).cast("int"))
    pieces = F.flatten(F.transform(F.split("line", " "), lambda w: F.when(w == "", F.array(w)).otherwise(F.regexp_extract_all(w, F.lit("(?s).{1,8}"), F.lit(0)))))
    words = own.select("doc_id", "page", F.posexplode(pieces).alias("seq", "text"))
    return L.column_gaps(words.select("doc_id", "page", (F.col("seq") % 19 * 30.0).alias("x"), (F.length("text") * 3.0).alias("width")))


@query("l11_column_regions", f"WITH {LAYOUT}, g(region, lo, hi) AS (VALUES (1, 0, 20), (2, 20, 600)) SELECT doc_id, page, line, region FROM r JOIN g ON x >= lo AND x < hi")
def l11(spark, d):
    rows = layout_lines(spark, d)
    at = F.explode(F.array(F.struct(F.lit(0).alias("left"), F.lit(20).alias("right"), F.lit(1).alias("region")), F.struct(F.lit(20).alias("left"), F.lit(600).alias("right"), F.lit(2).alias("region"))))
    regions = rows.select("doc_id", "page").distinct().select("doc_id", "page", at.alias("g")).select("doc_id", "page", "g.*")
    return L.in_columns(rows, regions).select("doc_id", "page", "line", "region")


@query("l12_page_direction", f"WITH {LAYOUT} SELECT doc_id, page, avg(CASE WHEN regexp_matches(text, '^[^A-Za-z]*[\\x{{0590}}-\\x{{08FF}}]') THEN 1 ELSE 0 END) > 0.5 AS rtl FROM r GROUP BY ALL")
def l12(spark, d):
    return L.page_direction(layout_lines(spark, d))


@query(
    "l24_stitched_tables",
    "WITH t AS (SELECT p_partkey // 10 AS doc_id, p_partkey % 10 AS page, p_size % 2 AS cols FROM part), s AS (SELECT *, CASE WHEN lag(page) OVER o = page - 1 AND lag(cols) OVER o = cols THEN 0 ELSE 1 END AS st FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY page)), r AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM s) SELECT doc_id, run, min(page) AS first_page, max(page) AS last_page, any_value(cols) AS cols FROM r GROUP BY doc_id, run",
)
def l24(spark, d):
    tables = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 10).cast("long").alias("doc_id"), (F.col("p_partkey") % 10).alias("page"), (F.col("p_size") % 2).alias("cols"), F.lit(True).alias("clear_above"), F.lit(True).alias("clear_below"))
    return L.stitch_tables(tables)


@query("l23_markdown")
def l23(spark, d):
    rows = layout_lines(spark, d)
    return L.markdown(rows, L.median_sizes(rows)).select("doc_id", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


@query("m05_conversion_stats", f"WITH {LAYOUT} SELECT doc_id, count(DISTINCT page) AS total_pages, count(*) AS total_lines, sum(length(text))::BIGINT AS total_chars, count(*) FILTER (regexp_matches(text, '[\\x{{0590}}-\\x{{08FF}}]')) AS rtl_lines, sum(len(regexp_extract_all(text, '[\\x{{2200}}-\\x{{22FF}}=<>±×÷]')))::BIGINT AS math_chars FROM r GROUP BY 1")
def m05(spark, d):
    return L.conversion_stats(layout_lines(spark, d))


# ---- web pages


@query("h01_element_by_class")
def h01(spark, d):
    return table(spark, d, "pages").select("page_id", H.element_by_class(F.col("html"), "ad").alias("ad"))


@query("h03_titles", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' ') AS title, NULLIF(regexp_extract(html, '(?i)<html[^>]*lang=\"([a-z]+)\"', 1), '') AS lang FROM pages")
def h03(spark, d):
    return table(spark, d, "pages").select("page_id", H.title(F.col("html")).alias("title"), F.nullif(F.regexp_extract("html", r'(?i)<html[^>]*lang="([a-z]+)"', 1), F.lit("")).alias("lang"))


@query(
    "h04_alternate_groups",
    "WITH RECURSIVE e AS (SELECT page_id AS a, page_id + 10 AS b FROM pages WHERE page_id % 100 < 90 UNION SELECT page_id + 10, page_id FROM pages WHERE page_id % 100 < 90), g AS (SELECT DISTINCT a AS page, a AS root FROM e UNION SELECT e.b, g.root FROM g JOIN e ON e.a = g.page) SELECT page, min(root) AS root FROM g GROUP BY 1",
)
def h04(spark, d):
    pages = table(spark, d, "pages").filter("page_id % 100 < 90")  # chains of ten pages
    return H.alternate_groups(pages.select(F.col("page_id").alias("a"), (F.col("page_id") + 10).alias("b")))


@query("h05_keywords", "SELECT page_id, list_filter(list_transform(string_split(regexp_extract(html, '<title>([^<]*)</title>', 1), ','), lambda k: lower(trim(k, ' '))), lambda k: k <> '') AS keywords FROM pages")
def h05(spark, d):
    return table(spark, d, "pages").select("page_id", H.keywords(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("keywords"))


@query("h06_breadcrumbs", "SELECT page_id, array_to_string(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1), '/'), lambda x: x <> ''), '/') AS path FROM pages")
def h06(spark, d):
    crumbs = F.from_json(H.breadcrumbs(F.col("url")), "array<struct<position:int,name:string>>")
    return table(spark, d, "pages").select("page_id", F.array_join(F.transform(crumbs, lambda c: c["name"]), "/").alias("path"))


@query("h07_same_files", "SELECT p_name AS name, p_size AS size, min(p_partkey) AS id, count(*) AS copies FROM part GROUP BY ALL")
def h07(spark, d):
    return H.same_files(table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_partkey").alias("id")))


# ---- streams, run to their end over the event file


def _streamed(spark: SparkSession, d: str, name: str, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """A stream run to its end; each batch (of complete output: the last) is written to the shared folder, once even if it is tried again."""
    schema = table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(d)
    out, folder = build(source), f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number if mode == 'append' else 0}")

    running = out.writeStream.outputMode(mode).foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start()
    running.awaitTermination()
    if running.lastProgress is None:
        return spark.createDataFrame([], out.schema)
    return spark.read.schema(out.schema).parquet(f"{folder}/rows").select(*out.columns)


@query("stream_daily_counts", "SELECT ts::DATE AS day, event_type, count(*) AS events FROM events GROUP BY ALL")
def stream_daily(spark, d):
    out = _streamed(spark, d, "daily", lambda s: bursts.windowed_errors(s), "complete")
    return out.select(F.to_date("window.start").alias("day"), "event_type", "events")


@query("stream_rage_clicks")
def stream_rage(spark, d):
    def build(s):
        clicks = s.filter("event_type = 'click'").select(F.col("user_id").alias("session"), F.concat(F.lit("target"), (F.get_json_object("props", "$.k").cast("long") % 5).cast("string")).alias("target"), F.expr("unix_micros(cast(ts AS timestamp)) div 1000000").alias("ms"))
        return bursts.rage_clicks(clicks, 86400, 3, 200000)

    return _streamed(spark, d, "rage", build, "append")


