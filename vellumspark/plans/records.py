"""Queries of the repairs and record operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import repair
from vellumspark.functions import text as T
from vellumspark.operators import records as R
from vellumspark.operators import web as H
from vellumspark.plans.pages import DOC_PAGES, doc_pages
from vellumspark.plans.registry import query
from vellumspark.plans.text import EVENTS, LINES, docs, events, lines, pick
from vellumspark.session import table


@query(
    "b23_redirects",
    "WITH g AS (SELECT p_name AS source, 'to ' || p_brand AS target, p_partkey % 7 AS priority FROM part), m AS (SELECT DISTINCT p_name AS source, 'manual' AS target FROM part WHERE p_name LIKE 'red%'), b AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY priority, target) AS k FROM g) SELECT source, target FROM b WHERE k = 1 AND source NOT IN (SELECT source FROM m) UNION ALL SELECT * FROM m",
)
def b23(spark, d):
    part = table(spark, d, "part")
    guesses = part.select(F.col("p_name").alias("source"), F.concat(F.lit("to "), "p_brand").alias("target"), (F.col("p_partkey") % 7).alias("priority"))
    return R.redirects(guesses, part.filter("p_name LIKE 'red%'").select(F.col("p_name").alias("source"), F.lit("manual").alias("target")).distinct())


PATHS = ["/app.0a1b2c3d4e.js", "/app.js", "/en/page/", "/x.png", "/old"]


@query(
    "b24_cache_classes",
    f"WITH {EVENTS}, p AS (SELECT event_id, {PATHS}[k % 5 + 1] AS path, [200, 301, 404, 500, 200][k // 5 % 5 + 1] AS status FROM e) SELECT event_id, CASE WHEN status >= 500 THEN 'no-store' WHEN status = 301 THEN 'day' WHEN status >= 400 THEN 'no-store' WHEN path = '/app.0a1b2c3d4e.js' THEN 'immutable' WHEN path IN ('/app.js', '/x.png') THEN 'hour' ELSE 'revalidate' END AS cache FROM p",
)
def b24(spark, d):
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 301, 404, 500, 200)]), (F.floor(F.col("k") / 5) % 5 + 1).cast("int"))
    return events(spark, d).select("event_id", R.cache_class(pick(PATHS, F.col("k") % 5), status).alias("cache"))


@query("c07_arabic_letters")
def c07(spark, d):
    return table(spark, d, "part").select("p_partkey", T.arabic_letters(F.concat(F.lit("ﻻﺑ "), "p_name")).alias("plain"))


@query("c10_logical_order")
def c10(spark, d):
    return table(spark, d, "part").select("p_partkey", repair.visual_to_logical(F.concat("p_name", F.lit(" (םולש 12)"))).alias("logical"))


@query("c15_mojibake", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Привет, это довольно длинный русский текст' ELSE 'a plain text with é in it, long enough to count' END AS text FROM documents")
def c15(spark, d):
    garbled = "Привет, это довольно длинный русский текст".encode("cp1251").decode("cp1252")
    made = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, garbled).otherwise("a plain text with é in it, long enough to count").alias("text"))
    return repair.repair_mojibake(made)


@query("c16_uzbek_apostrophes", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'oʻzbek gʻoya soʻz' ELSE 'âme oâ' END AS text FROM documents")
def c16(spark, d):
    return repair.repair_uzbek(docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, "oâzbek gâoya soâz").otherwise("âme oâ").alias("text")))


@query("c18_surrogates", "SELECT r_regionkey, r_name || '😀é' AS text FROM region")
def c18(spark, d):
    halves = bytes(b for half in (0xD83D, 0xDE00) for b in chr(half).encode("utf-8", "surrogatepass"))
    broken = F.concat(F.col("r_name").cast("binary"), F.lit(halves), F.lit("é".encode()))
    return table(spark, d, "region").select("r_regionkey", repair.join_surrogates(broken).cast("string").alias("text"))


@query("c21_numbered_sections", f"WITH {LINES}, m AS (SELECT doc_id, n, CASE WHEN n % 3 = 0 THEN '2.' || n % 50 || ' ' || line ELSE line END AS line FROM l) SELECT doc_id, n FROM m WHERE regexp_matches(line, '^[0-9]{{1,2}}(\\.[0-9]{{1,2}}){{1,4}}\\.?\\s+\\S') AND length(line) <= 120")
def c21(spark, d):
    marked = lines(spark, d).withColumn("line", F.when(F.col("n") % 3 == 0, F.concat(F.lit("2."), (F.col("n") % 50).cast("string"), F.lit(" "), "line")).otherwise(F.col("line")))
    return marked.filter(T.numbered_section(F.col("line"))).select("doc_id", "n")


@query("c31_decimal_marks", "SELECT o_custkey AS table_id, CASE WHEN count(*) FILTER (o_orderkey % 3 = 0) > count(*) FILTER (o_orderkey % 3 = 1) THEN '.' WHEN count(*) FILTER (o_orderkey % 3 = 0) < count(*) FILTER (o_orderkey % 3 = 1) THEN ',' END AS mark FROM orders GROUP BY 1")
def c31(spark, d):
    k = F.col("o_orderkey") % 3
    return R.decimal_mark(table(spark, d, "orders").select(F.col("o_custkey").alias("table_id"), F.lit(1).alias("row"), F.when(k == 0, "1,234.50").when(k == 1, "1.234,5").otherwise("1,234").alias("text")))


@query("c35_rasm")
def c35(spark, d):
    return table(spark, d, "nation").select("n_nationkey", repair.rasm(F.concat(F.lit("كِتَابٌ شجرة "), "n_name")).alias("skeleton"))


@query("c37_fold_digits", "SELECT p_partkey, p_partkey::VARCHAR AS folded FROM part")
def c37(spark, d):
    return table(spark, d, "part").select("p_partkey", T.fold_digits(F.translate(F.col("p_partkey").cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")).alias("folded"))


@query("d04_entities", "SELECT n_nationkey, ['PER:Ann Lee', 'LOC:' || n_name || 'ia'] AS entities FROM nation")
def d04(spark, d):
    token = lambda e, w, s: F.struct(F.lit(e).alias("entity"), w.alias("word"), F.lit(s).alias("score"))
    tokens = F.array(token("B-PER", F.lit("Ann"), 0.9), token("I-PER", F.lit("Lee"), 0.8), token("O", F.lit("in"), 0.9), token("B-LOC", F.col("n_name"), 0.7), token("I-LOC", F.lit("##ia"), 0.6), token("B-ORG", F.lit("X"), 0.9), token("B-PER", F.lit("Low"), 0.2))
    found = R.merge_entities(tokens)
    return table(spark, d, "nation").select("n_nationkey", F.transform(found, lambda e: F.concat(e["kind"], F.lit(":"), e["text"])).alias("entities"))


@query("d09_bounding_boxes", "SELECT l_orderkey, min(l_quantity) AS x0, min(l_tax) AS y0, max(l_quantity + 5) AS x1, max(l_tax + 1) AS y1 FROM lineitem GROUP BY 1")
def d09(spark, d):
    boxes = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x0"), F.col("l_tax").alias("y0"), (F.col("l_quantity") + 5).alias("x1"), (F.col("l_tax") + 1).alias("y1"))
    return R.bounding(boxes, "l_orderkey")


@query(
    "d12_suspicious",
    """WITH t AS (SELECT doc_id, text, doc_id % 101 AS confidence, list_transform(list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda w: w <> ''), lambda w: (length(w) * 13 + doc_id) % 101) AS c FROM documents),
    n AS (SELECT *, len(regexp_extract_all(text, '[a-zA-Z]')) AS a, len(regexp_extract_all(text, '[0-9]')) AS g, len(list_filter(c, lambda x: x < 40)) AS weak FROM t)
    SELECT doc_id, confidence < 60 OR (confidence < 80 AND len(c) >= 20 AND weak >= 0.15 * len(c)) OR (a + g > 5 AND a < 0.25 * (a + g)) AS doubtful FROM n""",
)
def d12(spark, d):
    words = F.filter(F.split("text", r"[ \n\t]+"), lambda w: w != "")
    own = F.transform(words, lambda w: (F.char_length(w) * 13 + F.col("doc_id")) % 101)
    return table(spark, d, "documents").select("doc_id", R.suspicious_reading(F.col("doc_id") % 101, F.col("text"), own).alias("doubtful"))


@query("d16_link_mismatch", "SELECT page_id, page_id % 3 = 0 AS differs FROM pages")
def d16(spark, d):
    host = F.lower(F.regexp_extract("url", "://([^/?#:]*)", 1))
    k = F.col("page_id") % 3
    shown = F.when(k == 0, "see https://other-site.com/x").when(k == 1, F.concat(F.lit("www."), host)).otherwise("https://other-site.com/lon…")
    return table(spark, d, "pages").select("page_id", R.link_mismatch(shown, host).alias("differs"))


@query("d17_under_rectangles", "SELECT 1 AS rect, o_orderkey % 50 AS page, o_totalprice AS x, o_orderpriority AS text FROM orders WHERE o_totalprice + 2 BETWEEN 999 AND 5001 AND o_custkey BETWEEN 98 AND 502")
def d17(spark, d):
    items = table(spark, d, "orders").select((F.col("o_orderkey") % 50).alias("page"), F.col("o_totalprice").alias("x"), F.col("o_custkey").alias("y"), F.lit(4).alias("width"), F.col("o_orderpriority").alias("text"))
    rects = spark.range(50).select(F.col("id").alias("page"), F.lit(1).alias("rect"), F.lit(1000).alias("x0"), F.lit(100).alias("y0"), F.lit(5000).alias("x1"), F.lit(500).alias("y1"))
    return R.under_rectangles(items, rects)


@query("d18_pdf_names")
def d18(spark, d):
    body = F.concat(F.lit("%PDF-1.7\n<< /OpenAction << /S /J#61vaScript /JS ("), "p_name", F.lit(") >> >>\nstream\n/Launch\nendstream\n%%EOF"))
    return R.scan_names(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), body.cast("binary").alias("content")))


@query("e14_language_tags", "SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[^\\p{L}\\p{N}\\p{P}\\s]')) > 0.2 * length(text) THEN 'suspect' ELSE 'other' END AS tag FROM documents WHERE length(text) > 0")
def e14(spark, d):
    return docs(spark, d).filter(F.length("text") > 0).select("doc_id", R.language_tag(F.col("text")).alias("tag"))


@query("e23_line_alignment")
def e23(spark, d):
    whole = docs(spark, d).select("doc_id", F.split("text", "\n").alias("lines"))
    return R.aligned_lines(whole, whole.select("doc_id", F.filter("lines", lambda x, i: i % 4 != 3).alias("lines")))


@query("e27_visual_compare", "SELECT count(*) AS documents, count(*) FILTER (abs(a - b) >= 20) AS moved, round(avg(b - a), 6) AS mean_change FROM (SELECT event_id, value AS a, value + event_id % 50 - 25 AS b FROM events)")
def e27(spark, d):
    both = table(spark, d, "events").select(F.col("value").alias("a"), (F.col("value") + F.col("event_id") % 50 - 25).alias("b"))
    return both.agg(F.count("*").alias("documents"), F.count_if(F.abs(F.col("a") - F.col("b")) >= 20).alias("moved"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("mean_change"))


@query(
    "e32_column_switches",
    """WITH m AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, min(l_returnflag) AS c FROM lineitem GROUP BY 1, 2), b AS (SELECT *, lag(c) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM m)
    SELECT doc_id, count(*) FILTER (before <> c) AS switches FROM b GROUP BY 1""",
)
def e32(spark, d):
    markers = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos")).agg(F.min("l_returnflag").alias("column_no"))
    return R.column_switches(markers)


@query("h02_faq", "SELECT page_id, ['Q' || page_id] AS questions FROM pages")
def h02(spark, d):
    block = F.concat(F.lit('<script type="application/ld+json">{"@type":"Other"}</script><script type="application/ld+json">{"@type":"FAQPage","mainEntity":[{"name":"Q'), F.col("page_id").cast("string"), F.lit('","acceptedAnswer":{"text":"A"}}]}</script>'))
    return table(spark, d, "pages").select("page_id", F.transform(H.faq(F.concat("html", block)), lambda q: q["question"]).alias("questions"))


@query("l15_tables")
def l15(spark, d):
    cells = F.transform(F.filter(F.split("line", " \\| "), lambda c: c != ""), lambda c, i: F.struct((i * 80.0).alias("x"), c.alias("text")))
    return R.detect_tables(lines(spark, d).select("doc_id", F.floor((F.col("n") - 1) / 40).cast("int").alias("page"), ((F.col("n") - 1) % 40).alias("line"), cells.alias("cells")))


@query("p12_copies", "WITH l(line, before, after) AS (VALUES (1, 'Dear ', ','), (2, '', ' has a much longer line')), t AS (SELECT c_custkey AS recipient, line, before || c_name || after AS text, least(1.0::DOUBLE, (150 - length(before || after) * 5.0::DOUBLE) / (length(c_name) * 5.0::DOUBLE)) AS s FROM customer, l) SELECT recipient, line, text, CASE WHEN s >= 0.85 THEN round(s, 6) END AS scale FROM t")
def p12(spark, d):
    template = spark.createDataFrame([(1, "Dear ", ","), (2, "", " has a much longer line")], "line int, before string, after string")
    return R.copies(table(spark, d, "customer").select(F.col("c_custkey").alias("recipient"), F.col("c_name").alias("name")), template, 150.0)


@query("p15_outline", f"{DOC_PAGES}, k AS (SELECT doc, max(page) AS top FROM d WHERE page % 3 <> 0 GROUP BY 1) SELECT d.doc, page AS entry FROM d JOIN k ON d.doc = k.doc AND d.page <= k.top")
def p15(spark, d):
    pages = doc_pages(spark, d)  # every page's entry lies under the entry of the page before
    entries = pages.select("doc", F.col("page").alias("entry"), F.when(F.col("page") > 1, F.col("page") - 1).alias("parent"), "page")
    return R.surviving_outline(entries, pages.filter("page % 3 <> 0").select("doc", "page"))
