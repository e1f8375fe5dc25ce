"""Queries of the finer operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.functions import text as T
from vellumspark.operators import details as X
from vellumspark.operators import detect as D
from vellumspark.plans.pages import LAYOUT, REPEATED, layout_lines, page_counts, repeated_lines
from vellumspark.plans.registry import query
from vellumspark.plans.text import LINES, docs, lines
from vellumspark.session import table


@query("c03_nfkc")
def c03(spark, d):
    return table(spark, d, "part").select("p_partkey", T.nfkc(F.concat(F.lit("ｆｕｌｌ ﬁ ⼀ "), "p_name")).alias("plain"))


@query("c13_wants_ocr", "SELECT p_partkey, p_size <= 20 AND p_partkey % 10 >= 5 OR p_partkey % 7 = 0 AS ocr FROM part")
def c13(spark, d):
    got = T.wants_ocr(F.col("p_size"), F.lit(0), F.col("p_partkey") % 10 / 10, F.col("p_partkey") % 7 == 0)
    return table(spark, d, "part").select("p_partkey", got.alias("ocr"))


@query("c41_recipient_columns", "WITH c AS (SELECT 0 AS column_no, c_mktsegment AS v FROM customer UNION ALL SELECT 1, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_nationkey::VARCHAR END FROM customer) SELECT column_no, count(*) FILTER (v <> '') AS filled, count(DISTINCT v) FILTER (v <> '') AS different, count(*) FILTER (v = '') AS skipped FROM c GROUP BY 1")
def c41(spark, d):
    second = F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_nationkey").cast("string"))
    return X.recipient_values(table(spark, d, "customer").select(F.col("c_custkey").alias("n"), F.array(F.concat(F.lit(" "), "c_mktsegment"), second).alias("cells")))


@query("d06_token_at", "SELECT doc_id, 7 AS at, regexp_extract(text[1:7], '(\\S*)$', 1) || regexp_extract(text[8:], '^(\\S*)', 1) AS token FROM documents")
def d06(spark, d):
    at = F.lit(7)  # on each row itself: a join by doc_id would pair rows that share an id, and lose those without
    return docs(spark, d).select("doc_id", at.alias("at"), X.token_at(F.col("text"), at, {"email": D.PII["email"], "url": D.PII["url"]}).alias("token"))


@query("d13_doubled_words", "WITH w AS (SELECT l_orderkey AS page, l_linenumber AS line, l_quantity AS x, l_discount AS y, l_returnflag AS text FROM lineitem) SELECT page, line, x, y, text FROM w a WHERE EXISTS (SELECT 1 FROM w b WHERE b.page = a.page AND b.line < a.line AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 AND contains(b.text, a.text))")
def d13(spark, d):
    words = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_returnflag").alias("text"))
    return X.doubled_words(words, 3.0)


@query("d22_signatures")
def d22(spark, d):
    body = F.concat(F.lit("%PDF /ByteRange [0 32 40 12]     <0a0b0c> and the rest"), "p_name")
    return X.count_signatures(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), body.cast("binary").alias("content")))


@query("e11_furniture", f"WITH {REPEATED}, c AS (SELECT doc_id, regexp_replace(trim(text, ' '), '[0-9]+', '#', 'g') AS masked, count(DISTINCT page) AS pages FROM r GROUP BY ALL) SELECT doc_id, masked, pages FROM c JOIN p USING (doc_id) WHERE masked <> '' AND pages >= greatest(3, n_pages / 3)")
def e11(spark, d):
    rows = repeated_lines(spark, d)
    return X.furniture_lines(rows, page_counts(rows).drop("height"))


@query("e11_page_offsets", "WITH n AS (SELECT o_custkey AS doc_id, o_orderkey AS page, o_orderkey + o_custkey % 4 AS printed FROM orders) SELECT doc_id, any_value(printed - page)::INT AS offset, count(DISTINCT page) AS pages FROM n WHERE printed < 10000 GROUP BY 1 HAVING count(DISTINCT page) >= 3")
def e11_offsets(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("int").alias("page"), (F.col("o_orderkey") + F.col("o_custkey") % 4).cast("string").alias("text"))
    return X.page_number_offsets(rows)


@query("e12_list_marks", f"WITH {LINES}, m AS (SELECT doc_id, regexp_extract(CASE WHEN n % 2 = 0 THEN (n % 9) || ') ' || line ELSE line END, '^\\s*([0-9]{{1,3}})[.)]([^0-9]|$)', 1) AS mark FROM l) SELECT doc_id, count(*) AS marks, count(DISTINCT mark) AS different FROM m WHERE mark <> '' GROUP BY 1")
def e12(spark, d):
    marked = lines(spark, d).withColumn("line", F.when(F.col("n") % 2 == 0, F.concat((F.col("n") % 9).cast("string"), F.lit(") "), "line")).otherwise(F.col("line")))
    return X.list_marks(marked)


@query("e17_change_rules", "SELECT doc_id, doc_id % 13 - doc_id % 5 > greatest(2.0, n_chars * 0.001) AS worse FROM documents")
def e17(spark, d):
    i = F.col("doc_id")
    return docs(spark, d).select("doc_id", X.beyond(i % 5, i % 13, F.col("n_chars"), 0.001, 2).alias("worse"))


@query("e24_table_placement", "SELECT o_custkey AS table_id, 2 AS offset, count(*) AS matched FROM orders GROUP BY 1")
def e24(spark, d):
    truth = table(spark, d, "orders").select(F.col("o_custkey").alias("table_id"), F.col("o_orderkey").cast("int").alias("row"), F.lit(0).alias("col"), F.col("o_totalprice").cast("string").alias("text"))
    return X.place_table(truth, truth.withColumn("row", F.col("row") + 2))


@query("e34_changed_pages", f"WITH {LINES}, a AS (SELECT doc_id, (n - 1) // 40 AS page, line FROM l), o AS (SELECT doc_id, page, line, count(*) AS n FROM a GROUP BY ALL), w AS (SELECT doc_id, page, line, count(*) AS n FROM a WHERE length(line) % 5 <> 0 GROUP BY ALL) SELECT doc_id, page::INT AS page, round(1 - sum(least(o.n, coalesce(w.n, 0))) / sum(greatest(o.n, coalesce(w.n, 0))), 6) AS changed FROM o LEFT JOIN w USING (doc_id, page, line) GROUP BY ALL")
def e34(spark, d):
    old = lines(spark, d).select("doc_id", F.floor((F.col("n") - 1) / 40).cast("int").alias("page"), "line")
    return X.changed_lines(old, old.filter(F.length("line") % 5 != 0))


@query("e36_gold_guard", "SELECT p_brand AS file, count(*) FILTER (p_size % 2 = 0) AS removed FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2') GROUP BY 1")
def e36(spark, d):
    diff = table(spark, d, "part").select(F.col("p_brand").alias("file"), F.when(F.col("p_size") % 2 == 0, "-").otherwise("+").alias("sign"), F.col("p_name").alias("line"))
    return X.guard_gold(diff, spark.createDataFrame([("Brand#1",), ("Brand#2",)], "file string"))


@query("l13_left_margins", f"WITH {LAYOUT}, e AS (SELECT doc_id, page, round(x / 2)::BIGINT AS edge, count(*) AS n, min(x)::DOUBLE AS x FROM r GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, page) AS total, row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, edge) AS k FROM e) SELECT doc_id, page, x AS margin FROM k WHERE k = 1 AND n >= 3 AND n >= 0.4 * total")
def l13(spark, d):
    return X.left_margin(layout_lines(spark, d))


@query("l19_grid_cells", "WITH c(col, start) AS (VALUES (0, 0.0), (1, 15.5), (2, 30.0)) SELECT p_partkey % 20 AS page, p_partkey AS item, (SELECT max(col) FROM c WHERE start <= p_size)::INT AS col FROM part")
def l19(spark, d):
    items = table(spark, d, "part").select((F.col("p_partkey") % 20).alias("page"), F.col("p_size").cast("double").alias("x"), F.col("p_partkey").alias("item"))
    starts = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(s).alias("start")) for c, s in ((0, 0.0), (1, 15.5), (2, 30.0))])
    columns = spark.range(20).select(F.col("id").alias("page"), F.explode(starts).alias("c")).select("page", "c.col", "c.start")
    return X.cell_of(items, columns)


@query(
    "p26_question_bands",
    f"""WITH {LINES}, q AS (SELECT doc_id * 100000 + n // 90 AS doc_id, n % 90 // 3 AS number, 800.0::DOUBLE - n % 90 * 20 AS top FROM l WHERE n % 3 = 0)
    SELECT doc_id, number::INT AS number, top, lead(top) OVER (PARTITION BY doc_id ORDER BY top DESC) AS bottom FROM q""",
)
def p26(spark, d):
    """Every 90 lines of a document are a worksheet, so that all lines take part and numbers stay short."""
    n = F.col("n") % 90
    text = F.when(n % 3 == 0, F.concat((n / 3).cast("int").cast("string"), F.lit(". "), "line")).otherwise(F.concat(F.lit("- "), "line"))
    rows = lines(spark, d).select((F.col("doc_id") * 100000 + F.floor(F.col("n") / 90)).alias("doc_id"), (F.lit(800.0) - n * 20).alias("y"), F.lit(0.0).alias("x"), text.alias("text"))
    return X.question_bands(rows)
