"""Queries of the bag, comparison, sampling, search and score operators.

The two readers of a document are its text and the text without every 50th word; the output also has words
glued or doubled. All are made the same way in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.operators import bags as B
from vellumspark.operators import scores as Q
from vellumspark.operators import search as S
from vellumspark.plans.registry import query
from vellumspark.plans.text import LINES, docs, lines
from vellumspark.session import table

WORD = r"[A-Za-z]+"


def words(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)).alias("words"))


def thinned(df: DataFrame, every: int) -> DataFrame:
    """Without every so-many-th word."""
    return df.select("doc_id", F.filter("words", lambda w, i: (i + 1) % every != 0).alias("words"))


W = f"w AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS words FROM documents), x AS (SELECT doc_id, unnest(words) AS token, generate_subscripts(words, 1) AS i FROM w)"
BAGS = f"WITH {W}, a AS (SELECT doc_id, token, count(*) AS n FROM x GROUP BY ALL), b AS (SELECT doc_id, token, count(*) AS n FROM x WHERE i % 50 <> 0 GROUP BY ALL), c AS (SELECT doc_id, token, count(*) AS n FROM x WHERE i % 30 <> 0 GROUP BY ALL)"
MET = "m AS (SELECT coalesce(r.doc_id, c.doc_id) AS doc_id, coalesce(r.n, 0) AS a, coalesce(c.n, 0) AS b FROM r FULL JOIN c ON r.doc_id = c.doc_id AND r.token = c.token)"
RECALL = f"""{BAGS}, r AS (SELECT a.doc_id, a.token, least(a.n, b.n) AS n FROM a JOIN b USING (doc_id, token)), {MET}, s AS (SELECT doc_id, sum(a)::BIGINT AS reference, sum(least(a, b))::BIGINT AS kept, sum(greatest(a - b, 0))::BIGINT AS missing, sum(greatest(b - a, 0))::BIGINT AS extra FROM m GROUP BY 1)"""


def both_readers(spark: SparkSession, d: str) -> DataFrame:
    whole = words(spark, d)
    return B.agreed(B.bag(whole, F.col("words")), B.bag(thinned(whole, 50), F.col("words")))


@query("e01_agreed_bag", f"{BAGS} SELECT a.doc_id, count(*) AS tokens, sum(least(a.n, b.n))::BIGINT AS n FROM a JOIN b USING (doc_id, token) GROUP BY 1")
def e01(spark, d):
    return both_readers(spark, d).groupBy("doc_id").agg(F.count("*").alias("tokens"), F.sum("n").alias("n"))


@query("e02_recall", f"{RECALL} SELECT doc_id, reference, kept, missing, extra, CASE WHEN reference > 0 THEN round(kept / reference, 6) END AS recall FROM s")
def e02(spark, d):
    return B.recall(both_readers(spark, d), B.bag(thinned(words(spark, d), 30), F.col("words")))


@query("e03_bigrams", f"WITH {W}, p AS (SELECT doc_id, token || ' ' || lead(token) OVER (PARTITION BY doc_id ORDER BY i) AS gram FROM x) SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS documents FROM p WHERE gram IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) >= 20")
def e03(spark, d):
    pairs = words(spark, d).select("doc_id", F.explode(B.grams(F.col("words"), 2)).alias("gram"))
    return pairs.groupBy("gram").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents")).filter("documents >= 20")


def glue(df: DataFrame) -> DataFrame:
    """Words 20 and 21, 40 and 41 ... as one."""
    at = F.transform("words", lambda w, i: F.when((i + 1) % 20 == 0, F.concat(w, F.coalesce(F.try_element_at("words", i + 2), F.lit("")))).when((i + 1) % 20 == 1, F.when(i == 0, w).otherwise("")).otherwise(w))
    return df.select("doc_id", F.filter(at, lambda w: w != "").alias("words"))


GLUED = f"{W}, y AS (SELECT doc_id, i, CASE WHEN i % 20 = 0 THEN token || coalesce(lead(token) OVER (PARTITION BY doc_id ORDER BY i), '') WHEN i % 20 = 1 AND i > 1 THEN '' ELSE token END AS token FROM x), o AS (SELECT doc_id, token, i FROM y WHERE token <> '')"


@query(
    "e04_glued",
    f"""WITH {GLUED}, p AS (SELECT doc_id, token || lead(token) OVER (PARTITION BY doc_id ORDER BY i) AS token FROM x), pc AS (SELECT doc_id, token, count(*) AS pairs FROM p WHERE token IS NOT NULL GROUP BY ALL),
    oc AS (SELECT doc_id, token, count(*) AS n FROM o GROUP BY ALL) SELECT doc_id, token, least(n, pairs) AS n FROM oc JOIN pc USING (doc_id, token) WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = oc.doc_id AND x.token = oc.token)""",
)
def e04(spark, d):
    whole = words(spark, d)
    return B.glued(whole, B.bag(glue(whole), F.col("words")))


@query(
    "e05_split",
    f"""WITH {GLUED}, p AS (SELECT doc_id, token || lead(token) OVER (PARTITION BY doc_id ORDER BY i) AS token FROM x), pc AS (SELECT doc_id, token, count(*) AS pairs FROM p WHERE token IS NOT NULL GROUP BY ALL),
    oc AS (SELECT doc_id, token, count(*) AS n FROM o GROUP BY ALL) SELECT doc_id, token, least(n, pairs) AS n FROM oc JOIN pc USING (doc_id, token) WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = oc.doc_id AND x.token = oc.token)""",
)
def e05(spark, d):
    whole = words(spark, d)  # the glued text as reference, the plain one as an output that splits its words
    return B.split_words(B.bag(glue(whole), F.col("words")), whole)


@query("e06_spaced_letters")
def e06(spark, d):
    spaced = docs(spark, d).withColumn("text", F.concat(F.lit("a b c d "), "text"))
    return spaced.select("doc_id", B.spaced_letters(F.col("text")).alias("letters"))


@query("e07_numbers_kept", "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{2,}')) AS token FROM documents), a AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL), b AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[0-9]{16}', '', 'g'), '[0-9]{2,}')) AS token FROM documents) GROUP BY ALL) SELECT a.doc_id, sum(least(a.n, coalesce(b.n, 0)))::BIGINT AS kept, sum(a.n)::BIGINT AS numbers FROM a LEFT JOIN b USING (doc_id, token) GROUP BY 1")
def e07(spark, d):
    runs = lambda t: F.regexp_extract_all(t, F.lit("([0-9]{2,})"), F.lit(1))
    a, b = B.bag(docs(spark, d), runs(F.col("text"))), B.bag(docs(spark, d), runs(F.regexp_replace("text", "[0-9]{16}", "")))
    met = B.pair(a, b)
    return met.groupBy("doc_id").agg(F.sum(F.least("a", "b")).alias("kept"), F.sum("a").alias("numbers")).filter("numbers > 0")


@query("e08_reversed", f"{BAGS}, z AS (SELECT doc_id, reverse(token) AS token, n FROM c) SELECT a.doc_id, count(*) AS tokens, sum(least(a.n, z.n))::BIGINT AS n FROM a JOIN z USING (doc_id, token) GROUP BY 1")
def e08(spark, d):
    a = B.bag(words(spark, d), F.col("words"))
    z = B.bag(thinned(words(spark, d), 30), F.transform("words", lambda w: F.reverse(w)))
    return B.agreed(a, z).groupBy("doc_id").agg(F.count("*").alias("tokens"), F.sum("n").alias("n"))


@query("e09_order_kept")
def e09(spark, d):
    whole = words(spark, d)
    turned = whole.select("doc_id", F.concat(F.expr("slice(words, size(words) div 2 + 1, size(words))"), F.expr("slice(words, 1, size(words) div 2)")).alias("words"))
    return B.order_kept(whole, turned)


@query("e13_broken_paragraphs", f"WITH {LINES}, f AS (SELECT doc_id, line, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS following FROM l) SELECT doc_id, count(*) FILTER (regexp_matches(line, '[a-z,]$') AND regexp_matches(following, '^[a-z]')) AS broken, count(*) AS paragraphs FROM f GROUP BY 1")
def e13(spark, d):
    return B.broken_paragraphs(lines(spark, d))


@query("e15_judged", "SELECT doc_id FROM labels l WHERE quality = 1 AND NOT EXISTS (SELECT 1 FROM labels t WHERE t.doc_id = l.doc_id AND t.toxic = 1)")
def e15(spark, d):
    labels = table(spark, d, "labels")
    return labels.filter("quality = 1").select("doc_id").join(labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query(
    "e16_weighted_summary",
    "WITH r AS (SELECT source, doc_id, n_chars, round(length(replace(text, 'e', '')) / length(text), 6) AS score FROM documents WHERE length(text) > 0), p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score, doc_id)::INT AS place FROM r), m AS (SELECT source, round(sum(score * n_chars) / sum(n_chars), 6) AS mean, count(*) AS documents FROM r GROUP BY 1) SELECT source, mean, documents, place, doc_id, score FROM p JOIN m USING (source) WHERE place <= 8",
)
def e16(spark, d):
    rows = docs(spark, d).filter(F.length("text") > 0).select("source", "doc_id", "n_chars", F.round(F.length(F.replace("text", F.lit("e"), F.lit(""))) / F.length("text"), 6).alias("score"))
    return B.weighted_summary(rows, "source", "score", "n_chars")


@query(
    "e18_compare_runs",
    """WITH o AS (SELECT doc_id, n_chars::DOUBLE AS a, (doc_id % 10)::DOUBLE AS b FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, n_chars + (doc_id % 3 - 1) * 5.0 AS a, (doc_id * 3 % 10)::DOUBLE AS b FROM documents WHERE doc_id % 11 <> 0)
    SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'lost' WHEN o.doc_id IS NULL THEN 'gained' WHEN (o.a - n.a > 2 OR o.b - n.b > 1) AND (n.a - o.a > 2 OR n.b - o.b > 1) THEN 'mixed' WHEN o.a - n.a > 2 OR o.b - n.b > 1 THEN 'worse' WHEN n.a - o.a > 2 OR n.b - o.b > 1 THEN 'better' ELSE 'same' END AS verdict FROM o FULL JOIN n ON o.doc_id = n.doc_id""",
)
def e18(spark, d):
    base = docs(spark, d)
    old = base.filter("doc_id % 7 <> 0").select("doc_id", F.col("n_chars").cast("double").alias("a"), (F.col("doc_id") % 10).cast("double").alias("b"))
    new = base.filter("doc_id % 11 <> 0").select("doc_id", (F.col("n_chars") + (F.col("doc_id") % 3 - 1) * 5.0).alias("a"), (F.col("doc_id") * 3 % 10).cast("double").alias("b"))
    return B.compare_runs(old, new, {"a": 2, "b": 1})


@query("e19_merge_shards", "SELECT source, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def e19(spark, d):
    base = docs(spark, d).select("doc_id", "source", "n_chars")
    merged = B.merge_shards([base.filter(F.col("doc_id") % 3 == k) for k in range(3)])
    return merged.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query("e20_fingerprint")
def e20(spark, d):
    return B.fingerprint(docs(spark, d).withColumn("digest", F.sha2("text", 256)), "doc_id", "digest")


@query("e21_percentiles", "SELECT source, list_sort(list(n_chars))[(least(count(*) - 1, floor(0.9 * count(*))) + 1)::BIGINT] AS p90 FROM documents GROUP BY 1")
def e21(spark, d):
    return B.percentile(docs(spark, d).select("source", "n_chars"), "source", "n_chars", 0.9).select("source", F.col("value").alias("p90"))


@query(
    "e22_recall_verdict",
    f"{RECALL} SELECT doc_id, CASE WHEN kept / reference >= 0.97 AND extra / reference <= 0.05 THEN 'ok' WHEN kept / reference >= 0.85 THEN 'watch' ELSE 'bad' END AS verdict FROM s WHERE reference > 0",
)
def e22(spark, d):
    got = B.recall(both_readers(spark, d), B.bag(thinned(words(spark, d), 30), F.col("words"))).filter("reference > 0")
    share, extra = F.col("kept") / F.col("reference"), F.col("extra") / F.col("reference")
    return got.select("doc_id", F.when((share >= 0.97) & (extra <= 0.05), "ok").when(share >= 0.85, "watch").otherwise("bad").alias("verdict"))


@query(
    "e26_engines",
    "WITH r AS (SELECT doc_id, e FROM documents, (VALUES (2), (3), (5)) v(e) WHERE doc_id % e <> 0), k AS (SELECT doc_id FROM r GROUP BY 1 HAVING count(DISTINCT e) = 3) SELECT e AS engine, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM r JOIN k USING (doc_id) JOIN documents USING (doc_id) GROUP BY 1",
)
def e26(spark, d):
    base = docs(spark, d).select("doc_id", "n_chars")
    rows = base.withColumn("engine", F.explode(F.array(F.lit(2), F.lit(3), F.lit(5)))).filter(F.col("doc_id") % F.col("engine") != 0)
    return rows.join(B.kept_by_all(rows, 3), "doc_id", "left_semi").groupBy("engine").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


STRATUM = "CASE WHEN n_chars < 400 THEN 'short' WHEN lang <> 'en' THEN 'foreign' WHEN n_chars > 5000 THEN 'long' ELSE 'plain' END"


def stratum():
    return F.when(F.col("n_chars") < 400, "short").when(F.col("lang") != "en", "foreign").when(F.col("n_chars") > 5000, "long").otherwise("plain")


@query("e28_strata", f"SELECT {STRATUM} AS stratum, count(*) AS n FROM documents GROUP BY 1")
def e28(spark, d):
    return docs(spark, d).groupBy(stratum().alias("stratum")).agg(F.count("*").alias("n"))


DRAW = "SELECT stratum, doc_id, place FROM (SELECT stratum, doc_id, row_number() OVER (PARTITION BY stratum ORDER BY md5('2026:' || doc_id), doc_id)::INT AS place FROM s) WHERE place <= 25"


@query("e29_stratified_sample", f"WITH s AS (SELECT {STRATUM} AS stratum, doc_id FROM documents) {DRAW}")
def e29(spark, d):
    return B.stratified(docs(spark, d).withColumn("stratum", stratum()), "stratum", "doc_id", 25, 2026)


@query("e30_holdout", f"WITH s AS (SELECT {STRATUM} AS stratum, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) {DRAW}")
def e30(spark, d):
    return B.holdout(docs(spark, d).withColumn("stratum", stratum()), table(spark, d, "labels"), "stratum", "doc_id", 25, 2026)


@query("e31_pinned_digests", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'differs' ELSE 'same' END AS state FROM documents")
def e31(spark, d):
    base = docs(spark, d).select("doc_id", F.sha2("text", 256).alias("digest"))
    pins = base.select("doc_id", F.when(F.col("doc_id") % 9 == 0, "0").otherwise(F.col("digest")).alias("pin"))
    return base.join(pins, "doc_id").select("doc_id", F.when(F.col("digest") == F.col("pin"), "same").otherwise("differs").alias("state"))


@query("e37_outcomes", "WITH e AS (SELECT CASE WHEN event_type = 'purchase' THEN 'ok' WHEN event_type = 'error' AND value > 200 THEN 'timeout' WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'refused' ELSE 'other' END AS outcome, value FROM events) SELECT outcome, count(*) AS n, round(max(value), 4) AS worst FROM e GROUP BY 1")
def e37(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "ok").when((F.col("event_type") == "error") & (F.col("value") > 200), "timeout").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "refused").otherwise("other")
    return table(spark, d, "events").groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("worst"))


@query("e38_key_parity", "WITH a AS (SELECT DISTINCT doc_id AS key FROM documents), b AS (SELECT DISTINCT doc_id + 5 AS key FROM labels) SELECT key, 'missing' AS side FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT key, 'extra' FROM b WHERE key NOT IN (SELECT key FROM a)")
def e38(spark, d):
    return B.missing_keys(docs(spark, d).select(F.col("doc_id").alias("key")), table(spark, d, "labels").select((F.col("doc_id") + 5).alias("key")), "key")


CLAIMS = [("worthless", "insult"), ("idiot", "insult"), ("[0-9]{16}", "number"), ("licen[sc]e", "license")]


@query("e39_claim_scan", f"WITH {LINES}, r(pattern, reason) AS (VALUES {', '.join(f'({p!r}, {t!r})' for p, t in CLAIMS)}) SELECT doc_id, n, pattern, reason FROM l JOIN r ON regexp_matches(line, '(?i)' || pattern)")
def e39(spark, d):
    rules = spark.createDataFrame(CLAIMS, "pattern string, reason string")  # a handful of rules: a theta join with a broadcast side
    return lines(spark, d).join(F.broadcast(rules), F.expr("line RLIKE concat('(?i)', pattern)")).select("doc_id", "n", "pattern", "reason")


# ---- search over part names


def index(spark, d):
    part = table(spark, d, "part")
    return part.groupBy("p_name").agg(F.min("p_partkey").alias("key"), F.collect_set(F.lower("p_type")).alias("types")).select("key", F.array(F.col("p_name")).alias("names"), F.array_sort("types").alias("tags"), F.concat(F.lit("part named "), "p_name").alias("description"))


QUERIES = ["red widget", "widgt", "economy", "blu", "med", "zz", "hot gaer", "named", "ring"]


@query("s05_search")
def s05(spark, d):
    return S.search(spark.createDataFrame([(q,) for q in QUERIES], "query string"), index(spark, d))


@query("s02_edit_distance", "WITH n AS (SELECT DISTINCT p_name FROM part), q AS (SELECT unnest(['red widget', 'widgt', 'hot gaer', 'ring']) AS q) SELECT p_name, q, levenshtein(p_name, q)::INT AS distance, CASE WHEN length(q) <= 4 THEN 1 WHEN length(q) <= 8 THEN 2 ELSE 3 END AS tolerance FROM n, q")
def s02(spark, d):
    names = table(spark, d, "part").select("p_name").distinct()
    asked = names.withColumn("q", F.explode(F.array(*[F.lit(x) for x in ("red widget", "widgt", "hot gaer", "ring")])))
    return asked.select("p_name", "q", F.levenshtein("p_name", "q").alias("distance"), S.tolerance(F.col("q")).alias("tolerance"))


# ---- scores


@query(
    "q05_flow",
    f"""WITH {LINES}, t AS (SELECT doc_id, trim(line, ' ') AS t, n % 2 AS breaks FROM l WHERE trim(line, ' ') <> ''), f AS (SELECT doc_id, breaks, CASE WHEN length(t) >= 50 AND NOT regexp_matches(t, '[0-9.!?:;…。！？：；؟)"''”’»\\]]$') THEN CASE WHEN ends_with(t, '-') THEN 2 ELSE 1 END ELSE 0 END AS frag FROM t),
    s AS (SELECT doc_id, count(*) AS n, sum(frag) AS frag, sum(breaks) AS breaks FROM f GROUP BY 1) SELECT doc_id, round(greatest(0.0, 1 - least(0.4, breaks / n * 0.5) - least(0.5, greatest(0.0, frag / n - 0.08) * 1.4)), 6) AS flow FROM s""",
)
def q05(spark, d):
    return Q.flow_check(lines(spark, d).select("doc_id", "line", (F.col("n") % 2).alias("breaks")))


@query("q03_indexes", "WITH t AS (SELECT page_id, CASE WHEN page_id % 4 > 0 THEN 1 - 0.6 * (page_id % 4) / (page_id % 4 + 2) ELSE 1.0 END AS tables, 0.8 + (page_id % 5) * 0.04 AS flow FROM pages) SELECT page_id, round(tables, 6) AS tables, round(round(tables, 3) * (100 * 0.20 / 1.0) + round(0.75, 3) * (100 * 0.45 / 1.0) + round(flow, 3) * (100 * 0.35 / 1.0), 1) AS docx, round(round(tables, 3) * (100 * 0.36 / 1.0) + round(flow, 3) * (100 * 0.64 / 1.0), 1) AS markdown FROM t")
def q03(spark, d):
    kind = "array<struct<rows:int,cols:int,chars:int,in_textbox:boolean,regular:boolean>>"
    one = lambda box: F.struct(F.lit(3).alias("rows"), F.lit(3).alias("cols"), F.lit(90).alias("chars"), F.lit(box).alias("in_textbox"), F.lit(True).alias("regular"))
    boxes = F.array_repeat(one(True), (F.col("page_id") % 4).cast("int"))
    t = Q.tables_check(F.concat(F.array(one(False), one(False)), boxes).cast(kind))
    flow = F.lit(0.8) + (F.col("page_id") % 5) * 0.04
    return table(spark, d, "pages").select("page_id", F.round(t, 6).alias("tables"), Q.docx_index(t, Q.paragraphs_check(F.lit(50), F.lit(25), F.lit(25)), flow).alias("docx"), Q.markdown_index(t, flow).alias("markdown"))


@query(
    "q08_sheet_consistency",
    "WITH r AS (SELECT o_custkey AS sheet, count(*) AS cells, o_orderpriority AS p FROM orders GROUP BY 1, 3), c AS (SELECT sheet, cells, count(*) AS n FROM r GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY n DESC, cells) AS k, sum(n) OVER (PARTITION BY sheet) AS total FROM c) SELECT sheet, cells AS mode, round(greatest(0.0, 1 - 1.2 * (1 - n / total)), 6) AS consistency FROM b WHERE k = 1",
)
def q08(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("sheet"), "o_orderpriority").agg(F.count("*").alias("cells"))
    return Q.sheet_consistency(rows.select("sheet", "cells"))


@query("q09_confidence", "WITH c AS (SELECT doc_id, least(50.0, 60 * ((doc_id % 4) / 10)) + CASE WHEN (doc_id % 5) / 100 > 0.03 THEN 25 ELSE 0 END + CASE WHEN doc_id % 12 < 9 THEN 10 ELSE 0 END + CASE WHEN doc_id % 6 / 10 > 0.3 THEN 10 ELSE 0 END + CASE WHEN doc_id % 8 > 5 THEN 5 ELSE 0 END AS lost FROM documents), v AS (SELECT doc_id, round(greatest(0.0, 100 - lost), 1) AS value FROM c) SELECT doc_id, value, CASE WHEN value >= 80 THEN 'high' WHEN value >= 55 THEN 'medium' ELSE 'low' END AS grade FROM v")
def q09(spark, d):
    i = F.col("doc_id")
    got = Q.confidence(i % 4, F.lit(10), i % 5, F.lit(100), i % 12, i % 6, F.lit(10), i % 8)
    return docs(spark, d).select("doc_id", got.alias("c")).select("doc_id", "c.value", "c.grade")


@query("q10_markdown_signals", f"WITH {LINES}, m AS (SELECT doc_id, CASE n % 4 WHEN 0 THEN '## ' || line WHEN 1 THEN '- ' || line WHEN 2 THEN '|' || n || '|' ELSE '**' || line END AS line, n % 4 AS k FROM l) SELECT doc_id, count(*) FILTER (k = 0)::INT AS headings, count(*) FILTER (k = 1)::INT AS items, count(*) FILTER (k = 2)::INT AS table_rows, sum((length(line) - length(replace(line, '**', ''))) // 2) % 2 = 1 OR sum((length(line) - length(replace(line, '$$', ''))) // 2) % 2 = 1 AS unpaired FROM m GROUP BY 1")
def q10(spark, d):
    n = F.col("n")
    marked = F.transform(F.split("text", "\n"), lambda line, i: F.when((i + 1) % 4 == 0, F.concat(F.lit("## "), line)).when((i + 1) % 4 == 1, F.concat(F.lit("- "), line)).when((i + 1) % 4 == 2, F.concat(F.lit("|"), (i + 1).cast("string"), F.lit("|"))).otherwise(F.concat(F.lit("**"), line)))
    return docs(spark, d).select("doc_id", Q.markdown_signals(F.array_join(marked, "\n")).alias("s")).select("doc_id", "s.headings", "s.items", "s.table_rows", "s.unpaired")
