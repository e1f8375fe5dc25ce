"""Queries of the text, guard and detection operators over documents, events and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import bands, clients, guards
from vellumspark.functions import text as T
from vellumspark.operators import detect as D
from vellumspark.plans.registry import query
from vellumspark.session import table

AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/132.0 Safari/537.36 Edg/132.0",
    "Mozilla/5.0 (iPad; CPU OS 17_0 like Mac OS X) AppleWebKit/605.1 Version/17.0 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 Chrome/131.0 Mobile Safari/537.36 MicroMessenger/8.0",
    "Mozilla/5.0 (Linux; Android 13; SM-X700) AppleWebKit/537.36 Chrome/131.0 Safari/537.36",
    "Mozilla/5.0 (X11; Linux x86_64; rv:133.0) Gecko/20100101 Firefox/133.0",
    "Mozilla/5.0 (Phone; OpenHarmony 5.0) AppleWebKit/537.36 Chrome/132.0 Safari/537.36 ArkWeb/4.1 Mobile",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1 Version/17.1 Safari/605.1",
    "Mozilla/5.0 (Linux; Android 12) Chrome/100.0 Mobile Safari/537.36 QQ/8.9.1",
    "Mozilla/5.0 (X11; CrOS x86_64) Chrome/120.0 Safari/537.36 OPR/106.0",
    "",
]


def quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, n (from 1), line."""
    return docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS n FROM documents)"
EVENTS = "e AS (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events)"


def pick(values: list[str], index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _cases(rules: list[tuple[str, str]], otherwise: str, column: str = "ua") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '(?i){p}') THEN '{n}'" for p, n in rules) + f" ELSE '{otherwise}' END"


@query(
    "b01_user_agents",
    f"""WITH {EVENTS}, u AS (SELECT event_id, {quoted(AGENTS)}[k % {len(AGENTS)} + 1] AS ua FROM e)
    SELECT event_id, CASE WHEN regexp_matches(ua, '(?i)ipad') THEN 'tablet' WHEN regexp_matches(ua, '(?i)android') THEN CASE WHEN regexp_matches(ua, '(?i)mobile') THEN 'mobile' ELSE 'tablet' END
      WHEN regexp_matches(ua, '(?i)iphone|ipod|mobi') THEN 'mobile' ELSE 'desktop' END AS device, {_cases(clients.BROWSERS, 'other')} AS browser, {_cases(clients.SYSTEMS, 'other')} AS os,
      CASE WHEN {_cases(clients.APPS, 'none')} <> 'none' THEN {_cases(clients.APPS, 'none')} WHEN regexp_matches(ua, '(?i)(^|[^a-z0-9_])qq/[0-9.]+') AND NOT regexp_matches(ua, '(?i)mqqbrowser') THEN 'qq' ELSE 'none' END AS app FROM u""",
)
def b01(spark, d):
    e = events(spark, d).withColumn("ua", pick(AGENTS, F.col("k") % len(AGENTS)))
    ua = F.col("ua")
    return e.select("event_id", clients.device(ua).alias("device"), clients.browser(ua).alias("browser"), clients.system(ua).alias("os"), clients.app(ua).alias("app"))


@query(
    "b03_data_points",
    f"WITH {EVENTS} SELECT event_id, event_type AS index, ['en', 't' || (k % 8), user_id::VARCHAR, 'note=n' || k, 'x_late=y'] AS texts, [value, k::DOUBLE] AS numbers FROM e",
)
def b03(spark, d):
    e = events(spark, d)
    props = F.create_map(
        F.lit("locale"), F.lit("en"), F.lit("tool"), F.concat(F.lit("t"), (F.col("k") % 8).cast("string")), F.lit("session"), F.col("user_id").cast("string"),
        F.lit("x_late"), F.lit("y"), F.lit("value"), F.col("value").cast("string"), F.lit("note"), F.concat(F.lit("n"), F.col("k").cast("string")), F.lit("k"), F.col("k").cast("string"),
    )
    return e.select("event_id", guards.data_point(F.col("event_type"), props).alias("p")).select("event_id", "p.index", "p.texts", "p.numbers")


@query(
    "b04_event_gate",
    f"""WITH {EVENTS} SELECT event_id, CASE WHEN k % 10 = 0 THEN 'method' WHEN k % 10 = 1 THEN 'origin' WHEN k % 10 = 2 THEN 'event' WHEN user_id % 5 = 1 THEN 'country' END AS reason,
    CASE WHEN k % 10 > 2 AND user_id % 5 <> 1 THEN event_type END AS event FROM e""",
)
def b04(spark, d):
    k = F.col("k") % 10
    requests = events(spark, d).select(
        "event_id",
        F.when(k == 0, "GET").otherwise("POST").alias("method"),
        F.when(k == 1, "https://elsewhere.test").otherwise("https://here.test").alias("origin"),
        F.lit("here.test").alias("host"),
        F.when(F.col("user_id") % 5 == 1, "UZ").otherwise("DE").alias("country"),
        F.to_json(F.struct(F.when(k == 2, " ").otherwise(F.col("event_type")).alias("event"), F.struct("value").alias("props"))).alias("body"),
    )
    return guards.gate_events(requests).select("event_id", "reason", "event")


@query("b05_feedback_gate", f"""WITH {LINES} SELECT doc_id, n, CASE WHEN doc_id % 7 = 0 THEN 'kind' WHEN doc_id % 7 = 1 THEN 'honeypot' WHEN doc_id % 7 = 2 THEN 'email' WHEN length(substr(trim(line, ' '), 1, 1000)) < 12 THEN 'short'
  WHEN regexp_matches(substr(trim(line, ' '), 1, 1000), '^[0-9]+$') THEN 'spam' ELSE 'ok' END AS reason, length(substr(trim(line, ' '), 1, 1000)) AS n_chars FROM l""")
def b05(spark, d):
    k = F.col("doc_id") % 7
    rows = lines(spark, d).select(
        "doc_id", "n", F.when(k == 0, "spam").when(k == 2, "waitlist").otherwise("bug").alias("kind"), F.col("line").alias("message"), F.lit(None).cast("string").alias("email"), F.when(k == 1, "x").alias("honeypot")
    )
    # back-references have no SQL counterpart: runs of ten are left to the unit test
    gated = guards.gate_feedback(rows, least=12)
    reason = F.when(F.col("reason") == "spam", F.when(F.col("clean_message").rlike("^[0-9]+$"), "spam").otherwise("ok")).otherwise(F.coalesce("reason", F.lit("ok")))
    return gated.select("doc_id", "n", reason.alias("reason"), F.length("clean_message").cast("long").alias("n_chars"))


@query("b06_spam")
def b06(spark, d):
    return lines(spark, d).select("doc_id", "n", guards.looks_like_spam(F.col("line")).alias("spam"))


@query("b07_sheet_safe", f"WITH {LINES}, m AS (SELECT doc_id, n, CASE WHEN n % 3 = 0 THEN '=' || line ELSE line END AS line FROM l) SELECT doc_id, n, CASE WHEN regexp_matches(line, '^[=+\\-@]') THEN '''' || line ELSE line END AS safe FROM m")
def b07(spark, d):
    marked = lines(spark, d).withColumn("line", F.when(F.col("n") % 3 == 0, F.concat(F.lit("="), "line")).otherwise(F.col("line")))
    return marked.select("doc_id", "n", guards.sheet_safe(F.col("line")).alias("safe"))


@query(
    "b08_bands",
    f"""WITH {EVENTS}, s AS (SELECT event_id, CASE WHEN k = 0 THEN NULL ELSE k::BIGINT * k * 97531 END AS size, value, k FROM e) SELECT event_id,
    CASE WHEN size IS NULL THEN 'unknown' WHEN size < 1048576 THEN '<1' WHEN size < 10485760 THEN '1-10' WHEN size <= 52428800 THEN '10-50' ELSE '>50' END AS size_band,
    CASE WHEN size IS NULL THEN 'unknown' WHEN size < 1048576 THEN '<1' WHEN size < 10485760 THEN '1-10' WHEN size <= 52428800 THEN '10-50' WHEN size <= 157286400 THEN '50-150' WHEN size <= 629145600 THEN '150-600' ELSE '>600' END AS unreadable_band,
    (floor(floor(value * 100 / 1000 + 0.5) / 5 + 0.5) * 5)::BIGINT AS seconds,
    CASE WHEN value / 100 <= 1.1 THEN '<=1.1' WHEN value / 100 <= 1.5 THEN '<=1.5' WHEN value / 100 <= 2 THEN '<=2' ELSE '>2' END AS fit FROM s""",
)
def b08(spark, d):
    size = F.when(F.col("k") != 0, F.col("k").cast("long") * F.col("k") * 97531)
    e = events(spark, d).withColumn("size", size)
    return e.select(
        "event_id",
        bands.size_band(F.col("size")).alias("size_band"),
        bands.unreadable_size_band(F.col("size")).alias("unreadable_band"),
        bands.rounded_duration(F.col("value") * 100).alias("seconds"),
        bands.fit_band(F.col("value") / 100).alias("fit"),
    )


NAMES = ["scan.PDF", "a.b.docx", "noext", "odd.toolongextension", "x.tar.gz", "dot.", "photo.jpeg"]


@query("b12_extensions", f"WITH {EVENTS}, x AS (SELECT event_id, {quoted(NAMES)}[k % 7 + 1] AS name FROM e) SELECT event_id, CASE WHEN regexp_extract(lower(name), '\\.([a-z0-9]{{1,8}})$', 1) <> '' THEN regexp_extract(lower(name), '\\.([a-z0-9]{{1,8}})$', 1) WHEN contains(name, '.') THEN 'other' ELSE 'none' END AS ext FROM x")
def b12(spark, d):
    return events(spark, d).select("event_id", bands.extension(pick(NAMES, F.col("k") % 7)).alias("ext"))


@query("b20_prefix_hash", "SELECT doc_id, sha256(unhex(hex(encode(text))[1:2000])) AS prefix_hash FROM documents")
def b20(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(F.substring(F.col("text").cast("binary"), 1, 1000), 256).alias("prefix_hash"))


@query(
    "b25_error_signatures",
    f"WITH {LINES}, s AS (SELECT doc_id, regexp_replace(regexp_replace(line, '\"[^\"]*\"', '\"\"', 'g'), '[0-9]+', '#', 'g') AS signature FROM l) SELECT signature, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_doc FROM s GROUP BY signature",
)
def b25(spark, d):
    signature = T.mask_digits(F.regexp_replace("line", '"[^"]*"', '""'))
    return lines(spark, d).groupBy(signature.alias("signature")).agg(F.countDistinct("doc_id").alias("documents"), F.min("doc_id").alias("first_doc"))


@query("c01_fold_diacritics")
def c01(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(T.fold_diacritics(F.lower("text")), 256).alias("folded_sha256"))


@query("c02_character_map", "SELECT doc_id, md5(translate(text, 'éèêçüäößñíáó', 'eeecuaosniao')) AS mapped FROM documents")
def c02(spark, d):
    return docs(spark, d).select("doc_id", F.md5(F.translate("text", "éèêçüäößñíáó", "eeecuaosniao").cast("binary")).alias("mapped"))


@query("c04_watermark_lines")
def c04(spark, d):
    return lines(spark, d).groupBy(T.watermark_text(F.col("line")).alias("line")).agg(F.countDistinct("doc_id").alias("documents")).filter("documents >= 3")


@query("c05_mask_digits", f"WITH {LINES} SELECT regexp_replace(line, '[0-9]+', '#', 'g') AS masked, count(*) AS n FROM l WHERE regexp_matches(line, '[0-9]') GROUP BY 1")
def c05(spark, d):
    return lines(spark, d).filter(F.col("line").rlike("[0-9]")).groupBy(T.mask_digits(F.col("line")).alias("masked")).agg(F.count("*").alias("n"))


@query(
    "c19_line_kinds",
    f"""WITH {LINES}, m AS (SELECT doc_id, n, CASE n % 5 WHEN 0 THEN '• ' || line WHEN 1 THEN n || '. ' || line WHEN 2 THEN 'b) ' || line WHEN 3 THEN line || ' .... 12' ELSE line || ' 28,971.05' END AS line FROM l) SELECT doc_id, n,
    CASE WHEN regexp_matches(line, '^[•◦▪‣●○][ ]*[^\\s•◦▪‣●○]') THEN 'bullet' WHEN regexp_matches(line, '^[0-9]{{1,3}}[.)]([^0-9]|$)') THEN 'numbered' WHEN regexp_matches(line, '^[a-zA-Z][.)]([^A-Za-z0-9_]|$)') THEN 'lettered' ELSE 'none' END AS marker,
    regexp_matches(line, '[0-9]{{1,3}}(,[0-9]{{3}})+\\.[0-9]{{2}}([^A-Za-z0-9_]|$)') AS money, regexp_matches(line, '\\.{{4,}}\\s*[0-9]{{1,4}}\\s*$') AS contents, regexp_matches(rtrim(line, ' '), '[.!?…。！？؟]$') AS ended FROM m""",
)
def c19(spark, d):
    n, line = F.col("n"), F.col("line")
    marked = lines(spark, d).withColumn(
        "line",
        F.when(n % 5 == 0, F.concat(F.lit("• "), line)).when(n % 5 == 1, F.concat(n.cast("string"), F.lit(". "), line)).when(n % 5 == 2, F.concat(F.lit("b) "), line)).when(n % 5 == 3, F.concat(line, F.lit(" .... 12"))).otherwise(F.concat(line, F.lit(" 28,971.05"))),
    )
    return marked.select("doc_id", "n", T.marker(line).alias("marker"), T.has_money(line).alias("money"), T.is_contents_entry(line).alias("contents"), T.ends_sentence(line).alias("ended"))


@query("c14_hyphen_join")
def c14(spark, d):
    words = docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([a-z]{6,})"), F.lit(1))).alias("word")).distinct()
    return words.select("doc_id", "word", T.hyphen_join(F.concat(F.substring("word", 1, 3), F.lit("-")), F.expr("substring(word, 4)")).alias("joined"))


ROMAN_SQL = "['','M','MM','MMM'][{0} // 1000 + 1] || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][{0} // 100 % 10 + 1] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][{0} // 10 % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][{0} % 10 + 1]"


@query(
    "c24_numbering",
    f"SELECT p_partkey AS n, CASE WHEN p_partkey BETWEEN 1 AND 3999 THEN {ROMAN_SQL.format('p_partkey')} ELSE p_partkey::VARCHAR END AS roman, CASE WHEN p_partkey < 1 THEN p_partkey::VARCHAR WHEN p_partkey <= 26 THEN chr(64 + p_partkey::INT) WHEN p_partkey <= 702 THEN chr(64 + ((p_partkey - 1) // 26)::INT) || chr(65 + ((p_partkey - 1) % 26)::INT) ELSE chr(64 + ((p_partkey - 703) // 676 + 1)::INT) || chr(65 + ((p_partkey - 703) // 26 % 26)::INT) || chr(65 + ((p_partkey - 1) % 26)::INT) END AS letters FROM part",
)
def c24(spark, d):
    n = F.col("p_partkey")
    return table(spark, d, "part").select(n.alias("n"), T.roman(n).alias("roman"), T.alphabetic(n).alias("letters"))


@query("c26_safe_filenames", f"""WITH {LINES} SELECT doc_id, n, n || ' - ' || substr(trim(regexp_replace(line, '[\\x00-\\x1F<>:"/\\\\|?*]', '_', 'g'), ' '), 1, 60) AS filename FROM l""")
def c26(spark, d):
    return lines(spark, d).select("doc_id", "n", T.safe_filename(F.col("line"), F.col("n")).alias("filename"))


@query("c27_substitute_fields", "SELECT p_partkey, '<' || p_partkey || '>' || p_name || '[' || p_brand || ']' AS filled FROM part")
def c27(spark, d):
    fields = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), v.alias("value")) for a, b, v in ((1, 2, F.col("p_partkey").cast("string")), (3, 4, F.col("p_name")), (5, 6, F.col("p_brand")))])
    return table(spark, d, "part").select("p_partkey", T.substitute(F.lit("<K>N[B]"), fields).alias("filled"))


@query(
    "c28_page_ranges",
    "SELECT p_partkey, list_sort(list_distinct(list_concat(range(1, least(p_size, 10) + 1), range(greatest(p_size - 3, 1), least(p_size, 40) + 1)))) AS pages FROM part",
)
def c28(spark, d):
    size = F.col("p_size")
    spec = F.concat(F.lit("1-"), F.least(size, F.lit(10)).cast("string"), F.lit("、 "), size.cast("string"), F.lit("－"), F.greatest(size - 3, F.lit(1)).cast("string"), F.lit(", x"))
    return table(spark, d, "part").select("p_partkey", F.transform(T.page_range(spec, F.lit(40)), lambda x: x.cast("long")).alias("pages"))


@query(
    "c29_range_text",
    "WITH p AS (SELECT p_partkey, unnest(list_filter(range(1, p_size + 1), lambda x: (x * 7 + p_partkey) % 4 <> 0)) AS page FROM part), g AS (SELECT p_partkey, page, page - row_number() OVER (PARTITION BY p_partkey ORDER BY page) AS run FROM p), r AS (SELECT p_partkey, min(page) AS a, max(page) AS b FROM g GROUP BY p_partkey, run) SELECT p_partkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS text FROM r GROUP BY p_partkey",
)
def c29(spark, d):
    pages = F.filter(F.sequence(F.lit(1).cast("int"), F.col("p_size")), lambda x: (x * 7 + F.col("p_partkey")) % 4 != 0)
    return table(spark, d, "part").select("p_partkey", T.range_text(pages).alias("text")).filter("text <> ''")


CELLS = ["1,234.50", "12%", "2024-02-29", "2026-02-31", "007", "-5", "1,23,4", "$3.50", "abc", "1234567890123456", "٣٤", "1899-12-31"]


@query(
    "c30_cells",
    f"WITH {EVENTS} SELECT event_id, ['number','percent','date','text','text','number','text','number','text','text','number','text'][k % 12 + 1] AS kind, [1234.5, 0.12, NULL, NULL, NULL, -5, NULL, 3.5, NULL, NULL, 34, NULL][k % 12 + 1]::DOUBLE AS num, CASE WHEN k % 12 = 2 THEN DATE '2024-02-29' END AS date FROM e",
)
def c30(spark, d):
    return events(spark, d).select("event_id", T.cell_value(pick(CELLS, F.col("k") % 12)).alias("c")).select("event_id", "c.kind", "c.num", "c.date")


@query("c32_word_count", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda w: w <> ''))::BIGINT AS words FROM documents")
def c32(spark, d):
    return docs(spark, d).select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"))


@query("c33_mixed_tokens")
def c33(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.mixed_tokens(F.col("text"))).alias("tokens"))


@query("c36_number_runs", "SELECT doc_id, regexp_extract_all(text, '[0-9]{2,}') AS runs FROM documents")
def c36(spark, d):
    return docs(spark, d).select("doc_id", T.number_runs(F.col("text")).alias("runs"))


@query("c38_file_sizes", "SELECT p_partkey, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f', s / 1024) || ' KB' ELSE printf('%.1f', s / 1048576) || ' MB' END AS size FROM (SELECT p_partkey, p_partkey * 1000 + 7 AS s FROM part)")
def c38(spark, d):
    return table(spark, d, "part").select("p_partkey", T.file_size(F.col("p_partkey") * 1000 + 7).alias("size"))


@query("c39_escape_html", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped FROM pages")
def c39(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.escape_html(F.col("html")).cast("binary")).alias("escaped"))


PII_SQL = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS match FROM documents" for k, p in D.PII.items() if k in ("email", "url", "phone", "iban"))


@query("d01_personal_data", PII_SQL)
def d01(spark, d):
    return D.pii_matches(docs(spark, d), ["email", "url", "phone", "iban"])


@query("d01_cards")
def d01_cards(spark, d):
    return D.pii_matches(docs(spark, d), ["cc"]).groupBy("kind").agg(F.count("*").alias("n")).unionByName(docs(spark, d).agg(F.lit("documents").alias("kind"), F.count("*").alias("n")))


LUHN_DIGITS = "list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN (substr(c, i::INT, 1)::INT * 2) // 10 + (substr(c, i::INT, 1)::INT * 2) % 10 ELSE substr(c, i::INT, 1)::INT END)"


@query("d02_luhn", f"SELECT o_orderkey, list_sum({LUHN_DIGITS}) % 10 = 0 AS valid FROM (SELECT o_orderkey, lpad((o_orderkey * 7919 + 4000000000000000)::VARCHAR, 16, '0') AS c FROM orders)")
def d02(spark, d):
    number = F.lpad((F.col("o_orderkey") * 7919 + 4000000000000000).cast("string"), 16, "0")
    return table(spark, d, "orders").select("o_orderkey", D.luhn(number).alias("valid"))


@query("d03_redacted", "SELECT doc_id, md5(regexp_replace(text, '[a-zA-Z0-9._%+\\w]{1,64}@[a-zA-Z0-9.]{1,253}\\.[a-zA-Z]{2,24}', '█', 'g')) AS redacted FROM documents")
def d03(spark, d):
    return docs(spark, d).select("doc_id", F.md5(D.redact(F.col("text"), "email").cast("binary")).alias("redacted"))


@query("d07_glossary_lines", f"WITH {LINES}, g AS (SELECT split_part(line, ' ', 1) || ' - ' || line AS line FROM l), s AS (SELECT trim(substr(line, 1, strpos(line, ' - ') - 1), ' ') AS term, trim(substr(line, strpos(line, ' - ') + 3), ' ') AS definition FROM g WHERE strpos(line, ' - ') > 0) SELECT term, count(*) AS n FROM s WHERE term <> '' AND definition <> '' GROUP BY term")
def d07(spark, d):
    made = lines(spark, d).select(F.concat(F.split_part("line", F.lit(" "), F.lit(1)), F.lit(" - "), "line").alias("line"))
    return D.glossary_lines(made).groupBy("term").agg(F.count("*").alias("n"))


TERMS = ["the", "and", "idiot", "that", "worthless"]


@query("d08_glossary_matches", f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}0-9_]+')) AS w FROM documents) SELECT doc_id, w AS term, count(*) AS n FROM w WHERE w IN ({', '.join(repr(t) for t in TERMS)}) GROUP BY ALL")
def d08(spark, d):
    return D.glossary_matches(docs(spark, d), spark.createDataFrame([(t,) for t in TERMS], "term string"))


@query("d10_scripts")
def d10(spark, d):
    return docs(spark, d).select("doc_id", D.script_language(F.col("text")).alias("s")).select("doc_id", "s.lang", "s.confident")


LEXICON = ", ".join(f"('{w}', '{lang}')" for lang, words in D.COMMON_WORDS.items() for w in sorted(set(words.split())))


@query(
    "d11_common_word_language",
    f"""WITH x(word, lang) AS (VALUES {LEXICON}), u AS (SELECT word, min(lang) AS lang FROM x GROUP BY 1 HAVING count(*) = 1 AND min(lang) <> 'eng'),
    w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{2,}}')) AS word FROM documents), t AS (SELECT doc_id, count(*) AS words FROM w GROUP BY 1),
    c AS (SELECT doc_id, lang, count(*) AS n FROM w JOIN u USING (word) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) AS place FROM c)
    SELECT d.doc_id, CASE WHEN a.n >= 0.03 * t.words AND a.n >= 2 * coalesce(b.n, 0) THEN a.lang ELSE 'eng' END AS lang FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN r a ON a.doc_id = d.doc_id AND a.place = 1 LEFT JOIN r b ON b.doc_id = d.doc_id AND b.place = 2""",
)
def d11(spark, d):
    return D.common_word_language(docs(spark, d))


URIS = ["https://user:pw@example.com/a", "http://10.0.0.1/x", "https://bit.ly/3", "javascript:alert(1)", "file:///etc/x", "mailto:a@b.c", "plain/path", "https://www.xn--abc.com/", "data:text/html,x", "HTTPS://News.Example.co.uk:8443/p?q"]
HOSTS = ["example.com", "10.0.0.1", "bit.ly", None, None, None, None, "www.xn--abc.com", None, "news.example.co.uk"]
FLAGS = ["['credentials-in-url']", "['not-https', 'ip-address']", "['shortener']", "['script-scheme']", "['local-file']", "[]", "['no-scheme']", "['punycode']", "['data-uri']", "[]"]


@query("d14_addresses", f"WITH {EVENTS} SELECT event_id, [{', '.join('NULL' if h is None else repr(h) for h in HOSTS)}][k % 10 + 1] AS host, ([{', '.join(FLAGS)}]::VARCHAR[][])[k % 10 + 1] AS flags FROM e")
def d14(spark, d):
    return events(spark, d).select("event_id", D.uri_flags(pick(URIS, F.col("k") % 10)).alias("u")).select("event_id", "u.host", "u.flags")


@query("d15_sites", "WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host FROM pages) SELECT page_id, array_to_string(string_split(host, '.')[-2:], '.') AS site FROM h")
def d15(spark, d):
    return table(spark, d, "pages").select("page_id", D.site(F.lower(F.regexp_extract("url", "://([^/?#:]*)", 1))).alias("site"))


@query("d19_file_risk", f"WITH {EVENTS}, x AS (SELECT event_id, {quoted(['a.exe', 'b.pdf', '', 'c.ZIP', 'd.docx', 'e.htm', 'f.sh '])}[k % 7 + 1] AS name FROM e) SELECT event_id, CASE WHEN name = '' OR regexp_matches(trim(name, ' '), '(?i)\\.(exe|zip|htm|sh)$') THEN 'high' ELSE 'medium' END AS risk FROM x")
def d19(spark, d):
    return events(spark, d).select("event_id", D.file_risk(pick(["a.exe", "b.pdf", "", "c.ZIP", "d.docx", "e.htm", "f.sh "], F.col("k") % 7)).alias("risk"))


@query("d20_address_report", "SELECT url AS uri, max(page_id % 4) AS worst, count(*) AS n FROM pages GROUP BY url")
def d20(spark, d):
    return D.address_report(table(spark, d, "pages").select(F.col("url").alias("uri"), (F.col("page_id") % 4).alias("level")))
