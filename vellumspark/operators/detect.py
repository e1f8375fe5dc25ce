"""Detection in texts: personal data, scripts, languages by common words, glossary terms, addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Personal-data patterns, all bounded.
PII = {
    "email": r"[a-zA-Z0-9._%+\w]{1,64}@[a-zA-Z0-9.]{1,253}\.[a-zA-Z]{2,24}",
    "phone": r"(?:\+\d{1,3}[\s]?)?\(?\d{2,4}\)?[\s.]\d{2,4}[\s.]\d{2,9}",
    "cc": r"\b\d{4}[\s]?\d{4}[\s]?\d{4}[\s]?\d{4}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{1,30}\b",
    "url": r"(?i)https?:\/\/[^\s]+",
}
#: Common words of twelve Latin-script languages; a word of several languages says nothing. Others are given as a parameter.
COMMON_WORDS = {
    "eng": "the and of to is in that for it with as are on be this by or from your you can a i",
    "fra": "le la les des est et une un du pour que dans pas sur vous qui avec sont au ne ce votre plus",
    "deu": "der die und das ist nicht ein eine den mit auf für fur sie es dem zu von werden wird sich auch oder bei",
    "spa": "el la los las de que y en un una es para por con del se su no al como sus más mas",
    "ita": "il la di che e è per un una del della sono con non le gli dei alla nel si come più piu senza nessun nessuna tutti puoi vuoi sul tuo suoi questo questa viene ogni anche",
    "por": "o a os as de que e do da em um uma para com não nao no na se por dos das seu sua",
    "nld": "de het een en van is in dat op te met voor zijn niet je die worden wordt ook aan bij",
    "pol": "i w z na do się sie nie to jest że ze o jak lub od po dla są sa przez co",
    "tur": "ve bir bu için icin ile da de olarak daha olan gibi veya her çok cok en ama sonra kadar",
    "vie": "và của là các có trong cho được không những một với này để khi từ người mot khong cua cac voi nhung duoc nay hoac nhieu cung",
    "uzb": "uchun bilan esa yoki emas kabi mumkin hamda orqali qilish barcha faqat agar lekin",
    "ind": "dan yang di ini untuk dengan dari tidak ke anda dalam akan atau pada adalah bisa juga",
}
#: Code point ranges, link shorteners, extensions of files that run when opened.
SCRIPTS = {"lat": "A-ɏ", "cyr": "Ѐ-ӿ", "heb": "֐-׿", "ara": "؀-ۿ", "kana": "぀-ヿ", "cjk": "丁-鿿", "han": "가-힣", "dev": "ऀ-ॿ", "tha": "฀-๿"}
SHORTENERS = ["bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "rebrand.ly", "cutt.ly", "shorturl.at", "tiny.cc", "rb.gy", "lnkd.in", "qrco.de", "s.id", "v.gd"]
RUNNABLE = r"(?i)\.(exe|com|scr|pif|bat|cmd|ps1|psm1|vbs|vbe|js|jse|wsf|wsh|hta|msi|msp|dll|cpl|jar|lnk|url|reg|sh|app|dmg|iso|img|docm|xlsm|pptm|dotm|xlam|ppam|zip|rar|7z|gz|cab|html?|svg)$"


def luhn(text: Column) -> Column:
    """Check digit of 13 to 19 digits."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))


def pii_matches(docs: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """One row per match: doc_id, kind, match."""
    found = []
    for kind in kinds or list(PII):
        own = docs.select("doc_id", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(PII[kind]), F.lit(0))).alias("match"))
        found.append(own.filter(luhn(F.col("match"))) if kind == "cc" else own)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def redact(text: Column, kind: str, mark: str = "█") -> Column:
    return F.regexp_replace(text, PII[kind], mark)


def script_counts(text: Column) -> Column:
    return F.struct(*[F.regexp_count(text, F.lit(f"[{r}]")).alias(n) for n, r in SCRIPTS.items()])


def telling_words(words_of: dict[str, str] | None = None) -> dict[str, list[str]]:
    """For each language its common words that no other language has."""
    given = {lang: set(words.split()) for lang, words in (words_of or COMMON_WORDS).items()}
    return {lang: sorted(w for w in words if sum(w in other for other in given.values()) == 1) for lang, words in given.items()}


def latin_language(text: Column) -> Column:
    """Language of a Latin-script text by its common words, inside the row: 3 % of the words and twice the next one's, else eng."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{2,})"), F.lit(1))

    def number_of(found: Column, own: list[str]) -> Column:
        return F.size(F.filter(found, lambda w: w.isin(own)))

    def decide(found: Column) -> Column:
        telling = {lang: own for lang, own in telling_words().items() if lang != "eng"}
        counts = F.array(*[F.struct((-number_of(found, own)).alias("less"), F.lit(k).alias("place"), F.lit(lang).alias("lang")) for k, (lang, own) in enumerate(telling.items())])

        def choose(ranked: Column) -> Column:
            first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
            sure = (first["less"] < 0) & (-first["less"] >= 0.03 * F.size(found)) & (-first["less"] >= -2 * second["less"])
            return F.when(sure, first["lang"]).otherwise("eng")

        return F.get(F.transform(F.array(F.array_sort(counts)), choose), F.lit(0))

    return F.get(F.transform(F.array(words), decide), F.lit(0))


def script_language(text: Column, confidence: Column | None = None) -> Column:
    """Language by script with whether it can be relied on."""
    c = script_counts(text)
    cyrillic = (c["cyr"] > c["lat"] * 0.25) & (c["cyr"] > 5)
    lang = (
        F.when(c["kana"] > 3, "jpn")
        .when(c["han"] > 5, "kor")
        .when((c["cjk"] > 10) & (c["kana"] > 0), "jpn")
        .when(c["cjk"] > 10, "chi_sim")
        .when(c["ara"] > 5, "ara")
        .when(c["heb"] > 5, "heb")
        .when(c["dev"] > 5, "hin")
        .when(c["tha"] > 5, "tha")
        .when(cyrillic, "rus")
        .otherwise("eng")
    )
    total = sum((c[n] for n in SCRIPTS), F.lit(0))
    named = F.when(lang == "eng", latin_language(text)).when(lang == "rus", "rus+eng").otherwise(lang)
    own = F.when(lang == "jpn", c["kana"] + c["cjk"])
    for name, key in (("eng", "lat"), ("rus", "cyr"), ("ara", "ara"), ("heb", "heb"), ("chi_sim", "cjk"), ("kor", "han"), ("hin", "dev"), ("tha", "tha")):
        own = own.when(lang == name, c[key])
    sure = (total >= 30) & (own / F.greatest(total, F.lit(1)) > 0.5) & (F.lit(True) if confidence is None else confidence >= 55)
    short = text.isNull() | (F.length(F.trim(text)) < 10)
    return F.struct(F.when(short, "eng").otherwise(named).alias("lang"), (~short & sure).alias("confident"))


def common_word_language(docs: DataFrame, words_of: dict[str, str] | None = None) -> DataFrame:
    """doc_id, lang: the language whose own common words are 3 % of the words and twice the next one's, else eng.

    The lexicon (under 300 words) is broadcast; counting is one grouped pass.
    """
    spark = docs.sparkSession
    pairs = [(w, lang) for lang, words in (words_of or COMMON_WORDS).items() for w in sorted(set(words.split()))]
    lexicon = spark.createDataFrame(pairs, "word string, lang string").groupBy("word").agg(F.min("lang").alias("lang"), F.count("*").alias("n")).filter("n = 1 AND lang <> 'eng'").select("word", "lang")
    words = docs.select("doc_id", F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{2,})"), F.lit(1))).alias("word"))
    counted = words.join(F.broadcast(lexicon), "word", "left").groupBy("doc_id", "lang").agg(F.count("word").alias("n"))
    total = Window.partitionBy("doc_id")
    ranked = counted.withColumn("words", F.sum("n").over(total)).filter("lang IS NOT NULL OR words >= 0")
    order = Window.partitionBy("doc_id").orderBy(F.col("lang").isNull(), F.desc("n"), "lang")
    placed = ranked.withColumn("place", F.row_number().over(order))
    best = placed.groupBy("doc_id").agg(
        F.max(F.when((F.col("place") == 1) & F.col("lang").isNotNull(), F.col("lang"))).alias("first"),
        F.max(F.when((F.col("place") == 1) & F.col("lang").isNotNull(), F.col("n"))).alias("n1"),
        F.max(F.when((F.col("place") == 2) & F.col("lang").isNotNull(), F.col("n"))).alias("n2"),
        F.max("words").alias("words"),
    )
    sure = F.col("first").isNotNull() & (F.col("n1") >= 0.03 * F.col("words")) & (F.col("n1") >= 2 * F.coalesce("n2", F.lit(0)))
    return best.select("doc_id", F.when(sure, F.col("first")).otherwise("eng").alias("lang"))


def glossary_lines(lines: DataFrame) -> DataFrame:
    """term and definition of lines ``term - definition``."""
    at = F.instr("line", " - ")
    term, meaning = F.trim(F.expr("substring(line, 1, instr(line, ' - ') - 1)")), F.trim(F.expr("substring(line, instr(line, ' - ') + 3)"))
    return lines.filter(at > 0).select(term.alias("term"), meaning.alias("definition")).filter("term <> '' AND definition <> ''")


def glossary_matches(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, term, n: whole-word matches of terms of one or more words, in any case.

    Terms meet texts as word sequences of their own lengths (only the distinct lengths reach the driver) in one
    equi-join, so the dictionary may be large. Other signs between words break a sequence; white space doesn't.
    """
    token = r"([\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+)"
    split = lambda text: F.regexp_extract_all(F.lower(text), F.lit(token), F.lit(1))
    wanted = terms.select("term", split(F.col("term")).alias("tokens")).distinct().filter(F.size("tokens") > 0)
    lengths = sorted(r[0] for r in wanted.select(F.size("tokens")).distinct().collect())
    words = docs.select("doc_id", split(F.col("text")).alias("tokens"))
    found = None

    def runs(n: int) -> Column:
        starts = F.when(F.size("tokens") >= n, F.sequence(F.lit(1), F.size("tokens") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get("tokens", i + (k - 1)) for k in range(n)]))

    for n in lengths:
        own = words.select("doc_id", F.explode(runs(n)).alias("run")).groupBy("doc_id", "run").agg(F.count("*").alias("n"))
        met = own.join(wanted.filter(F.size("tokens") == n).select("term", F.concat_ws(" ", "tokens").alias("run")), "run").select("doc_id", "term", "n")
        found = met if found is None else found.unionByName(met)
    return found if found is not None else docs.select("doc_id", F.lit("").alias("term"), F.lit(0).cast("long").alias("n")).limit(0)


def uri_flags(uri: Column) -> Column:
    """(scheme, host, flags) of an address."""
    trimmed = F.trim(uri)
    scheme = F.lower(F.nullif(F.regexp_extract(trimmed, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1), F.lit("")))
    web = scheme.isin("http", "https")
    authority = F.regexp_extract(trimmed, r"^[a-zA-Z]+://([^/?#]*)", 1)
    host = F.when(web & (authority != ""), F.lower(F.regexp_extract(authority, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1)))
    flags = F.array_compact(
        F.array(
            F.when(scheme.isNull(), "no-scheme").when(scheme.isin("javascript", "vbscript"), "script-scheme").when(scheme.isin("file", "smb"), "local-file").when(scheme == "data", "data-uri").when(scheme == "http", "not-https"),
            F.when(host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | host.startswith("["), "ip-address"),
            F.when(host.rlike(r"(^|\.)xn--"), "punycode"),
            F.when(F.regexp_replace(host, r"^www\.", "").isin(*SHORTENERS), "shortener"),
            F.when(web & F.contains(authority, F.lit("@")), "credentials-in-url"),
            F.when(web & (F.coalesce(host, F.lit("")) == ""), "unparsable"),
        )
    )
    return F.struct(scheme.alias("scheme"), host.alias("host"), flags.alias("flags"))


#: Fixed value: endings below which a site's name stands one label further left.
TWO_LEVEL = r"(?i)\.(?:co|com|net|org|gov|edu|ac|or|ne|go)\.[a-z]{2}$"


def site(host: Column) -> Column:
    """The part of a host by which a person recognises the site: the last two labels, three below two-level endings."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.$", "")
    labels = F.split(plain, r"\.")
    last = lambda n: F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(n)), F.lit(n)), ".")
    return F.when(plain.rlike(TWO_LEVEL), last(3)).otherwise(last(2))


def file_risk(name: Column) -> Column:
    return F.when(name.isNull() | (name == "") | F.trim(name).rlike(RUNNABLE), "high").otherwise("medium")


def address_report(links: DataFrame) -> DataFrame:
    """One row per address: worst level and count. links has uri and level 0 to 3."""
    return links.groupBy("uri").agg(F.max("level").alias("worst"), F.count("*").alias("n"))

