"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Words are maximal runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z; shingles are five words, known
by 64-bit hashes until they are verified. A document's windows are of ``WINDOW`` = 8 shingles, every ``STEP`` = 4;
a template's are all of its windows. A window's signature is ``BANDS`` = 4 bands of ``ROWS`` = 2 MinHash values
each (the least of the window's hashes after an exclusive-or with the row's constant), so that two windows of
similarity J share a band with the chance 1 - (1 - J^2)^4: 0.83 at 0.6, 0.98 at 0.8, certainty at 1. A template
that stands unbroken in a document over at least 11 shingles has a window there that is one of its own, whatever its
place, so it is found with certainty; copies with changed words have such stretches, or several windows of high
similarity: with one word in 25 changed, where containment is about 0.8, tests find over 99 of 100. Templates of
under 11 shingles, of which single sentences consist, would share too little with a window; their windows, and
for them the document's, are single shingles, whose MinHash is the shingle's hash, so that one band is certain.

Documents that share a band with a template are then compared exactly, as strings: a match is a document that
holds at least ``least`` of the template's distinct shingles. Only DataFrame functions are used; nothing is
shuffled, and bands are looked up inside the row.

Templates of fewer than five words have their whole word sequence as their one shingle; so have documents.
Defined cases: null and empty texts match nothing; texts of any length are scanned whole; repeated rows match each;
extra columns are ignored, whatever their names; no templates or an empty table give an empty result. Templates
over ``most_bytes`` of text are refused, as every task holds the table of their bands (about 100 bytes of it for 6
bytes of text); scan these in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm.common import ascii_lower, text_or_empty
from vellumspark.llm.license_texts import TEMPLATES

WORDS, LEAST = 5, 0.8
WINDOW, STEP, BANDS, ROWS = 8, 4, 4, 2
SHORT = WINDOW + STEP - 1  # templates of fewer shingles are retrieved by single shingles
SEPARATORS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: The rows' constants, from a multiplicative rule.
ROW_MARKS = [(k * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63) for k in range(1, BANDS * ROWS + 1)]


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), SEPARATORS), lambda w: w != "")


def _starts(words: Column) -> Column:
    n = F.size(words)
    return F.when(n >= WORDS, F.sequence(F.lit(1), n - (WORDS - 1))).when(n > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))


def shingles_of(words: Column) -> Column:
    """Shingles of an array of words, repeats included."""
    return F.transform(_starts(words), lambda i: F.concat_ws(" ", *[F.get(words, i + (k - 1)) for k in range(WORDS)]))


def hashes_of(words: Column) -> Column:
    """A hash of each shingle, without building it."""
    return F.transform(_starts(words), lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(WORDS)]))


def window_bands(hashes: str, step: int) -> Column:
    """Bands of all windows of an array column of shingle hashes, at every step and at its end; an array shorter than a window is one."""
    starts = (
        f"CASE WHEN size({hashes}) > {WINDOW} THEN array_append(sequence(1, size({hashes}) - {WINDOW - 1}, {step}), size({hashes}) - {WINDOW - 1}) "
        f"WHEN size({hashes}) > 0 THEN array(1) ELSE CAST(array() AS array<int>) END"
    )

    def least(mark: int) -> str:
        # elements one by one: a slice would copy the whole array for every window; past its end there is null, which counts for nothing
        return "least(" + ", ".join(f"get({hashes}, i + {k - 1}) ^ {mark}L" for k in range(WINDOW)) + ")"

    bands = ", ".join(f"xxhash64({b}, " + ", ".join(least(ROW_MARKS[b * ROWS + r]) for r in range(ROWS)) + ")" for b in range(BANDS))
    return F.expr(f"flatten(transform({starts}, i -> array({bands})))")


def template_table(spark: SparkSession, templates: tuple[tuple[str, str, str], ...] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(list(templates), "template_id string, license string, template_text string")


def template_bands(templates: DataFrame) -> DataFrame:
    """template_id, license, shingles (distinct), short (whether single shingles retrieve it), bands."""
    words = templates.select("template_id", "license", words_of(text_or_empty(templates, "template_text")).alias("words"))
    hashed = words.select("template_id", "license", F.array_distinct(shingles_of(F.col("words"))).alias("shingles"), hashes_of(F.col("words")).alias("hashes"))
    short = F.size("hashes") < SHORT
    return hashed.select("template_id", "license", "shingles", short.alias("short"), F.array_distinct(F.when(short, F.col("hashes")).otherwise(window_bands("hashes", 1))).alias("bands"))


def scan(docs: DataFrame, templates: DataFrame, least: float = LEAST, most_bytes: int = 1 << 17) -> DataFrame:
    """One row per document and template found: doc_id, template_id, license, n_shingles, n_found, containment."""
    size = templates.agg(F.sum(F.octet_length("template_text"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"templates of {size} bytes; the table of their bands is held by every task, at most {most_bytes}")
    known = template_bands(templates)
    listed = known.select("short", "bands").collect()  # bounded by most_bytes
    wanted = {kind: sorted({b for r in listed if r["short"] == kind for b in r["bands"]}) for kind in (True, False)}
    # outer explodes: a filter on what is computed above would be pushed below it, and the words split again for every shingle
    exploded = known.select(F.explode_outer("bands").alias("band"), F.struct("template_id", "license", "shingles").alias("template")).filter("band IS NOT NULL")
    by_band = exploded.groupBy("band").agg(F.collect_list("template").alias("templates"))
    lookup = by_band.agg(F.map_from_entries(F.collect_list(F.struct("band", "templates"))).alias("lookup")).scalar()
    words = docs.select(docs["doc_id"].alias("doc_id"), words_of(text_or_empty(docs)).alias("words"))
    hashed = words.select("doc_id", "words", hashes_of(F.col("words")).alias("hashes"))

    def met(column: str, kind: bool) -> Column:
        listed = ", ".join(f"{b}L" for b in wanted[kind] if b != -(1 << 63))  # made a hash set by the optimizer
        return F.expr(f"filter({column}, b -> b IN ({listed}))") if listed else F.array().cast("array<bigint>")

    banded = hashed.select("doc_id", "words", "hashes", window_bands("hashes", STEP).alias("bands"))
    banded = banded.select("doc_id", "words", F.array_distinct(F.concat(met("hashes", True), met("bands", False))).alias("met"))
    found = banded.withColumn("lookup", lookup).select("doc_id", "words", F.array_distinct(F.flatten(F.transform("met", lambda b: F.try_element_at("lookup", b)))).alias("found"))
    candidates = found.select("doc_id", "words", F.explode_outer("found").alias("template")).filter("template IS NOT NULL")
    candidates = candidates.select("doc_id", "template", shingles_of(F.col("words")).alias("shingles"))
    counted = candidates.select(
        "doc_id",
        F.col("template.template_id").alias("template_id"),
        F.col("template.license").alias("license"),
        F.size("template.shingles").cast("long").alias("n_shingles"),
        F.size(F.array_intersect(F.col("template.shingles"), F.col("shingles"))).cast("long").alias("n_found"),
    )
    return counted.withColumn("containment", F.col("n_found") / F.col("n_shingles")).filter(F.col("containment") >= least)


def _values() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, t)) + ")" for t in TEMPLATES)


_ORACLE_WORDS = "list_filter(regexp_split_to_array(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '')"

ORACLE = f"""
WITH t(template_id, license, template_text) AS (VALUES {_values()}),
w AS (SELECT 't' AS kind, template_id AS id, license, {_ORACLE_WORDS.format("template_text")} AS w FROM t UNION ALL SELECT 'd', doc_id::VARCHAR, NULL, {_ORACLE_WORDS.format("text")} FROM documents),
x AS (SELECT kind, id, license, len(w) AS n, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
y AS (SELECT kind, id, license, n, i, concat_ws(' ', a, lead(a, 1) OVER o, lead(a, 2) OVER o, lead(a, 3) OVER o, lead(a, 4) OVER o) AS s FROM x WINDOW o AS (PARTITION BY kind, id ORDER BY i)),
z AS (SELECT DISTINCT kind, id, license, s FROM y WHERE i <= greatest(n - {WORDS - 1}, 1)),
u AS (SELECT id, license, s, count(*) OVER (PARTITION BY id) AS n FROM z WHERE kind = 't'),
c AS (SELECT z.id::BIGINT AS doc_id, u.id AS template_id, u.license, n AS n_shingles, count(*) AS n_found FROM z JOIN u USING (s) WHERE z.kind = 'd' GROUP BY ALL)
SELECT doc_id, template_id, license, n_shingles, n_found, n_found / n_shingles AS containment FROM c WHERE n_found / n_shingles >= {LEAST}
"""
