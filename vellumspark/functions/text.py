"""Scalar text operators: cleaning, markers, numbering, ranges, cells, tokens."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
BULLETS = "•◦▪‣●○"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def fold_diacritics(text: pd.Series) -> pd.Series:
    """Without combining marks U+0300-036F; letters that don't decompose are mapped."""
    table = {ord("ı"): "i", ord("đ"): "d", ord("ł"): "l", ord("ß"): "ss"} | {c: None for c in range(0x300, 0x370)}
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFD", t).translate(table))


@F.pandas_udf(StringType())
def arabic_letters(text: pd.Series) -> pd.Series:
    """Presentation forms as plain letters; other compatibility characters stay."""
    forms = lambda c: unicodedata.normalize("NFKC", c) if "ﭐ" <= c <= "﷿" or "ﹰ" <= c <= "﻾" else c
    return text.map(lambda t: None if t is None else "".join(map(forms, t)))


def watermark_text(text: Column) -> Column:
    """A line in the form in which repeated watermarks are compared."""
    visible = F.regexp_replace(nfkc(text), r"[\x{00AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]", "")
    packed = F.trim(F.regexp_replace(visible, SPACE + "+", " "))
    return F.when(packed == "-", "").otherwise(packed)


def mask_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "#")


def join_cjk(text: Column) -> Column:
    """Without spaces between two CJK characters."""
    return F.regexp_replace(text, f"(?<=[{CJK}]){SPACE}+(?=[{CJK}])", "")


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}]", "")


def private_share(text: Column) -> Column:
    """Share of private-use characters among those that aren't spaces."""
    dense = F.regexp_replace(text, SPACE, "")
    return F.when(F.length(dense) == 0, 0.0).otherwise(F.regexp_count(dense, F.lit(r"[\x{E000}-\x{F8FF}]")) / F.length(dense))


def marker(line: Column) -> Column:
    """bullet, numbered, lettered or none."""
    return (
        F.when(line.rlike(f"^[{BULLETS}]{SPACE}*[^\\s{BULLETS}]"), "bullet").when(line.rlike(r"^[0-9]{1,3}[.)](?![0-9])"), "numbered").when(line.rlike(r"^[a-zA-Z][.)](?![A-Za-z0-9_])"), "lettered").otherwise("none")
    )


def has_money(line: Column) -> Column:
    return line.rlike(r"[0-9]{1,3}(?:,[0-9]{3})+\.[0-9]{2}(?![A-Za-z0-9_])")


def is_contents_entry(line: Column) -> Column:
    """Leader dots and a page number at the edge."""
    return line.rlike(r"\.{4,}\s*[0-9]{1,4}\s*$")


def ends_sentence(line: Column) -> Column:
    return F.rtrim(line).rlike("[.!?…。！？؟]$")


def numbered_section(line: Column) -> Column:
    return line.rlike(r"^[0-9]{1,2}(\.[0-9]{1,2}){1,4}\.?\s+\S") & (F.length(line) <= 120)


def hyphen_join(line: Column, following: Column) -> Column:
    """A line with the start of the next where a word was divided; the hyphen stays after capitals."""
    stem, cont = F.regexp_extract(line, r"([A-Za-z]{2,})-$", 1), F.regexp_extract(following, r"^([a-z]+)", 1)
    divided = (stem != "") & (cont != "")
    keep = stem == F.upper(stem)
    return F.when(divided & keep, F.concat(line, cont)).when(divided, F.concat(F.regexp_replace(line, "-$", ""), cont)).otherwise(line)


def roman(n: Column) -> Column:
    """Roman numerals for 1 to 3999, plain digits otherwise."""
    state = F.struct(n.cast("int").alias("n"), F.lit("").alias("s"))
    steps = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in ROMAN])
    done = F.aggregate(steps, state, lambda a, x: F.struct((a["n"] % x["v"]).alias("n"), F.concat(a["s"], F.repeat(x["s"], F.floor(a["n"] / x["v"]).cast("int"))).alias("s")))
    return F.when((n >= 1) & (n <= 3999), done["s"]).otherwise(n.cast("string"))


def alphabetic(n: Column) -> Column:
    """1 is A, 26 Z, 27 AA: bijective base 26; below 1 plain digits."""
    state = F.struct(n.cast("long").alias("n"), F.lit("").alias("s"))
    letter = lambda k: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), k + 1, F.lit(1))
    step = lambda a, _: F.when(a["n"] > 0, F.struct(F.floor((a["n"] - 1) / 26).cast("long").alias("n"), F.concat(letter(((a["n"] - 1) % 26).cast("int")), a["s"]).alias("s"))).otherwise(a)
    return F.when(n >= 1, F.aggregate(F.sequence(F.lit(1), F.lit(8)), state, step)["s"]).otherwise(n.cast("string"))


def column_name(index: Column) -> Column:
    """Spreadsheet column of a zero-based index."""
    return alphabetic(index + 1)


def safe_filename(name: Column, number: Column) -> Column:
    clean = F.trim(F.regexp_replace(name, r"[\x{00}-\x{1F}<>:\"/\\|?*]", "_"))
    return F.concat(number.cast("string"), F.lit(" - "), F.substring(clean, 1, 60))


def substitute(text: Column, fields: Column) -> Column:
    """text with ranges replaced; fields is an array of (start, end, value), zero-based, end exclusive, replaced from the right."""
    ordered = F.array_sort(fields, lambda a, b: b["start"] - a["start"])
    put = lambda s, f: F.concat(F.substring(s, F.lit(1), f["start"]), f["value"], F.substring(s, f["end"] + 1, F.length(s)))
    return F.aggregate(ordered, text, put)


def page_range(spec: Column, last: Column) -> Column:
    """Sorted distinct pages of a range such as ``1-3, 5``, held within 1 and last; odd parts are dropped."""
    plain = F.translate(spec, "、;，；－‐‑‒–—−~～至到０１２３４５６７８９", ",,,,-----------0123456789")
    parts = F.filter(F.split(F.regexp_replace(plain, SPACE, ""), ","), lambda p: p.rlike(r"^[0-9]{1,6}(-[0-9]{1,6})?$"))

    def pages(p: Column) -> Column:
        a, b = F.split_part(p, F.lit("-"), F.lit(1)).cast("int"), F.when(F.contains(p, F.lit("-")), F.split_part(p, F.lit("-"), F.lit(2))).otherwise(p).cast("int")
        low, high = F.greatest(F.least(a, b), F.lit(1)), F.least(F.greatest(a, b), last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages))))


def range_text(pages: Column) -> Column:
    """``[1, 2, 3, 5]`` as ``1-3, 5``, for sorted distinct numbers."""
    runs = F.aggregate(
        pages,
        F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, p: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] == p - 1),
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["a"].alias("a"), p.cast("int").alias("b")))),
        ).otherwise(F.concat(acc, F.array(F.struct(p.cast("int").alias("a"), p.cast("int").alias("b"))))),
    )
    return F.array_join(F.transform(runs, lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat_ws("-", r["a"].cast("string"), r["b"].cast("string")))), ", ")


def fold_digits(text: Column) -> Column:
    return F.translate(text, ARABIC_DIGITS, "01234567890123456789")


def cell_value(text: Column, decimal_mark: str = ".") -> Column:
    """A table cell as (kind, num, date, text): number, percent (a fraction), ISO date or text.

    Grouped numbers need groups of three; identifiers with leading zeros, over 15 digits or mixed grouping stay text.
    """
    raw = F.trim(fold_digits(text))
    group = "," if decimal_mark == "." else "."
    bare = F.regexp_replace(F.translate(raw, "−", "-"), r"^([+-]?)[$€£¥]\s*|\s*[$€£¥]$", "$1")
    percent = bare.rlike("%$")
    body = F.trim(F.regexp_replace(bare, "%$", ""))
    grouped = body.rlike(rf"^[+-]?[0-9]{{1,3}}([{group}][0-9]{{3}})+([{decimal_mark}][0-9]+)?$")
    simple = body.rlike(rf"^[+-]?(0|[1-9][0-9]*)?([{decimal_mark}][0-9]+)?$") & body.rlike("[0-9]")
    digits = F.length(F.regexp_replace(body, "[^0-9]", ""))
    is_number = (grouped | simple) & (digits <= 15)
    number = F.translate(F.replace(body, F.lit(group), F.lit("")), decimal_mark, ".").try_cast("double")
    date = F.when(raw.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(raw, "yyyy-MM-dd"))
    date = F.when(date >= F.lit("1900-01-01").cast("date"), date)
    kind = F.when(is_number & percent, "percent").when(is_number, "number").when(date.isNotNull(), "date").otherwise("text")
    return F.struct(kind.alias("kind"), F.when(is_number, F.when(percent, number / 100).otherwise(number)).alias("num"), date.alias("date"), text.alias("text"))


def word_count(text: Column) -> Column:
    """Words parted by spaces, and half the CJK characters, rounded up."""
    latin = F.filter(F.split(F.regexp_replace(text, f"[{CJK}]", " "), SPACE + "+"), lambda w: w != "")
    return F.size(latin) + F.ceil(F.regexp_count(text, F.lit(f"[{CJK}]")) / 2).cast("int")


def mixed_tokens(text: Column) -> Column:
    """One CJK character, two or more letters, or a run of digits; of NFKC text in lower case."""
    return F.regexp_extract_all(F.lower(nfkc(text)), F.lit(rf"([{CJK}]|[\p{{L}}&&[^{CJK}]]{{2,}}|[0-9]+)"), F.lit(1))


def latin_words(text: Column) -> Column:
    """Words of letters, after NFKC; soft hyphens are dropped and words divided by hyphen and space joined."""
    whole = F.regexp_replace(F.replace(nfkc(text), F.lit("­"), F.lit("")), r"(?<=\p{L})-\s+(?=\p{L})", "")
    return F.regexp_extract_all(F.lower(whole), F.lit(r"([\p{L}]+)"), F.lit(1))


def number_runs(text: Column, least: int = 2) -> Column:
    return F.regexp_extract_all(text, F.lit(f"([0-9]{{{least},}})"), F.lit(1))


def file_size(size: Column) -> Column:
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(F.format_string("%.1f", size / 1024), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", size / 1048576), F.lit(" MB")))
    )


def shorten_middle(name: Column, most: int) -> Column:
    """At most so many characters, with an ellipsis in the middle."""
    head = (most - 1 + 1) // 2
    return F.when(F.length(name) <= most, name).otherwise(F.concat(F.left(name, F.lit(head)), F.lit("…"), F.right(name, F.lit(most - 1 - head))))


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def looks_broken(text: Column) -> Column:
    """At least 200 characters that aren't spaces, 5 % of them control characters."""
    dense = F.length(F.regexp_replace(text, SPACE, ""))
    controls = F.regexp_count(text, F.lit(r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{FFFD}]"))
    return (dense >= 200) & (controls >= 0.05 * dense)


def wants_ocr(letters: Column, controls: Column, cover: Column, broken: Column) -> Column:
    return broken | (((letters <= 20) | (controls >= letters)) & (cover >= 0.5))
