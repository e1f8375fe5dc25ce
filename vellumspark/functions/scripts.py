"""Writing systems: radicals, words of scripts without spaces, the stored order of right-to-left text, mixed scripts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vellumspark.functions.text import SPACE

#: Radicals of the supplement that have no compatibility mapping, and the ideographs they stand for.
SUPPLEMENT = {
    "⺟": "母", "⺠": "民", "⻁": "虎", "⻄": "西", "⻅": "见", "⻆": "角", "⻉": "贝", "⻋": "车",
    "⻑": "長", "⻓": "长", "⻔": "门", "⻘": "青", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻢": "马",
    "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻨": "麦", "⻩": "黄", "⻬": "齐", "⻮": "齿",
    "⻰": "龙", "⻳": "龟",
}

#: Scripts told apart; the four of Chinese and Japanese count as one.
SCRIPTS = (
    "Latin Arabic Hebrew Cyrillic Greek Han Hiragana Katakana Bopomofo "
    "Hangul Devanagari Thai Malayalam Kannada Tamil Telugu Bengali Gujarati Gurmukhi "
    "Oriya Armenian Georgian Ethiopic Sinhala Myanmar Khmer Lao Tibetan Syriac Thaana "
    "Mongolian Cherokee Canadian_Aboriginal Runic Ogham Yi Tifinagh Vai Javanese Balinese "
    "Sundanese Coptic Glagolitic Samaritan Mandaic Bamum Lisu"
).split()
CHINESE_JAPANESE = ("Han", "Hiragana", "Katakana", "Bopomofo")

WIDE = r"[\x{3000}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"


def _radicals() -> dict[str, str]:
    """Every radical from U+2E80 to U+2FD5 that has an ideograph, with it."""
    plain = {c: unicodedata.normalize("NFKC", c) for c in map(chr, range(0x2E80, 0x2FD6))}
    return {c: u for c, u in (plain | SUPPLEMENT).items() if u != c and len(u) == 1}


def unified_ideographs(text: Column) -> Column:
    """Radicals as the ideographs they look like: one character map, built from Unicode's own."""
    table = _radicals()
    return F.translate(text, "".join(table), "".join(table.values()))


def joins_without_space(a: Column, b: Column) -> Column:
    """Whether both sides of a seam are Chinese, Japanese or full-width."""
    return F.right(a, F.lit(1)).rlike(WIDE) & F.left(b, F.lit(1)).rlike(WIDE)


def join_words(words: Column) -> Column:
    """Words (an array) as text, with a space wherever one side of a seam is neither Chinese, Japanese nor full-width. Nulls are left out."""
    kept = F.filter(words, lambda w: w.isNotNull() & (w != ""))
    # each word meets the one before it in a shifted array: kept named inside the lambda would be made anew for every word
    before = F.concat(F.array(F.lit(None).cast("string")), kept)
    pieces = F.zip_with(before, kept, lambda b, w: F.when(b.isNull() | joins_without_space(b, w), w).otherwise(F.concat(F.lit(" "), w)))
    return F.array_join(pieces, "")  # the last word before nothing gives null, which is left out


def _class(names: tuple[str, ...] | list[str]) -> str:
    return "[" + "".join(rf"\p{{Is{n}}}" for n in names) + r"&&\p{L}]"


def script_switches(text: Column) -> Column:
    """(pairs, switches): neighbouring letters of known scripts, and those of two scripts. Latin beside Chinese or Japanese is no switch."""
    groups = [_class(CHINESE_JAPANESE)] + [_class([s]) for s in SCRIPTS if s not in CHINESE_JAPANESE]
    known, latin, wide = _class(SCRIPTS), _class(["Latin"]), _class(CHINESE_JAPANESE)
    same = "|".join(f"{g}(?={g})" for g in groups)
    beside = f"{latin}(?={wide})|{wide}(?={latin})"
    pairs = F.regexp_count(text, F.lit(f"{known}(?={known})"))
    return F.struct(pairs.alias("pairs"), (pairs - F.regexp_count(text, F.lit(f"{same}|{beside}"))).alias("switches"))


def layer_looks_broken(text: Column) -> Column:
    """Of 200 characters or more that aren't spaces, 5 % are control characters, or 6 % of neighbouring letters change script."""
    dense = F.length(F.regexp_replace(text, SPACE, ""))
    controls = F.regexp_count(text, F.lit(r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{FFFD}]"))
    met = script_switches(text)
    mixed = (met["pairs"] > 0) & (met["switches"] >= 0.06 * met["pairs"])
    return (dense >= 200) & ((controls >= 0.05 * dense) | mixed)


_FINALS = set("ךםןףץةى")  # letters that only end a word
_ARABIC = re.compile("[؀-ۿﭐ-﷿ﹰ-ﻼ]{2,}")
_RUNS = re.compile("[֐-׿؀-ۿ]{3,}")
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def _shape(c: str) -> str:
    """initial, medial, final or isolated for the form of one Arabic letter, else nothing."""
    if not ("ﭐ" <= c <= "ﯿ" or "ﹰ" <= c <= "ﻼ"):
        return ""
    kind, *letters = unicodedata.decomposition(c).split() or ("",)
    return kind.strip("<>") if len(letters) == 1 and "0600" <= letters[0] <= "06FF" else ""


def _shapes_order(word: str) -> int:
    """1 if the word's forms join as stored, -1 if they join only in reverse, 0 if they don't say."""
    shapes = list(map(_shape, word))
    met = [(a, b) for a, b in zip(shapes, shapes[1:]) if a and b]
    if met:
        opens, closes = ("initial", "medial"), ("medial", "final")
        stored = all((a in opens) == (b in closes) for a, b in met)
        turned = all((b in opens) == (a in closes) for a, b in met)
        return stored - turned
    ligatures = "ﻶﻸﻺﻼ"  # final lam-alefs
    return (word[-1] in ligatures) - (word[0] in ligatures)


def order_votes(text: str | None) -> tuple[int, int]:
    """(logical, visual): words that read as stored, and words that read backwards."""
    logical = visual = 0
    for token in (text or "").split():
        word = _EDGES.sub("", token)
        order = _shapes_order(word) if _ARABIC.fullmatch(word) else 0
        if order:
            logical, visual = logical + (order > 0), visual + (order < 0)
            continue
        for run in _RUNS.findall(unicodedata.normalize("NFKC", token)):
            logical += run[-1] in _FINALS or run.startswith("ال")
            visual += run[0] in _FINALS or (len(run) >= 5 and run.endswith("لا"))
    return logical, visual


@F.pandas_udf(StructType([StructField("logical", LongType()), StructField("visual", LongType())]))
def rtl_votes(text: pd.Series) -> pd.DataFrame:
    """Votes of each text for its order, in Arrow batches. Null has none."""
    return pd.DataFrame([order_votes(t) for t in text], columns=["logical", "visual"])


def is_visual(logical: Column, visual: Column) -> Column:
    """Whether added-up votes show that text is stored as it is seen: three, and more than twice the others."""
    return (visual >= 3) & (visual > 2 * logical)
