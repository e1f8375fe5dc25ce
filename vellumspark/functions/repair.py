"""Repairs of extracted text: wrong code pages, apostrophes, surrogates, direction, letter skeletons."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: Characters of code page 1252 for bytes 0xC0-0xFF, and what code page 1251 has there.
LATIN_BYTES = bytes(range(0xC0, 0x100)).decode("cp1252")
CYRILLIC_BYTES = bytes(range(0xC0, 0x100)).decode("cp1251")
MIRRORED = str.maketrans("()[]{}<>«»", ")(][}{><»«")
#: Dotless classes of Arabic letters.
RASM = {"بتثپنٮ": "ٮ", "جحخچ": "ح", "دذڈ": "د", "رزژڑ": "ر", "سش": "س", "صض": "ص", "طظ": "ط", "عغ": "ع", "فق": "ف", "كکگ": "ک", "يیىئ": "ی", "أإآا": "ا", "ةهۀ": "ه", "ؤو": "و"}


def mojibake_share(text: Column) -> Column:
    """Share of letters that look like Cyrillic read as Latin."""
    garbled = F.regexp_count(text, F.lit("[À-ÿ]"))
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters >= 20, garbled / letters).otherwise(0.0)


def repair_mojibake(docs: DataFrame) -> DataFrame:
    """text with code page 1252 read as 1251, in documents where over half of 20 letters or more are garbled."""
    return docs.withColumn("text", F.when(mojibake_share(F.col("text")) > 0.5, F.translate("text", LATIN_BYTES, CYRILLIC_BYTES)).otherwise(F.col("text")))


def repair_uzbek(docs: DataFrame) -> DataFrame:
    """``oâ`` and ``gâ`` as oʻ and gʻ, in documents with three of â or more, over three quarters of them after o or g."""
    seen, placed = F.regexp_count("text", F.lit("â")), F.regexp_count("text", F.lit("[oOgG]â"))
    return docs.withColumn("text", F.when((seen >= 3) & (placed > 0.75 * seen), F.regexp_replace("text", "([oOgG])â", "$1ʻ")).otherwise(F.col("text")))


def rasm(text: Column) -> Column:
    """Arabic letters without marks and dots, by classes."""
    bare = F.regexp_replace(text, r"[\x{064B}-\x{065F}\x{0670}\x{0640}]", "")
    return F.translate(bare, "".join(RASM), "".join(v * len(k) for k, v in RASM.items()))


def _logical(line: str) -> str:
    kinds = ["N" if c.isdigit() else {"R": "R", "AL": "R", "L": "L"}.get(unicodedata.bidirectional(c), "-") for c in line]
    if "R" not in kinds:
        return line
    runs = [m.group() for m in re.finditer(r"[NL](?:[NL-]*[NL])?|[^NL]+", "".join(kinds))]
    out, end = [], len(line)
    for run in reversed(runs):
        part = line[end - len(run) : end]
        out.append(part if run[0] in "NL" else part[::-1].translate(MIRRORED))
        end -= len(run)
    return "".join(out)


@F.pandas_udf(StringType())
def visual_to_logical(text: pd.Series) -> pd.Series:
    """Lines written in visual order in reading order: runs are taken from the right, right-to-left runs reversed."""
    return text.map(lambda t: None if t is None else "\n".join(map(_logical, t.split("\n"))))


_PAIR = re.compile(rb"\xed[\xa0-\xaf][\x80-\xbf]\xed[\xb0-\xbf][\x80-\xbf]")


def _join_surrogates(m: re.Match) -> bytes:
    return m.group().decode("utf-8", "surrogatepass").encode("utf-16-le", "surrogatepass").decode("utf-16-le").encode()


@F.pandas_udf(BinaryType())
def join_surrogates(content: pd.Series) -> pd.Series:
    """Pairs of surrogates written as two characters of three bytes, as one of four."""
    return content.map(lambda b: None if b is None else _PAIR.sub(_join_surrogates, bytes(b)))
