"""Files and rendered pages: encryption, what a safety report may tell, blank pages, differing tiles, recognition of whole batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE_BYTES = 65536


def looks_encrypted(content: Column) -> Column:
    """Whether the first or last 64 KiB name an encryption dictionary. JVM-side, on the bytes."""
    mark = F.lit(bytearray(b"/Encrypt"))
    last = F.substring(content, F.greatest(F.octet_length(content) - EDGE_BYTES + 1, F.lit(1)), F.lit(EDGE_BYTES))
    return F.contains(last, mark) | F.contains(F.substring(content, F.lit(1), F.lit(EDGE_BYTES)), mark)


def encryption_revision(content: Column) -> Column:
    """The revision beside the first standard handler of the last 64 KiB, else of the first; null if none is in plain text."""

    def read(part: Column) -> Column:
        text = F.decode(part, "ISO-8859-1")
        at = F.regexp_instr(text, F.lit(r"/Filter\s*/Standard"))
        first = F.greatest(at - 600, F.lit(1))
        near = F.substring(text, first, at + 600 - first)
        return F.when(at > 0, F.nullif(F.regexp_extract(near, r"/R\s+(\d)(?!\s+\d+\s+R)", 1), F.lit("")).cast("int"))

    last = F.substring(content, F.greatest(F.octet_length(content) - EDGE_BYTES + 1, F.lit(1)), F.lit(EDGE_BYTES))
    return F.coalesce(read(last), read(F.substring(content, F.lit(1), F.lit(EDGE_BYTES))))


#: The only categories that may leave a report.
LEVELS = ("none", "low", "medium", "high")
KINDS = ("scripts", "programs", "files", "sending", "forms", "media", "hiding", "links", "other")
MODES = ("clean", "pictures")


def _listed(value: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(value.isin(*allowed), value).otherwise("other")


def _yes(flag: Column) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), "yes").otherwise("no")


def pages_band(n: Column) -> Column:
    return F.when(n.isNull() | (n < 1), "unknown").when(n == 1, "1").when(n <= 10, "2-10").when(n <= 50, "11-50").when(n <= 200, "51-200").otherwise(">200")


def count_band(n: Column) -> Column:
    return F.when(n.isNull() | (n < 1), "0").when(n == 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").otherwise(">20")


def report_props(level: Column, kinds: Column, qr: Column, mismatch: Column, encrypted: Column, signed: Column, failed: Column, pages: Column) -> Column:
    """What is told of a checked file: values of fixed lists only, everything else is other. kinds is an array."""
    named = F.array_sort(F.array_distinct(F.transform(F.coalesce(kinds, F.array().cast("array<string>")), lambda k: _listed(k, KINDS))))
    return F.struct(
        F.lit("safety").alias("tool"),
        _listed(level, LEVELS).alias("level"),
        F.when(F.size(named) > 0, F.array_join(named, "+")).otherwise("none").alias("kinds"),
        _yes(qr).alias("qr"),
        _yes(mismatch).alias("link_mismatch"),
        _yes(encrypted).alias("encrypted"),
        _yes(signed).alias("signed"),
        F.when(F.coalesce(failed, F.lit(False)), "partly").otherwise("yes").alias("readable"),
        pages_band(pages).alias("pages"),
    )


def result_props(mode: Column, removed: Column) -> Column:
    return F.struct(F.lit("safety").alias("tool"), _listed(mode, MODES).alias("mode"), count_band(removed).alias("removed"))


def blank(pixels: np.ndarray, edge: float = 0.03, darker: int = 40, specks: int = 3) -> bool:
    """Whether a page (height, width, 4) shows no more than a few pixels darker than its paper, edges left out.

    The paper is the brightness that nine tenths of the pixels don't exceed.
    """
    h, w = pixels.shape[:2]
    inner = pixels[int(h * edge) : int(np.ceil(h * (1 - edge))), int(w * edge) : int(np.ceil(w * (1 - edge))), :3]
    if not inner.size:
        return True
    grey = np.floor(inner @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.int64).ravel()
    counts = np.bincount(grey, minlength=256)
    paper = int(np.argmax(counts.cumsum() >= 0.9 * len(grey)))
    return int(counts[: max(0, paper - darker)].sum()) <= specks


def worst_tile(a: np.ndarray, b: np.ndarray, grid: int = 8) -> float:
    """Greatest mean difference of two equal-sized pages' tiles, every other row and sample read."""
    h, w, n = a.shape
    apart = np.abs(a.astype(np.int64) - b.astype(np.int64)).reshape(h, w * n)
    rows, columns = [k * h // grid for k in range(grid + 1)], [k * w // grid * n for k in range(grid + 1)]
    tiles = (apart[y0:y1:2, x0:x1:2] for y0, y1 in zip(rows, rows[1:]) for x0, x1 in zip(columns, columns[1:]))
    return float(max((t.mean() for t in tiles if t.size), default=0.0))


def rendered(pages: DataFrame) -> DataFrame:
    """doc_id, page, blank, worst. pages: doc_id, page, width, height, pixels (4 bytes each), other (pixels of another version of it, or null).

    worst is null without another version, and 255 if that has another size. Pages are read in Arrow batches.
    """
    schema = "doc_id long, page int, blank boolean, worst double"

    def measure(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for r in pdf.itertuples():
                shape = (r.height, r.width, 4)
                own = np.frombuffer(r.pixels, dtype=np.uint8).reshape(shape)
                worst = None
                if r.other is not None:
                    worst = worst_tile(own, np.frombuffer(r.other, dtype=np.uint8).reshape(shape)) if len(r.other) == len(r.pixels) else 255.0
                rows.append((r.doc_id, r.page, blank(own), worst))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return pages.select("doc_id", "page", "width", "height", "pixels", "other").mapInPandas(measure, schema)


def recognise(docs: DataFrame, load: Callable[[], Callable[[list[str]], list[list[dict]]]]) -> DataFrame:
    """doc_id, tokens (array of struct entity, word, score): a recogniser, loaded once per task, is given whole batches of texts.

    Null texts have no tokens. The tokens are what ``records.merge_entities`` takes.
    """
    schema = "doc_id long, tokens array<struct<entity:string,word:string,score:double>>"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in it:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": model([t or "" for t in pdf["text"]])})

    return docs.select("doc_id", "text").mapInPandas(run, schema)


def dissect(blocks: Column) -> Column:
    """(paras, tables) of a reading view's blocks (array of struct type, text, rows): headings and paragraphs; tables with their size and characters."""
    paras = F.transform(F.filter(blocks, lambda b: b["type"].isin("para", "heading")), lambda b: b["text"])

    def table(b: Column) -> Column:
        rows = F.coalesce(b["rows"], F.array().cast("array<array<string>>"))
        chars = F.aggregate(F.flatten(rows), F.lit(0), lambda a, c: a + F.coalesce(F.length(c), F.lit(0)))
        cols = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
        return F.struct(F.size(rows).alias("rows"), cols.alias("cols"), chars.alias("chars"), F.lit(False).alias("in_textbox"), F.lit(True).alias("regular"))

    return F.struct(paras.alias("paras"), F.transform(F.filter(blocks, lambda b: b["type"] == "table"), table).alias("tables"))
