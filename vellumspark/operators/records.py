"""Smaller record operators: routes, boxes, links, entities, copies, outlines, alignment, tables from items."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.operators.detect import site
from vellumspark.session import cut


def redirects(guesses: DataFrame, manual: DataFrame) -> DataFrame:
    """source, target: manual rows win, then the guess of the best priority; targets of themselves go. guesses: source, target, priority."""
    best = guesses.groupBy("source").agg(F.min(F.struct("priority", "target")).alias("b")).select("source", F.col("b.target").alias("target"))
    own = best.join(manual.select("source"), "source", "left_anti").unionByName(manual.select("source", "target"))
    return own.filter("source <> target")


def cache_class(path: Column, status: Column) -> Column:
    """How long an answer may be kept."""
    asset = path.rlike(r"\.(js|css|woff2?|png|svg|wasm)$") & path.rlike(r"[.-][0-9a-f]{8,}\.")
    return F.when(status >= 500, "no-store").when(status.isin(301, 308), "day").when(status >= 400, "no-store").when(asset, "immutable").when(path.rlike(r"\.(js|css|woff2?|png|svg|wasm)$"), "hour").otherwise("revalidate")


def decimal_mark(cells: DataFrame) -> DataFrame:
    """Per table the mark that most unambiguous cells use, null if none or as many. cells: table_id, row, text; row 0 is the header."""
    body = cells.filter("row > 0")
    dot, comma = F.count_if(F.col("text").rlike(r"^-?[0-9]{1,3}(,[0-9]{3})*\.([0-9]{1,2}|[0-9]{4,})$")), F.count_if(F.col("text").rlike(r"^-?[0-9]{1,3}(\.[0-9]{3})*,([0-9]{1,2}|[0-9]{4,})$"))
    counted = body.groupBy("table_id").agg(dot.alias("dots"), comma.alias("commas"))
    return counted.select("table_id", F.when(F.col("dots") > F.col("commas"), ".").when(F.col("commas") > F.col("dots"), ",").alias("mark"))


def bounding(boxes: DataFrame, *keys: str) -> DataFrame:
    """The least box around all boxes of a group."""
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def under_rectangles(items: DataFrame, rects: DataFrame, slack_x: float = 1.0, slack_y: float = 2.0) -> DataFrame:
    """Items whose centre lies in a rectangle of their page. items: page, x, y, width, text; rects: page, rect, x0, y0, x1, y1."""
    own = rects.select(F.col("page").alias("_page"), "rect", "x0", "y0", "x1", "y1")
    inside = (F.col("page") == F.col("_page")) & (F.col("x") + F.col("width") / 2).between(F.col("x0") - slack_x, F.col("x1") + slack_x) & F.col("y").between(F.col("y0") - slack_y, F.col("y1") + slack_y)
    return items.join(own, inside).select("rect", "page", "x", "text")


#: Domain endings common enough to read "name.ending" as a site.
COMMON_ENDINGS = (
    "com org net gov edu mil int info biz io co app dev me us "
    "uk de fr it es nl pl ru ua uz kz tr cn jp kr in br au ca sa ae eg ir pk"
)


def link_mismatch(shown: Column, host: Column) -> Column:
    """Whether a link's text names another site than its target; texts that are cut off say nothing."""
    named = F.lower(F.regexp_extract(shown, r"(?i)(?:https?://)?(?:www\.)?((?:[a-z0-9-]+\.)+(?:" + COMMON_ENDINGS.replace(" ", "|") + r"))(?![a-z0-9.…-])", 1))
    return (named != "") & (site(named) != site(host)) & ~F.rtrim(shown).rlike(r"(…|\.\.\.)$")


def merge_entities(tokens: Column, least: float = 0.5) -> Column:
    """Entities of BIO tokens (entity, word, score): ``##`` pieces are glued, I- of the same kind joined, persons and places kept."""
    state = F.array().cast("array<struct<kind:string,text:string,score:double,n:int>>")

    def step(acc: Column, t: Column) -> Column:
        kind, mark = F.substring(t["entity"], 3, 10), F.substring(t["entity"], 1, 1)
        last = F.try_element_at(acc, F.lit(-1))
        piece, goes_on = t["word"].startswith("##"), (mark == "I") & (last["kind"] == kind)
        word = F.when(piece, F.substring(t["word"], 3, 1000)).otherwise(t["word"])
        joined = F.struct(last["kind"].alias("kind"), F.concat(last["text"], F.when(piece, "").otherwise(" "), word).alias("text"), (last["score"] + t["score"]).alias("score"), (last["n"] + 1).alias("n"))
        fresh = F.struct(kind.alias("kind"), word.alias("text"), t["score"].cast("double").alias("score"), F.lit(1).alias("n"))
        add = (F.size(acc) > 0) & (goes_on | piece)
        return F.when(add, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(fresh)))

    merged = F.aggregate(F.filter(tokens, lambda t: t["entity"] != "O"), state, step)
    kept = F.filter(merged, lambda e: e["kind"].isin("PER", "LOC") & (e["score"] / e["n"] >= least))
    return F.transform(kept, lambda e: F.struct(e["kind"].alias("kind"), e["text"].alias("text")))


def suspicious_reading(confidence: Column, text: Column, word_confidences: Column) -> Column:
    """Whether recognised text should not be trusted: unsure throughout, unsure in part, or hardly any letters among its digits.

    word_confidences holds the confidences of the words that are not blank.
    """
    words, weak = F.size(word_confidences), F.size(F.filter(word_confidences, lambda c: c < 40))
    letters, digits = F.regexp_count(text, F.lit("[a-zA-Z]")), F.regexp_count(text, F.lit("[0-9]"))
    in_part = (confidence < 80) & (words >= 20) & (weak >= 0.15 * words)
    return (confidence < 60) | in_part | ((letters + digits > 5) & (letters < 0.25 * (letters + digits)))


def copies(recipients: DataFrame, lines: DataFrame, room: float, char_width: float = 5.0, least: float = 0.85) -> DataFrame:
    """Each recipient with each template line: its text and the scale that fits it into the room, null below the least.

    A template is a page of lines; it is broadcast. lines: line, before, after.
    """
    both = recipients.join(F.broadcast(lines))
    text = F.concat("before", "name", "after")
    fixed, flexible = F.length(F.concat("before", "after")) * char_width, F.length("name") * char_width
    scale = F.least(F.lit(1.0), (room - fixed) / F.greatest(flexible, F.lit(1.0)))
    return both.select("recipient", "line", text.alias("text"), F.when(scale >= least, F.round(scale, 6)).alias("scale"))


def surviving_outline(entries: DataFrame, kept_pages: DataFrame) -> DataFrame:
    """Outline entries (doc, entry, parent, page) on kept pages, with the entries above them: a round per level, each written once.

    It ends when a round finds no entry that is not yet there, so entries that are their own ancestors do no harm.
    """
    tree = cut(entries.select("doc", "entry", "parent").distinct())
    found = cut(entries.join(kept_pages, ["doc", "page"], "left_semi").select("doc", "entry", "parent").distinct())
    alive = found
    while not found.isEmpty():
        above = found.select("doc", F.col("parent").alias("entry")).filter("entry IS NOT NULL").distinct()
        found = cut(tree.join(above, ["doc", "entry"], "left_semi").join(alive.select("doc", "entry"), ["doc", "entry"], "left_anti"))
        alive = cut(alive.unionByName(found))
    return alive.select("doc", "entry").distinct()


def common_length(x: list, y: list) -> int:
    """Length of the longest common subsequence, a row of the table at a time in the bits of a number."""
    masks: dict = {}
    for i, item in enumerate(x):
        masks[item] = masks.get(item, 0) | 1 << i
    every = (1 << len(x)) - 1
    row = every
    for item in y:
        met = row & masks.get(item, 0)
        row = ((row + met) | (row - met)) & every
    return len(x) - row.bit_count()


def aligned_lines(truth: DataFrame, output: DataFrame) -> DataFrame:
    """doc_id, matched, truth_lines, output_lines: longest common subsequence of two documents' lines (arrays; several rows of a document are one after another), one document at a time."""

    def match(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x = [line for lines in a["lines"] for line in lines]
        y = [line for lines in b["lines"] for line in lines]
        return pd.DataFrame({"doc_id": [key[0]], "matched": [common_length(x, y)], "truth_lines": [len(x)], "output_lines": [len(y)]})

    return truth.groupBy("doc_id").cogroup(output.groupBy("doc_id")).applyInPandas(match, "doc_id long, matched long, truth_lines long, output_lines long")


def column_switches(markers: DataFrame) -> DataFrame:
    """How often neighbouring markers of a document change column. markers: doc_id, pos, column_no."""
    before = F.lag("column_no").over(Window.partitionBy("doc_id").orderBy("pos"))
    return markers.withColumn("before", before).groupBy("doc_id").agg(F.count_if(F.col("before") != F.col("column_no")).alias("switches"))


def language_tag(text: Column) -> Column:
    """ja above 5 % kana among CJK letters, suspect above 20 % signs that are no letters, else zh or other."""
    kana, han = F.regexp_count(text, F.lit("[぀-ヿ]")), F.regexp_count(text, F.lit("[一-鿿]"))
    junk = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\p{P}\s]"))
    return F.when(kana > 0.05 * (kana + han), "ja").when(junk > 0.2 * F.length(text), "suspect").when(han > 0, "zh").otherwise("other")


_NAME = re.compile(rb"/((?:[^\x00-\x20()<>\[\]{}/%#]|#[0-9a-fA-F]{2})+)")
#: Names that tell of active content.
WATCHED = (
    "JS", "JavaScript", "AA", "OpenAction", "Launch", "EmbeddedFile", "EmbeddedFiles",
    "RichMedia", "XFA", "AcroForm", "URI", "SubmitForm", "ImportData", "GoToR", "GoToE",
    "JBIG2Decode", "ObjStm", "Encrypt", "ByteRange",
)


def pdf_names(content: bytes) -> dict[str, int]:
    """Counts of watched names outside streams, with #xx escapes read, and of end marks."""
    outside = re.sub(rb"stream\r?\n.*?endstream", b"", content, flags=re.S)
    found = dict.fromkeys(WATCHED, 0)
    for m in _NAME.finditer(outside):
        name = re.sub(rb"#([0-9a-fA-F]{2})", lambda x: bytes([int(x.group(1), 16)]), m.group(1)).decode("latin-1")
        if name in found:
            found[name] += 1
    return found | {"%%EOF": outside.count(b"%%EOF")}


def scan_names(files: DataFrame) -> DataFrame:
    """path, counts of every binary file."""
    schema = "path string, counts map<string,int>"
    return files.select("path", "content").mapInPandas(lambda it: (pd.DataFrame({"path": b["path"], "counts": [pdf_names(bytes(c)) for c in b["content"]]}) for b in it), schema)


def detect_tables(lines: DataFrame, tolerance: float = 25.0) -> DataFrame:
    """Runs of three lines or more that share two column starts or more. lines: doc_id, page, line, cells (array of struct x, text).

    Returns doc_id, page, first_line, last_line, cols, align. Whole pages stay in one group, as the rule is greedy.
    """

    def find(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, run, starts = [], [], []

        def close() -> None:
            if len(run) >= 3 and len(starts) >= 2:
                hits = [sum(any(abs(c["x"] - s) <= tolerance for c in cells) for s in starts) for _, cells in run]
                align = sum(h >= 0.6 * len(starts) for h in hits) / len(run)
                if align >= 0.8:
                    out.append((key[0], key[1], run[0][0], run[-1][0], len(starts), round(align, 6)))

        for row in pdf.sort_values("line").itertuples():
            cells = list(row.cells)
            xs = [c["x"] for c in cells]
            shared = sum(any(abs(x - s) <= tolerance for x in xs) for s in starts)
            if len(cells) >= 2 and (not run or shared >= 2):
                if not run:
                    starts = xs
                run.append((row.line, cells))
            else:
                close()
                run, starts = ([(row.line, cells)], xs) if len(cells) >= 2 else ([], [])
        close()
        return pd.DataFrame(out, columns=["doc_id", "page", "first_line", "last_line", "cols", "align"])

    return lines.groupBy("doc_id", "page").applyInPandas(find, "doc_id long, page int, first_line int, last_line int, cols int, align double")
