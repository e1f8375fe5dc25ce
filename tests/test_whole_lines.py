import hashlib
import random
import time

from pyspark.sql import functions as F

from vellumspark.operators import layout
from vellumspark.plans import details, pages

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def stored(spark, folder, rows):
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_lines_keep_their_tails(spark, tmp_path):
    d = stored(spark, tmp_path, [(i, "word " * 1000 + tail) for i, tail in enumerate(("one", "two"))])
    assert len({r.text_md5 for r in pages.l01(spark, d).collect()}) == 2


def test_column_gaps_see_all_words(spark, tmp_path):
    d = stored(spark, tmp_path, [(1, " ".join(["a"] * 19 + ["b" * 8] * 19)), (2, "c" * 152 + "\na a a"), (3, "a  a")])
    got = {r.doc_id: (r.from_bin, r.bins) for r in pages.l10(spark, d).collect()}
    assert got.pop(3) == (1, 4)
    assert all(bins <= 1 for _, bins in got.values()), got  # a bin may be missed where an edge is rounded


ITEMS = "doc_id long, page int, seq int, x double, y double, width double, size double, text string"


def naive_lines(rows, tolerance=6.0):
    """Line by line and item by item; among equal places the lesser seq is first."""
    found = []
    for key in sorted({r[:2] for r in rows}):
        heads, members = [], []
        for r in sorted((r for r in rows if r[:2] == key), key=lambda r: (-r[4], r[3], r[2])):
            k = next((k for k, h in enumerate(heads) if abs(h - r[4]) <= tolerance), len(heads))
            if k == len(heads):
                heads.append(r[4])
                members.append([])
            members[k].append(r)
        for k, own in enumerate(members):
            own = sorted(own, key=lambda r: r[3])
            out, end = "", None
            for _, _, _, x, _, width, size, text in own:
                if end is not None and x - end > 0.15 * size and not out.endswith(" "):
                    out += " "
                out, end = out + text, x + width
            found.append((*key, k, own[0][4], own[0][3], max(r[6] for r in own), out))
    return found


def test_lines_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(12), rng.randrange(3), i, rng.randrange(9) * 10.0, rng.randrange(40) * 1.0, rng.choice([5.0, 10.0, 12.0]), rng.choice([8.0, 10.0]), rng.choice(["", "", " ", "a", "b ", " c", "文字"])) for i in range(3000)]
    got = layout.lines(spark.createDataFrame(rows, ITEMS).repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(naive_lines(rows))


def test_lines_of_many_heights_in_linear_time(spark):
    n = F.col("id")
    items = spark.range(25_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("page"), n.cast("int").alias("seq"), F.lit(0.0).alias("x"), (n * 10.0).alias("y"), F.lit(5.0).alias("width"), F.lit(10.0).alias("size"), n.cast("string").alias("text"))
    began = time.monotonic()
    got = {r.line: r.text for r in layout.lines(items).collect()}
    assert len(got) == 25_000 and got[0] == "24999" and got[24_999] == "0"
    assert time.monotonic() - began < 12


def test_lines_meet_page_by_page(spark, tmp_path):
    """Pages of forty lines, empty ones counted, of texts of one id together, as from items made row by row."""
    texts = ["\n".join(f"w{i}  x" if i % 7 else "" for i in range(95)), "one two\n", "", "\n" * 45 + "tail", "a\n" * 40, "b\rc\u0085d e \n f", "\n".join("z" * 80)]
    d = stored(spark, tmp_path, [(i % 6, t) for i, t in enumerate(texts)])
    rows, want = [], []
    for i, t in enumerate(texts):
        for n, line in enumerate(t.split("\n")):
            rows += [(i % 6, n // 40, s, s * 30.0, 800.0 - n % 40 * 15, len(w) * 3.0, 10.0, w) for s, w in enumerate(line.split(" "))] if line else []
    want = sorted(r[:3] for r in naive_lines(rows))
    got = [(r.doc_id, r.page, r.line, r.text_md5) for r in pages.l01(spark, d).collect()]
    assert sorted(r[:3] for r in got) == want
    texts_ = {r[:3]: hashlib.md5(r[6].encode()).hexdigest() for r in naive_lines(rows)}
    assert all(texts_[r[:3]] == r[3] for r in got if r[0] != 0)  # texts of id 0 share places, whose order is open


def test_token_of_each_row(spark, tmp_path):
    d = stored(spark, tmp_path, [(1, "one two three"), (1, "other words"), (2, "x")])
    spark.createDataFrame([(None, "no id here", "en", "s", 10), (3, None, "en", "s", 0)], DOCS).write.mode("append").parquet(f"{d}/documents.parquet")
    got = [(r.doc_id, r.at, r.token) for r in details.d06(spark, d).collect()]
    assert sorted(got, key=repr) == sorted([(1, 7, "two"), (1, 7, "words"), (2, 7, "x"), (None, 7, "here"), (3, 7, None)], key=repr)
