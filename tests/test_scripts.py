"""Writing systems, runs of items, files: small cases and brute force."""

import random
import time

import numpy as np
import regex
from pyspark.sql import functions as F

from vellumspark.functions import scripts as W
from vellumspark.operators import files as Z
from vellumspark.operators import runs as R


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_radicals(spark):
    assert one(spark, W.unified_ideographs(F.col("t")), t="⽂件 ⻓⻑ ⿊⾊ ab") == "文件 长長 黑色 ab"


def test_join_words(spark):
    rows = spark.createDataFrame([(["为", "什么", "PDF", "看", "，", "好"],), ([],), (["한", "국"],), (None,), ([None, "这", "些"],)], "w array<string>")
    assert [r[0] for r in rows.select(W.join_words(F.col("w"))).collect()] == ["为什么 PDF 看，好", "", "한 국", None, "这些"]


def test_join_words_in_linear_time(spark):
    words = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.when(i % 3 == 0, "ab").otherwise("压缩"))
    joined = lambda n: one(spark, W.join_words(words), n=n)
    assert joined(7) == "压缩压缩 ab 压缩压缩 ab 压缩"
    began = time.monotonic()
    assert joined(24_000).count(" ab") == 8_000
    assert time.monotonic() - began < 20


def naive_switches(text):
    kinds = {s: "CJK" if s in W.CHINESE_JAPANESE else s for s in W.SCRIPTS}
    res = [(kinds[s], regex.compile(rf"\p{{Script={s}}}")) for s in W.SCRIPTS]
    before, pairs, switches = None, 0, 0
    for c in text:
        now = next((k for k, r in res if r.match(c)), None) if regex.match(r"\p{L}", c) else None
        if now and before:
            pairs += 1
            switches += now != before and {now, before} != {"Latin", "CJK"}
        before = now
    return pairs, switches


def test_script_switches(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abé文かカ한жαשبक 1.-") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    met = W.script_switches(F.col("t"))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", met["pairs"], met["switches"]).collect()
    assert all((r[1], r[2]) == naive_switches(r[0]) for r in got)


def test_broken_layer(spark):
    cases = [("aж" * 100, True), ("aж" * 99, False), ("ab " * 100, False), ("a文" * 150, False), ("\x01" + "a" * 300, False), ("\x01\x02" * 10 + "a" * 300, True), ("", False)]
    got = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(W.layer_looks_broken(F.col("t"))).collect()
    assert [r[0] for r in got] == [w for _, w in cases]


def test_order_votes():
    assert W.order_votes("שלום") == (1, 0) and W.order_votes("םולש") == (0, 1)
    assert W.order_votes("الكتاب") == (1, 0) and W.order_votes("باتكلا") == (0, 1)
    assert W.order_votes("كلا") == (0, 0) and W.order_votes("مثلا") == (0, 0)
    assert W.order_votes("ﺻﻴﻐﺔ") == (1, 0) and W.order_votes("ﺔﻐﻴﺻ") == (0, 1)  # forms decide alone
    assert W.order_votes("ابتﻼ") == (1, 0) and W.order_votes("ﻼتبا") == (0, 1)
    assert W.order_votes("ab 12") == W.order_votes(None) == W.order_votes("") == (0, 0)


def test_copies_of_items():
    items = [(1, 0.0, 0.0, 20.0, 10.0, "備註"), (2, 0.5, 0.4, 10.0, 10.0, "備"), (3, 10.4, 0.0, 20.0, 10.0, "註文"), (4, 0.0, 0.0, 5.0, 10.0, " "), (5, 50.0, 0.0, 9.0, 10.0, "ab"), (6, 51.0, 1.0, 9.0, 10.1, "ab"), (7, 51.0, 1.0, 9.0, 12.0, "ab"), (8, 52.0, 0.0, 9.0, 10.0, "ab")]
    assert R.page_without_copies(items) == [items[0], (3, 20.4, 0.0, 10.0, 10.0, "文"), items[3], items[4], items[6], items[7]]


def test_copies_by_brute_force():
    rng = random.Random(5)
    items = [(i, rng.uniform(0, 30), rng.uniform(0, 6), 8.0, rng.choice([10.0, 10.1, 12.0]), rng.choice(["a", "b c"])) for i in range(300)]
    kept = []
    for item in items:
        if not any(k[5] == item[5] and abs(k[1] - item[1]) < 0.15 * item[4] and abs(k[2] - item[2]) < 0.15 * item[4] and abs(k[4] - item[4]) < 0.02 * item[4] for k in kept):
            kept.append(item)
    assert R.page_without_copies(items) == kept


def spread(text, step, start=0.0):
    return [(start + i * step, 10.0, 10.0, c) for i, c in enumerate(text)]


def test_letter_spacing():
    assert R.spaced_text(spread("董事名單", 15.0)) == "董事名單"
    assert R.spaced_text(spread("董事", 15.0)) == "董 事"  # one gap alone says nothing
    assert R.spaced_text(spread("氏名", 15.0) + spread("所属", 15.0, 100.0)) == "氏名 所属"
    assert R.spaced_text(spread("青山", 15.4) + spread("桃子", 15.4, 40.8)) == "青山 桃子"
    assert R.spaced_text(spread("東京都", 10.0) + spread("新宿区", 10.0, 32.5)) == "東京都 新宿区"
    assert R.spaced_text([(0.0, 10.0, 10.0, "山"), (15.0, 15.0, 10.0, " 名"), (35.0, 10.0, 10.0, "所")]) == "山 名 所"
    assert R.spaced_text([]) == ""


def test_line_runs(spark):
    """Two headers of two characters, each a run of its own: their spacings agree, so neither gets a space."""
    rows = [(1, 1, 1, spread("氏名", 15.0) + spread("所属", 15.0, 100.0), None), (1, 1, 2, spread("氏名", 15.0), [12.0]), (1, 1, 3, [], []), (1, 1, 4, [(0.0, 10.0, 10.0, "项"), (10.0, 10.0, 10.0, "目")], [])]
    lines = spark.createDataFrame(rows, "doc_id long, page int, line int, items array<struct<x:double,width:double,size:double,text:string>>, cuts array<double>")
    got = [(r.line, r.run, r.x, r.width, r.text) for r in R.line_runs(lines).orderBy("line", "run").collect()]
    assert got == [(1, 0, 0.0, 25.0, "氏名"), (1, 1, 100.0, 25.0, "所属"), (2, 0, 0.0, 10.0, "氏"), (2, 1, 15.0, 10.0, "名"), (4, 0, 0.0, 20.0, "项目")]


def test_runs():
    items = [(0.0, 30.0, 10.0, "ab"), (31.0, 30.0, 10.0, "cd"), (67.0, 10.0, 10.0, "ef")]
    assert [[i[3] for i in s] for s in R.segments(items)] == [["ab", "cd"], ["ef"]]
    assert [[i[3] for i in s] for s in R.segments(items, (30.5,))] == [["ab"], ["cd"], ["ef"]]
    cjk = [(0.0, 10.0, 10.0, "项"), (10.2, 10.0, 10.0, "目"), (20.2, 10.0, 10.0, "a"), (30.2, 10.0, 10.0, "文"), (41.0, 10.0, 10.0, "字")]
    assert [i[3] for i in R.touching(cjk)] == ["项目", "a", "文", "字"]
    assert [i[3] for i in R.touching(cjk, (10.0,))] == ["项", "目", "a", "文", "字"]


def test_covers():
    view = (0.0, 0.0, 480.0, 480.0)
    half = [("save", []), ("transform", [240.0, 0, 0, 480.0, 0, 0]), ("image", []), ("image", []), ("restore", []), ("restore", [])]
    boxes = R.painted_boxes(half)
    assert R.raster_share(boxes, view) == 1.0 and R.paint_share(boxes, view) == 0.5
    turned = R.painted_boxes([("save", [0.0, 1, -1, 0, 480, 0]), ("transform", [480.0, 0, 0, 120.0, 0, 0]), ("image", [])])
    assert turned == [("image", (360.0, 0.0, 480.0, 480.0))]
    fills = [("color", [200, 0, 0]), ("path", [0.0, 0, 480, 240]), ("fill", []), ("color", [250, 250, 250]), ("path", [0.0, 240, 480, 480]), ("fill", [])]
    assert R.paint_share(R.painted_boxes(fills), view) == 0.5 and R.raster_share(R.painted_boxes(fills), view) == 0
    assert R.paint_share(R.painted_boxes([*fills, ("shading", [])]), view) == 1.0
    assert R.raster_share(boxes, (0, 0, 0, 0)) == R.paint_share([], view) == 0


def test_rendered():
    page = np.full((100, 80, 4), 200, np.uint8)
    assert Z.blank(page)
    page[50, 20:23] = 0
    assert Z.blank(page)
    page[50, 23] = 0
    assert not Z.blank(page)
    edge = np.full((100, 80, 4), 255, np.uint8)
    edge[:, :2] = 0
    assert Z.blank(edge) and Z.blank(np.zeros((0, 0, 4), np.uint8))
    a = np.zeros((16, 16, 3), np.uint8)
    b = a.copy()
    b[0:2, 0:2] = 80
    assert Z.worst_tile(a, b) == 80.0 and Z.worst_tile(a, a) == 0.0


def test_encryption(spark):
    cases = [(b"1 0 obj<</Filter/Standard/V 4/R 4/O(x)>> trailer<</Encrypt 1 0 R>>", True, 4), (b"<</Filter /Standard /R 6 0 R /R  3>>", False, 3), (b"", False, None), (b"." * 70000 + b"/Encrypt" + b"." * 70000, False, None), (b"/Encrypt" + b"." * 140000, True, None)]
    rows = spark.createDataFrame([(i, bytearray(c)) for i, (c, _, _) in enumerate(cases)], "i int, c binary")
    got = rows.orderBy("i").select(Z.looks_encrypted(F.col("c")), Z.encryption_revision(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(e, r) for _, e, r in cases]


def test_encryption_revision_at_the_edges(spark):
    """As the reference reads: what stands wholly in the first or last 65536 bytes, spaces behind the digit or not."""
    def file(k):
        mark = b"/Encrypt/Filter  /Standard /R 6      "
        return bytearray(b"." * k + mark + b"." * (200_000 - k - len(mark)))

    rows = spark.createDataFrame([(k, file(k)) for k in (65502, 65505, 65506, 134455, 134456)], "k int, c binary")
    assert {r[0]: r[1] for r in rows.select("k", Z.encryption_revision(F.col("c"))).collect()} == {65502: 6, 65505: 6, 65506: None, 134455: None, 134456: 6}
