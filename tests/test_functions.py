"""Boundaries and traps of single functions, and invariants of operators without an SQL form."""

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumspark.functions import bands, clients, guards
from vellumspark.functions import text as T
from vellumspark.operators import bags, detect, layout, records, signals
from vellumspark.sources import readers


def one(spark, column, **values):
    cells = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")]
    return spark.range(1).select(*cells).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("n,want", [(0, "0"), (1, "I"), (4, "IV"), (9, "IX"), (26, "XXVI"), (3999, "MMMCMXCIX"), (4000, "4000")])
def test_roman(spark, n, want):
    assert one(spark, T.roman(F.col("n")), n=n) == want


@pytest.mark.parametrize("n,want", [(0, "0"), (1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (53, "BA"), (703, "AAA")])
def test_alphabetic(spark, n, want):
    assert one(spark, T.alphabetic(F.col("n")), n=n) == want


@pytest.mark.parametrize("n,want", [(18278, "ZZZ"), (18279, "AAAA"), (19999, "ACOE"), (475255, "AAAAA")])
def test_alphabetic_beyond_three_letters(spark, n, want):
    assert one(spark, T.alphabetic(F.col("n")), n=n) == want


@pytest.mark.parametrize("spec,want", [("1-3, 5", [1, 2, 3, 5]), ("3、1", [1, 3]), ("２－４", [2, 3, 4]), ("9-2", [2, 3, 4, 5, 6, 7, 8, 9]), ("0", []), ("5~99", [5, 6, 7, 8, 9, 10]), ("x", [])])
def test_page_range(spark, spec, want):
    assert one(spark, T.page_range(F.col("s"), F.lit(10)), s=spec) == want


@pytest.mark.parametrize("cell,kind,num", [("1,234.50", "number", 1234.5), ("12%", "percent", 0.12), ("1900-02-29", "text", None), ("1899-12-31", "text", None), ("007", "text", None), ("1,23,4", "text", None), ("−5", "number", -5.0), ("", "text", None)])
def test_cells(spark, cell, kind, num):
    got = one(spark, T.cell_value(F.col("c")), c=cell)
    assert got["kind"] == kind and (got["num"] is None if num is None else abs(got["num"] - num) < 1e-12)


@pytest.mark.parametrize("text,spam", [("see http://a http://b", True), ("12345", True), ("aaaaaaaaaa", True), ("aaaaaaaaa", False), ("fine", False)])
def test_spam(spark, text, spam):
    assert one(spark, guards.looks_like_spam(F.col("t")), t=text) is spam


def test_spaces_and_words(spark):
    assert one(spark, T.join_cjk(F.col("t")), t="中 文 字 abc 가 나") == "中文字 abc 가 나"
    assert one(spark, T.word_count(F.col("t")), t="two words 中文字") == 4
    assert one(spark, T.fold_diacritics(F.col("t")), t="Ælıđłß éü") == "Æeidlss eu".replace("Æe", "Æl")
    assert one(spark, T.hyphen_join(F.col("a"), F.col("b")), a="exam-", b="ple text") == "example"
    assert one(spark, T.hyphen_join(F.col("a"), F.col("b")), a="PDF-", b="file") == "PDF-file"
    assert one(spark, T.shorten_middle(F.col("t"), 7), t="abcdefghij") == "abc…hij"


def test_luhn_and_cards(spark):
    docs = spark.createDataFrame([(1, "pay 4111 1111 1111 1111 now"), (2, "id 4111 1111 1111 1112 x")], "doc_id long, text string")
    assert [r.match for r in detect.pii_matches(docs, ["cc"]).collect()] == ["4111 1111 1111 1111"]


def test_scripts(spark):
    lang = lambda t: tuple(one(spark, detect.script_language(F.col("t")), t=t))
    assert lang("これは日本語の文章ですからひらがながあります。もっと長い文章にします") == ("jpn", True)
    assert lang("это русский текст для проверки определения языка") == ("rus+eng", True)
    assert lang("short") == ("eng", False)


def test_bands(spark):
    for size, want in ((None, "unknown"), (1048575, "<1"), (1048576, "1-10"), (10485760, "10-50"), (52428800, "10-50"), (52428801, ">50")):
        assert one(spark, bands.size_band(F.col("s").cast("long")), s=size) == want
    assert one(spark, bands.rounded_duration(F.col("m")), m=12500) == 15
    assert one(spark, clients.app(F.col("u")), u="Mobile MQQBrowser/1 QQ/8.9") == "none"


def test_rage_clicks_at_the_bounds(spark):
    t = 1_700_000_000_000
    rows = [(1, "a", t + x) for x in (0, 400, 900, 1500, 2000, 6500, 6900, 7300)] + [(1, "b", t + x) for x in (0, 1000, 2000)]
    clicks = spark.createDataFrame(rows, "session long, target string, ms long").repartition(3)
    assert sorted(r.ms - t for r in signals.rage_clicks(clicks).collect()) == [900, 7300]


def test_quick_retry_bounds(spark):
    rows = [(1, 1, 0, "d"), (2, 1, 0, "c"), (3, 1, 89, "c"), (4, 1, 90, "c"), (5, 1, 200, "c")]
    ev = spark.createDataFrame(rows, "event_id long, session long, s long, event string").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = signals.follows_within(ev, F.col("event") == "c", F.col("event") == "d", 90)
    assert sorted(r.event_id for r in got.collect()) == [2, 3]


@given(st.lists(st.integers(0, 50), max_size=60))
@settings(max_examples=80, deadline=None)
def test_longest_rise(values):
    best = [1] * len(values)
    for i in range(len(values)):
        for j in range(i):
            if values[j] < values[i]:
                best[i] = max(best[i], best[j] + 1)
    assert bags.longest_rise(values) == max(best, default=0)


def test_upper_median(spark):
    rows = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4)], "doc_id long, size double")
    assert layout.median_sizes(rows).first()["median"] == 3.0


def test_lines_do_not_depend_on_partitions(spark):
    rows = [(1, 0, i, 30.0 * (i % 5), 800.0 - 15 * (i // 5) - (i % 3), 20.0, 10.0, f"w{i}") for i in range(25)]
    items = spark.createDataFrame(rows, "doc_id long, page int, seq int, x double, y double, width double, size double, text string")
    one_, many = (sorted(map(tuple, layout.lines(items.repartition(n)).collect())) for n in (1, 6))
    assert one_ == many and len(one_) == 5


def test_greedy_lines_follow_the_first():
    items = pd.DataFrame({"x": [0.0, 1.0, 2.0], "y": [100.0, 95.0, 90.0], "width": 1.0, "size": 10.0, "text": "a"})
    assert [len(x) for x in layout.page_lines(items)] == [2, 1]


def test_each_pain_moves_its_own_counter(spark):
    base = "alpha beta gamma delta epsilon".split()
    frame = lambda w: spark.createDataFrame([(1, w)], "doc_id long, words array<string>")
    reference = bags.bag(frame(base), F.col("words"))
    lost = bags.recall(reference, bags.bag(frame(base[1:]), F.col("words"))).first()
    assert (lost.missing, lost.extra) == (1, 0)
    doubled = bags.recall(reference, bags.bag(frame([*base, "beta"]), F.col("words"))).first()
    assert (doubled.missing, doubled.extra) == (0, 1)
    assert [r.token for r in bags.glued(frame(base), bags.bag(frame(["alphabeta", *base[2:]]), F.col("words"))).collect()] == ["alphabeta"]
    assert [r.token for r in bags.split_words(bags.bag(frame(["alphabeta"]), F.col("words")), frame(base)).collect()] == ["alphabeta"]


def test_shards_must_not_share_documents(spark):
    a, b = spark.createDataFrame([(1,)], "doc_id long"), spark.createDataFrame([(2,)], "doc_id long")
    assert bags.merge_shards([a, b]).count() == 2
    with pytest.raises(Exception, match="several shards"):
        bags.merge_shards([a, a]).collect()


def test_readers():
    assert readers.sniff('a;b;c\n"x,y,z,w";1;2') == ";"
    assert readers.sniff("a,b;c\n") == ","
    assert readers.recipients('﻿name,mail\n"Doe, J",x@y.z\n\n') == [["name", "mail"], ["Doe, J", "x@y.z"]]
    with pytest.raises(ValueError):
        readers.recipients('"open')


def test_metric_files(spark, tmp_path):
    lines = ['{"measure":"m","schema":"1","metric":"x","oracle":"o","corpus":"c","docs":1}', '{"doc":"a","recall":0.5}']
    (tmp_path / "rows.jsonl").write_text("\n".join(lines))
    path = str(tmp_path)
    assert [tuple(r) for r in readers.metric_rows(spark, path, "doc string, recall double").collect()] == [("a", 0.5)]
    assert readers.same_header(readers.metric_header(spark, path), readers.metric_header(spark, path))


def value_of(spark, column, *values):
    names = [f"v{i}" for i in range(len(values))]
    return spark.range(1).select(*[F.lit(v).alias(n) for v, n in zip(values, names)]).select(column(*[F.col(n) for n in names]).alias("x")).first().x


@pytest.mark.parametrize(
    "host,want",
    [("login.bank.co.uk", "bank.co.uk"), ("www.shop.com.mx", "shop.com.mx"), ("a.b.co.nz", "b.co.nz"), ("www.example.com.", "example.com"), ("news.example.org", "example.org"), ("bank.com", "bank.com"), ("CO.UK", "co.uk"), ("a.ac.jp", "a.ac.jp")],
)
def test_sites(spark, host, want):
    assert value_of(spark, detect.site, host) == want


LATIN = {
    "ita": "Questo documento è per gli utenti che vuoi, con una copia della lettera e dei dati nel testo anche",
    "por": "O documento não é para uma pessoa, com os dados do texto em português e na forma da lei",
    "tur": "Bu belge ve bir kopya için daha sonra olarak gibi her zaman çok iyi ama veya",
    "vie": "Đây là một văn bản được viết cho người dùng và không có những lỗi này khi đọc",
    "deu": "Das ist ein Text, der nicht auf Englisch ist und sich auch mit dem Wort werden oder wird",
    "eng": "The text that you can read is with it as are on this by from your",
}


@pytest.mark.parametrize("lang", sorted(LATIN))
def test_latin_languages(spark, lang):
    assert value_of(spark, detect.latin_language, LATIN[lang]) == lang
    docs = spark.createDataFrame([(1, LATIN[lang])], "doc_id long, text string")
    assert detect.common_word_language(docs).first().lang == lang


def test_script_languages(spark):
    russian = "Это русский текст, в котором довольно много букв для уверенности"
    assert tuple(value_of(spark, detect.script_language, russian)) == ("rus+eng", True)
    assert tuple(value_of(spark, detect.script_language, LATIN["deu"])) == ("deu", True)
    assert tuple(value_of(spark, detect.script_language, "short")) == ("eng", False)


def test_personal_data_patterns(spark):
    text = "Cards 4111 1111 1111 1111 5500005555555559, IBAN DE89370400440532013000, not X4111111111111111Z; mail jo_e+1@b.co or é@x.de; HTTP://A.b/c +49 30 1234"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {(r.kind, r.match) for r in detect.pii_matches(docs).collect()}
    assert {m for k, m in got if k == "cc"} == {"4111 1111 1111 1111", "5500005555555559"}
    assert ("iban", "DE89370400440532013000") in got and ("email", "jo_e+1@b.co") in got and ("url", "HTTP://A.b/c") in got


def test_glossary_terms_of_several_words(spark):
    docs = spark.createDataFrame([(1, "Machine  learning and machine-learning; MACHINE LEARNING, learning machine."), (2, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("machine learning",), ("Learning",), ("deep learning",), ("",)], "term string")
    assert sorted((r.term, r.n) for r in detect.glossary_matches(docs, terms).collect()) == [("Learning", 4), ("machine learning", 2)]
    assert detect.glossary_matches(docs, terms.filter("term = ''")).count() == 0


def test_suspicious_readings(spark):
    check = lambda c, t, w: value_of(spark, records.suspicious_reading, c, t, w)
    assert check(59.0, "plain words", [90.0]) and not check(60.0, "plain words", [90.0])
    assert check(75.0, "words", [39.0] * 3 + [90.0] * 17) and not check(75.0, "words", [39.0] * 2 + [90.0] * 18)
    assert not check(80.0, "words", [39.0] * 20) and not check(75.0, "words", [39.0] * 19)
    assert check(90.0, "a 42 2024 50,000", [90.0]) and not check(90.0, "Invoice: Total: $500", [90.0])


def test_common_length_by_brute_force():
    import random

    def naive(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            row = [0] + [max(row[j + 1], row[j] + 1) if a == b else max(row[j + 1], 0) for j, b in enumerate(y)]
            for j in range(1, len(row)):
                row[j] = max(row[j], row[j - 1])
        return row[-1]

    assert records.common_length(list("a1b2c3d4XX"), list("XXabcd")) == 4
    rng = random.Random(1)
    for _ in range(200):
        x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert records.common_length(x, y) == naive(x, y)


def test_watched_names():
    body = b"<< /OpenAction << /S /J#61vaScript >> /ByteRange [0 1] /JBIG2Decode >>\nstream\n/Launch\nendstream\n/GoToE /ObjStm %%EOF"
    found = {k: n for k, n in records.pdf_names(body).items() if n}
    assert found == {"OpenAction": 1, "JavaScript": 1, "ByteRange": 1, "JBIG2Decode": 1, "GoToE": 1, "ObjStm": 1, "%%EOF": 1}
