import math
import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import ODD
from vellumspark.llm import html_extract, license_scan, packing, queries, sentencepiece_codec, topk
from vellumspark.session import table

FOLDER = "/root/testdata/sf0.01"
PIECES = [" ", "  ", "a", "the", "\n", "▁", "é", "日", "😀", "\x00", "12", "!!", "   ", '"', "ing", "tion", "e", "<s>", "한", "ﬁ", "\t", "====", "x,", "y.\nZ"]


def test_sentencepiece_like_the_library():
    import sentencepiece

    model = open(queries.tokenizer_path("piece_bpe_32k.model"), "rb").read()
    sp, own = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_codec.Codec(model, cache_words=50)
    rng = random.Random(4)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 16))) for _ in range(3000)] + [" " * n + "the" for n in range(70)]
    for t in texts:
        ids = sp.encode(t)
        assert own.encode(t) == ids, t
        assert own.round_trip(t) == (",".join(map(str, ids)), sp.decode(ids)), t


def test_sentencepiece_long_words():
    import sentencepiece

    model = open(queries.tokenizer_path("piece_bpe_32k.model"), "rb").read()
    sp, own = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_codec.Codec(model)
    rng = random.Random(5)
    for letters in ("0123456789", [chr(c) for c in range(0x4E00, 0x9000)], [chr(c) for c in range(0x1F600, 0x1F640)], "a1日😀é,xth\n"):
        word = "".join(rng.choice(letters) for _ in range(5000))
        for t in (word, "on " + word + " the", "a\n" + word):
            ids = sp.encode(t)
            assert own.round_trip(t) == (",".join(map(str, ids)), sp.decode(ids))
    assert max(map(len, own.young)) <= sentencepiece_codec.CACHE_CHARS


def test_sentencepiece_megabyte_words():
    """Linear: a word of about a megabyte, whatever its characters, takes seconds."""
    import time

    import sentencepiece

    model = open(queries.tokenizer_path("piece_bpe_32k.model"), "rb").read()
    sp, own = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_codec.Codec(model)
    for text in ("😀" * 250_000, "中文字" * 110_000, "0123456789" * 100_000, "qz" * 500_000, " " * 1_000_000, " " * 100_001 + "the", "   " + "abcde" * 60_000):
        began, ids = time.perf_counter(), sp.encode(text)
        assert own.round_trip(text) == (",".join(map(str, ids)), sp.decode(ids))
        assert time.perf_counter() - began < 20


def test_sentencepiece_clashing_and_empty(spark, make):
    from pyspark.sql import functions as F

    path = queries.tokenizer_path("piece_bpe_32k.model")
    assert sentencepiece_codec.encode_decode(make([]), path).count() == 0
    more = make(ODD).withColumns({c: F.lit("x") for c in ("ids", "decoded", "n_tokens")})
    got = sentencepiece_codec.encode_decode(more, path)
    assert got.columns == ["doc_id", "ids", "decoded"] and got.count() == len(ODD)


def test_sentencepiece_query(spark):
    import hashlib

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}
    for r in queries.op5_sentencepiece(spark, FOLDER).collect():
        ids = sp.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_sentencepiece_odd_rows(make):
    got = sentencepiece_codec.encode_decode(make(ODD), queries.tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(got) == len(ODD) and {(r.ids, r.decoded) for r in got if r.doc_id in (1, 2)} == {("", "")}


def test_packing_ids_like_tokenizers():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    t, own = Tokenizer.from_file(path), packing.word_encoder(open(path).read(), 40)
    rng = random.Random(6)
    odd = ["it's <|endoftext|> x", " x y ", "a \nb", "a\x1c b", "a \x85b", "'s don't", "ĳ ǆ ᾳ"]
    for text in odd + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 16))) for _ in range(1500)]:
        assert np.frombuffer(own(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def check_packing(rows, ids_of):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, own in by_doc.items():
        at, ids = 0, ids_of[doc]
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for own in by_sequence.values():
        end = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 1024
        padding += 0 if end & (end - 1) == 0 else 1024 - end
    return padding


def test_packing_query(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 0] for r in table(spark, FOLDER, "documents").collect()}
    rows = [r.asDict() for r in queries.op7_packing(spark, FOLDER).collect()]
    assert {r["doc_id"] for r in rows} == set(ids)
    assert check_packing(rows, ids) <= 0.01 * sum(map(len, ids.values()))


def test_packing_odd_rows(make):
    rows = packing.pack(make(ODD), queries.tokenizer_path("byte_bpe_50k.json")).collect()
    assert sum(r.length for r in rows if r.doc_id in (1, 2)) == 2
    assert packing.pack(make([]), queries.tokenizer_path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("lengths", [[], [1], [1023] * 3, [600] * 5, [1, 2, 3, 1000, 1000], list(range(1, 400))])
def test_assign_holds_all_tokens(lengths):
    pieces, count = packing.assign(lengths)
    assert count == -(-sum(lengths) // 1024)
    assert sum(p[2] for p in pieces) == sum(lengths)
    pieces, _ = packing.split_last(pieces, count)
    assert sum(p[2] for p in pieces) == sum(lengths)


def test_assign_cuts_only_what_fits_nowhere():
    rng = random.Random(7)
    lengths = [min(1023, int(rng.expovariate(1 / 350)) + 1) for _ in range(4096)]
    pieces, count = packing.assign(lengths)
    used, cost, cut = [0] * count, [0.0] * count, set()
    whole = {i: s for i, start, length, s, _ in pieces if length == lengths[i]}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        open_ = [s for s in range(count) if used[s] + lengths[i] <= 1024]
        if not open_:
            cut.add(i)
            continue
        s = min(open_, key=lambda s: (cost[s], s))
        assert whole.get(i) == s
        used[s] += lengths[i]
        cost[s] += lengths[i] + lengths[i] ** 2 / 512
    assert cut >= {p[0] for p in pieces if p[2] < lengths[p[0]]}


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>Top</header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><h1>A &amp; B</h1><p>One <b>two</b>
 three<br>four<p>Five<aside>Side</aside><div class="ad">Buy</div><ul><li>six<li>seven</ul><form>Name <input></form><script>var x="</p>"</script>
<p>&lt;tag&gt; &eacute;&nbsp;x</p><section id="comments"><p>First!</p></section></article></main><div class="sidebar">Links</div><footer>End</footer></body></html>"""


def test_extract_rules():
    assert html_extract.extract(PAGE) == "A & B\nOne two three four\nFive\nsix\nseven\n<tag> é x"
    assert html_extract.extract("") == ""
    assert html_extract.extract("plain text") == "plain text"
    assert html_extract.extract("<p>unclosed <b>bold") == "unclosed bold"
    assert html_extract.extract("<article><p>a<article></p>") == "a"
    assert html_extract.extract("<" * 3000 + "p>") is not None


def words_of(rng, n):
    return " ".join(f"{rng.choice(('alpha', 'beta', 'gamma', 'delta'))}{rng.randint(0, 999)}" for _ in range(n))


def unmarked(rng, paragraphs, odd=False):
    """A page whose names say nothing: only repetition over the host's pages tells what is the article."""
    body = "".join(f"<p>{words_of(rng, 30)}</p>" for _ in range(paragraphs)) + ("<ul><li>one<li>two</ul>" if odd else "")
    return f"<body><div class=c1><div>Home</div><div>About us</div></div><div class=c2><h1>{words_of(rng, 5)}</h1><div class=c3>{body}</div><div class=c9>Share this story</div></div><div class=c4>All rights</div>"


def naive_match(items, marks, at, same):
    """All places where the items can end, from the definition of the expression, with going back."""
    ends = {at}
    for x in items:
        if isinstance(x, str):
            text = {e + 1 for e in ends if e < len(marks) and (marks[e] == x or (x == "#" and marks[e][0] in "#="))}
            ends = text | ends if x[0] == "=" else text
            continue
        kind, inner = x
        once = set() if kind == "+" else set(ends)
        step, seen = set(ends), set()
        while step:
            step = set().union(*[naive_match(inner, marks, e, same) for e in step]) - seen
            seen |= step
            if kind == "?":
                break
        ends = once | seen
    return ends


def test_alignment_covers_its_pages():
    """The aligned expression takes each page it was made of, by a matcher that goes back; the wrapper's expression takes nothing else."""
    rng = random.Random(3)
    pages = [html_extract.read(unmarked(rng, k % 4 + 1, k % 3 == 0)) for k in range(9)]
    same = html_extract.shared_texts(pages)
    items = []
    for p in pages:
        marks = html_extract.collapse(html_extract.skeleton(p, same)[0])
        items = html_extract.align(items, marks) if items else marks
    wrapper = html_extract.Wrapper(html_extract.infer(pages))
    fit = 0
    for p in [*pages, *[html_extract.read(unmarked(rng, k)) for k in range(1, 7)], html_extract.read("<body><div class=c1>x</div><table><tr><td>y</table>")]:
        marks = html_extract.skeleton(p, same)[0]
        naive, got = len(marks) in naive_match(items, marks, 0, same), wrapper.matched(p)
        assert naive or got is None
        assert naive or p not in pages
        fit += got is not None
        assert got is None or p.marks[got] == "div c2"
    assert fit >= 12


def test_wrapper_decides_where_names_say_nothing():
    rng = random.Random(4)
    sources = [unmarked(rng, k % 5 + 1) for k in range(10)]
    wrapper = html_extract.Wrapper(html_extract.infer([html_extract.read(p) for p in sources[:8]]))
    for p in [*sources, sources[0].replace("<div class=c3>", "<table><tr><td>new</td></table><div class=c3>")]:
        got, plain = html_extract.extract(p, wrapper).split("\n"), html_extract.extract(p).split("\n")
        assert plain[:2] == ["Home", "About us"] and plain[-2:] == ["Share this story", "All rights"]
        assert got == plain[2:-2]


def test_copies_are_no_template():
    """Pages with one text, or nearly, don't make it template; nor do headings or texts that only some pages share."""
    rng = random.Random(5)
    one = unmarked(rng, 4)
    assert html_extract.infer([html_extract.read(one)] * 5) is None
    near = [one.replace("Home", f"Home {k}") for k in range(6)] + [unmarked(rng, 3) for _ in range(5)]
    wrapper = html_extract.Wrapper(html_extract.infer([html_extract.read(p) for p in near]))
    assert len(html_extract.extract(one, wrapper).split("\n")) == 5
    headed = [unmarked(rng, 2).replace("<div class=c9>Share this story</div>", "<h2>References</h2><p>shared passage of some</p>" if k else "<h2>References</h2>") for k in range(8)]
    wrapper = html_extract.Wrapper(html_extract.infer([html_extract.read(p) for p in headed]))
    assert html_extract.extract(headed[1], wrapper).split("\n")[-2:] == ["References", "shared passage of some"]


def test_names_lose_no_article():
    page = """<body><article><h1>T</h1><section class="related-work"><p>rw</p></section><div class="social-history">sh</div><p class="comment">c</p>
    <div class="related-posts">no</div><div class="ad">no</div><ol class="comment-list"><li>no</ol><section id=comments>no</section><p class="cookie-notice">no</p></article></body>"""
    assert html_extract.extract(page) == "T\nrw\nsh\nc"
    assert html_extract.extract('<body><div class="search-results"><p>found</p></div></body>') == "found"
    assert html_extract.extract('<body><div class="sidebar"><article><p>inside</p></article></div></body>') == "inside"
    assert html_extract.extract('<body><div class="post"><p>long article text here</p></div><div class="comments"><p>c1</p></div></body>') == "long article text here"


@pytest.mark.parametrize(
    "unit,tail",
    [('<a "', ""), ('<a x="', ""), ("<div>", ""), ("</b>", ""), ("<", ""), ("<p>x", ""), ("<li><div>", ""), ("<a =", ">"), ('<a x=">', ""), ("<td>x<table>", ""), ("<!--", ""), ("<div class=ad>", ""), ("<a x='\">\"", ""), ("<dt><dl>", ""), ("<script>", "")],
)
def test_broken_pages_take_linear_time(unit, tail):
    import time

    page = unit * (1_000_000 // len(unit)) + tail
    began = time.perf_counter()
    assert html_extract.extract(page) is not None
    assert time.perf_counter() - began < 10


def test_html_query_like_a_parser(spark):
    """Every page of the table against the standard library's parser and a plain reading of its article."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.skip, self.run, self.blocks = False, 0, [], []

        def flush(self):
            text = " ".join("".join(self.run).split())
            self.blocks += [text] if text else []
            self.run = []

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.inside = True
            if tag == "br":
                self.run.append(" ")
            elif tag in ("p", "h1", "h2", "ul", "li", "div", "article"):
                self.flush()
            self.skip += tag in ("nav", "footer", "form", "aside", "script") or (tag == "div" and ("class", "ad") in attrs)

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "h2", "ul", "li", "div", "article"):
                self.flush()
            if tag == "article":
                self.inside = False

        def handle_data(self, data):
            if self.inside:
                self.run.append(data)

    pages = {r.page_id: r.html for r in table(spark, FOLDER, "pages").collect()}
    got = queries.op6_html(spark, FOLDER).collect()
    assert len(got) == len(pages)
    for r in got:
        parser = Article()
        parser.feed(pages[r.page_id] or "")
        parser.close()
        parser.flush()
        assert r.text == "\n".join(parser.blocks) and r.n_chars == len(r.text)


def test_html_clashing_columns(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = [(k, f"http://h.example/{k}", unmarked(rng, k % 4 + 1)) for k in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    more = pages.withColumns({c: F.lit("x") for c in ("host", "draw", "place", "pages", "wrapper", "text", "n_chars")})
    a, b = html_extract.extract_pages(pages), html_extract.extract_pages(more)
    assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert all("Home" not in r.text and "Share" not in r.text for r in b.collect())


def test_extract_odd_rows(spark):
    rows = [(1, "http://h.example/a", PAGE), (2, None, None), (3, "odd", ""), (3, "odd", ""), (None, "http://h.example/b", "<p>x")]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 5 and {(r.text, r.n_chars) for r in got if r.page_id in (2, 3)} == {("", 0)}
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def searched(blocks, asked, queries, k):
    """What a task finds in blocks of (ids, vectors), each packed and read again."""
    best = topk.Best(np.asarray(asked, dtype=np.int64), np.asarray(queries, dtype=np.int64), k)
    for ids, vectors in blocks:
        cells, low, width, gap, kind, exact = topk.ApproximationFile.of(vectors).pack()
        best.search(topk.ApproximationFile.unpack(vectors.shape[1], cells, low, width, gap, kind, exact), ids)
    return best


def best_rows(ids, vectors, i, q, k):
    whole = [int(x) for x in q]
    scores = [max(topk.LEAST, min(topk.MOST, sum(a * b for a, b in zip(v, whole)))) for v in vectors.tolist()]
    return sorted((-s, int(j)) for s, j in zip(scores, ids) if j != i)[:k]


@pytest.mark.parametrize("size", [1, 3, 256, 1 << 20, 1 << 40, (1 << 63) - 1])
@pytest.mark.parametrize("n", [1, 4, 300])
def test_search_is_exact(size, n):
    rng = np.random.default_rng(size % 97 + n)
    ids = rng.permutation(10 * n)[:n].astype(np.int64)
    vectors = rng.integers(-size, size, (n, 7), endpoint=True)
    vectors[: n // 3] = vectors[0]
    asked = vectors[:20].copy()
    blocks = [(ids[at : at + 90], vectors[at : at + 90]) for at in range(0, n, 90)]
    for k in (1, 5):
        best = searched(blocks, ids[:20], asked, k)
        for i, q, found in zip(ids[:20], asked, best.found):
            assert found == best_rows(ids, vectors, i, q, k)


def test_search_reads_few_vectors():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-256, 256, (8192, 64))
    ids, asked = np.arange(8192, dtype=np.int64), rng.integers(-256, 256, (50, 64))
    best = searched([(ids[:4096], vectors[:4096]), (ids[4096:], vectors[4096:])], np.arange(-50, 0), asked, 5)
    for q, found in zip(asked, best.found):
        assert found == sorted(zip((-(vectors @ q)).tolist(), ids.tolist()))[:5]
    assert best.read < 0.1 * 50 * 8192


def test_search_copies_of_the_best():
    for seed in range(12):
        rng = np.random.default_rng(seed)
        vectors = rng.integers(-256, 256, (4096, 64))
        ids = rng.permutation(40960)[:4096].astype(np.int64)
        asked = rng.integers(-256, 256, (4, 64))
        for q in asked:
            vectors[rng.choice(4096, 200, replace=False)] = vectors[np.argmax(vectors @ q)]
        best = searched([(ids, vectors)], np.arange(-4, 0), asked, 5)
        for q, found in zip(asked, best.found):
            assert found == sorted(zip((-(vectors @ q)).tolist(), ids.tolist()))[:5]


def test_top_k_waves(spark):
    """Several waves, blocks and vector lengths, extra columns: the same as brute force."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=3 + i % 2)], "x", 1) for i in rng.permutation(600).tolist()]
    rows += rows[:40]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, score int").repartition(3)
    got = {}
    for r in topk.top_k(docs, k=4, query_every=7, block_rows=1100, wave_bytes=700).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (-r.score, r.vec_id)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows]
    asked = {i: v for i, v in whole if i % 7 == 0}
    assert set(got) == set(asked)
    for i, q in asked.items():
        want = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i and len(v) == len(q))[:4]
        assert [got[i][n] for n in range(1, 5)] == want


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (50, None, 1), (100, [float("nan"), 1.0], 1), (150, [None, 1.0], 1), (200, [1e30, 1.0], 1), (1, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [], 1), (None, [1.0, 1.0], 1), (3, [1.0, 1.0, 1.0], 2)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.query_id for r in got} == {0, 200}
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == [200, 1, 1]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_license_odd_rows(spark, make):
    texts = [*ODD, (20, "x y. Released under the MIT License. z"), (21, "released UNDER the mit\nlicense"), (22, "released under the license MIT"), (23, "Licensed under the Apache License, Version 2.0.")]
    got = {(r.doc_id, r.template_id) for r in license_scan.scan(make(texts), license_scan.template_table(spark)).collect()}
    assert got == {(20, "mit-line"), (21, "mit-line"), (23, "apache-2.0-line")}
    assert license_scan.scan(make([]), license_scan.template_table(spark)).count() == 0


def test_license_recall(spark, make):
    """Damaged copies of the full texts against brute force: all with containment 0.8 are found, or at least 99 of 100."""
    rng = random.Random(9)
    texts = []
    for i in range(300):
        text = rng.choice([t for _, _, t in license_scan.TEMPLATES if len(t.split()) > 25]).split()
        for _ in range(rng.randint(0, len(text) // 20)):
            text[rng.randrange(len(text))] = rng.choice(("changed", "word", ""))
        lead = " ".join(rng.choice(("one", "two", "three")) for _ in range(rng.randint(0, 9)))
        texts.append((i, f"{lead} {' '.join(text)} and more after it"))

    def shingles(text):
        words = __import__("re").findall("[a-z0-9]+", text.lower())
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    known = {i: shingles(t) for i, _, t in license_scan.TEMPLATES}
    want = {(i, n): len(s & shingles(t)) / len(s) for i, t in texts for n, s in known.items()}
    want = {k: v for k, v in want.items() if v >= 0.8}
    got = {(r.doc_id, r.template_id): r.containment for r in license_scan.scan(make(texts), license_scan.template_table(spark)).collect()}
    assert set(got) <= set(want) and all(abs(want[k] - v) < 1e-12 for k, v in got.items())
    assert len(want) > 200 and len(got) >= 0.99 * len(want)


def test_license_windows_meet_as_stated(spark):
    """Windows of similarity 0.6 share a band about as often as the curve says."""
    rng = random.Random(10)
    rows = []
    for i in range(2000):
        common, own = ([rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (6, 4))
        rows.append((i, common + own[:2], common + own[2:]))  # 6 of 10 shared
    df = spark.createDataFrame(rows, "i int, a array<bigint>, b array<bigint>")
    met = df.select(license_scan.window_bands("a", 4).alias("a"), license_scan.window_bands("b", 4).alias("b")).filter("arrays_overlap(a, b)").count()
    assert abs(met / 2000 - (1 - (1 - 0.36) ** 4)) < 0.04


def test_pieces_are_bounded_and_whole():
    import pyarrow as pa

    from vellumspark.llm.common import pieces

    texts = [None, "", "x" * 5000, *["y" * n for n in range(300)], "z" * 100_000, "w"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    got = list(pieces(iter([batch, batch.slice(0, 0), batch]), rows=50, size=4000))
    assert [t for p in got for t in p.column("text").to_pylist()] == texts * 2
    assert all(p.num_rows == 1 or (p.num_rows <= 50 and p.nbytes <= 4000) for p in got)
    assert list(pieces(iter([]))) == []
