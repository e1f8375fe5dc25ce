import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import ODD
from vellumspark.llm import elias_fano, langid, lm, quality, queries
from vellumspark.session import table

FOLDER = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = table(spark, FOLDER, "documents")
    got = langid.identify(docs, langid.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_language_odd_rows(spark, make):
    model = langid.fit(["the cat and the dog", "der hund und die katze"] * 3, ["en", "de"] * 3)
    got = {r.doc_id: r for r in langid.identify(make([*ODD, (9, "12 34 !!")]), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 9)] == ["und"] * 4 and got[9].score == 0
    assert langid.identify(make(ODD), langid.learn(make([]))).filter("lang_pred <> 'und'").count() == 0
    kept = langid.keep_identified(make(ODD), model)
    assert kept.columns == make([]).columns and kept.count() == sum(any(c.isalpha() for c in t or '') for _, t in ODD)


def test_grams_are_the_distinct_blended_spectrum():
    text = "Abc, abd"
    plain = " abc abd "
    want = {plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1)}
    assert len(langid.grams(text)) == len(want)


def naive_language_scores(texts, langs, asked, landmarks, ridge):
    """The same model from its definition: kernel by sets, Nystroem features, weighted ridge; nothing folded."""
    sets = [set(langid.grams(t).tolist()) for t in texts]
    names = sorted(set(langs))
    marks = [s for n in names for s in [s for s, x in zip(sets, langs) if x == n][:landmarks]]
    kernel = lambda a, b: np.array([[len(x & y) / math.sqrt(len(x) * len(y)) for y in b] for x in a])
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    root = vectors * np.where(values > 1e-8 * values.max(), 1 / np.sqrt(np.maximum(values, 1e-12)), 0) @ vectors.T
    x, y = kernel(sets, marks) @ root, np.array([[1.0 if n == own else -1.0 for n in names] for own in langs])
    w = np.array([1 / langs.count(own) for own in langs])
    w /= w.mean()
    mx, my = np.average(x, axis=0, weights=w), np.average(y, axis=0, weights=w)
    beta = np.linalg.solve((x - mx).T @ ((x - mx) * w[:, None]) + ridge * len(sets) * np.eye(len(marks)), (x - mx).T @ ((y - my) * w[:, None]))
    return (kernel([set(langid.grams(t).tolist()) for t in asked], marks) @ root - mx) @ beta + my


def test_language_scores_by_definition(spark):
    rows = [r for r in table(spark, FOLDER, "documents").orderBy("doc_id").limit(120).collect() if r.text and len(langid.grams(r.text)) and r.lang]
    texts, langs = [r.text for r in rows[:80]], [r.lang for r in rows[:80]]
    asked = [r.text for r in rows[80:]]
    model = langid.fit(texts, langs, landmarks=6)
    want = naive_language_scores(texts, langs, asked, 6, 1e-3)
    assert np.allclose(model.scores([langid.grams(t) for t in asked]), want, atol=2e-3)
    assert model.predict(asked)[0] == [model.languages[k] for k in want.argmax(axis=1)]


def test_learning_samples_are_bounded(spark, monkeypatch):
    """A repeated id, with one text or many, brings at most the documented number of rows to the driver."""
    from pyspark.sql import functions as F

    many = spark.range(50_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).cast("long").alias("n_chars"))
    few = spark.createDataFrame([(i, "plain words here" if i % 2 else "BAD!! WORSE!!", "de", "s", 9) for i in range(40)], many.schema)
    docs = many.unionByName(few)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda texts, got: seen.setdefault("quality", len(texts)))
    monkeypatch.setattr(langid, "fit", lambda texts, langs, marks=0: seen.setdefault("language", max(langs.count(x) for x in set(langs))))
    quality.learn(docs, labels)
    langid.learn(docs, per_lang=100)
    assert 0 < seen["quality"] <= 40 and 0 < seen["language"] <= 100


def test_quality_refuses_to_drop_all(spark, make):
    docs = make([(1, "some text"), (2, "more text")])
    model = quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    with pytest.raises(ValueError):
        quality.keep_good(docs, model)
    assert quality.keep_good(make([]), model).count() == 0


def naive_quality(model, text):
    """The score by its definition, one word at a time."""
    size, words = quality.SIZE, text.split()
    x = np.zeros(2 * size + 2)
    for w in words:
        s = model.shapes.get(quality.shape(w), 0)
        x[:size] += model.vectors[model.words.get(w, s)]
        x[size : 2 * size] += model.vectors[s]
    x = np.append(x[: 2 * size] / len(words), [math.log1p(len(words)), 0]) if words else np.append(x[:-1], 1)
    hidden = [max(0.0, sum((x - model.mean) / model.scale * model.layers[0][:, k]) + model.layers[1][k]) for k in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-(float(np.dot(hidden, model.layers[2])) + float(model.layers[3])) / model.temperature))


def test_quality_scores_by_definition(spark, make):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    model = quality.learn(docs, labels)
    texts = [r.text or "" for r in docs.orderBy("doc_id").limit(40).collect()] + [t or "" for _, t in ODD]
    got = quality.score(make([(i, t) for i, t in enumerate(texts)]), model).collect()
    assert len(got) == len(texts)
    for r in got:
        assert abs(naive_quality(model, texts[r.doc_id]) - r.score) < 1e-4


def test_quality_held_out(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    scored = quality.score(docs, quality.learn(docs, labels))
    assert scored.count() == docs.count()
    held = [r for r in scored.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = sum((r.score >= quality.THRESHOLD) == bool(r.quality) for r in held)
    assert right >= 0.95 * len(held)
    assert sum(r.score >= quality.THRESHOLD for r in held if r.quality) >= 0.97 * sum(r.quality for r in held)


def test_quality_odd_rows(spark, make):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = make([(i, "plain words here " * 5 if i % 2 else "BAD!! WORSE!! " * 9) for i in range(40)])
    model = quality.learn(docs, labels)
    scores = {r.doc_id: r.score for r in quality.score(make(ODD), model).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[1] == scores[2] == scores[3]
    assert quality.learn(docs, labels.limit(0)).constant == 0.5
    assert quality.learn(docs, labels.limit(0)).predict(["a"], {})[0] == 0.5
    assert quality.score(make([]), model).count() == 0
    assert quality.keep_good(docs, model).count() == 20


@pytest.mark.parametrize("n,top", [(0, 0), (1, 7), (500, 3), (500, 10**12)])
def test_elias_fano(n, top):
    values = np.sort(np.random.default_rng(1).integers(0, top + 1, n))
    assert (elias_fano.EliasFano.of(values).at(np.arange(n)) == values).all()


def test_trie_finds_exactly_its_grams():
    rng = np.random.default_rng(2)
    triples = sorted({tuple(x) for x in rng.integers(0, 12, (200, 3)).tolist()})
    pairs = sorted({t[:2] for t in triples} | {t[1:] for t in triples})
    grams = [(np.array(g), np.arange(len(g), dtype=np.uint16)) for g in (pairs, triples)]
    trie = elias_fano.Trie.build(12, grams).mapped()
    for k, known in enumerate((pairs, triples)):
        rows = np.stack(np.meshgrid(*[np.arange(12)] * (k + 2), indexing="ij"), axis=-1).reshape(-1, k + 2)
        at = trie.entry(rows)
        want = {g: i for i, g in enumerate(known)}
        assert [int(trie.levels[k].codes[a]) if a >= 0 else -1 for a in at] == [want.get(tuple(r), -1) for r in rows.tolist()]


def brute_counts(rows, order):
    counts = [Counter() for _ in range(order)]
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            words = [*(t or "").encode().lower().split(), b""]
            for n in range(order):
                counts[n].update(tuple(words[k : k + n + 1]) for k in range(len(words) - n))
    return counts


@pytest.mark.parametrize("order", [2, 3])
def test_lm_against_brute_force(make, order):
    rng = np.random.default_rng(3)
    rows = [(1000 + i, " ".join(rng.choice(["a", "B", "c", "the", "cat", "é"], int(rng.integers(0, 30))))) for i in range(120)] + [x for x in ODD if x[0] != 5]
    got = lm.score(make(rows), order=order, chunk_chars=700).collect()
    assert len(got) == len(rows)
    counts = brute_counts(rows, order)
    n, v = sum(counts[0].values()), len(counts[0])
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)

    def value(text, profile):
        words, total = [*(text or "").encode().lower().split(), b""], 0.0
        for k, w in enumerate(words):
            p = (counts[0][(w,)] + 1) / (n + v + 1)
            for o in range(2, order + 1):
                if k >= o - 1:
                    c, (a, s) = counts[o - 2][tuple(words[k - o + 1 : k])], profile[o - 2]
                    if c:
                        f = a * c / (c + s)
                        p = f * counts[o - 1][tuple(words[k - o + 1 : k + 1])] / c + (1 - f) * p
            total += math.log10(p)
        return total

    def left_out(profile):
        """Log10 likelihood of the training tokens, each without its own occurrence."""
        total = 0.0
        for i, t in rows:
            if zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2:
                continue
            words = [*(t or "").encode().lower().split(), b""]
            for k, w in enumerate(words):
                p = max(counts[0][(w,)], 1) / max(1, n + v)
                for o in range(2, order + 1):
                    if k >= o - 1:
                        c, (a, s) = counts[o - 2][tuple(words[k - o + 1 : k])] - 1, profile[o - 2]
                        f = a * c / (c + s)
                        p = f * max(counts[o - 1][tuple(words[k - o + 1 : k + 1])] - 1, 0) / max(c, 1) + (1 - f) * p
                total += math.log10(p)
        return total

    best = max(lm.PROFILES[order], key=left_out)
    for r in got:
        assert abs(value(texts[r.doc_id], best) - r.score) < 4e-4 * max(1, r.n_tokens)
    for r in got:
        words = [*(texts[r.doc_id] or "").encode().lower().split(), b""]
        assert r.n_tokens == len(words) and r.train_tokens == n
        assert r.n_known == sum(counts[0][(w,)] > 0 for w in words)
        assert abs(r.base_score - sum(math.log10((counts[0][(w,)] + 1) / (n + v + 1)) for w in words)) < 1e-8
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2)


@pytest.mark.parametrize("n,top", [(0, 0), (1, 7), (500, 3), (500, 2**63), (3, 2**64 - 1)])
def test_sorted_numbers_round_trip(n, top):
    values = np.sort(np.random.default_rng(1).integers(0, top, n, dtype=np.uint64, endpoint=True))
    blob = b"xy" + elias_fano.pack_sorted(values) + b"z"
    got, end = elias_fano.unpack_sorted(blob, 2)
    assert (got == values).all() and blob[end:] == b"z"
    counts = np.array([0, 1, 254, 255, 256, 2**40])
    assert lm._unpack_counts(b"q" + lm._pack_counts(counts), 1, 6)[0].tolist() == counts.tolist()


def test_lm_sends_only_blocks_with_ngrams():
    docs = __import__("pandas").DataFrame({"text": ["a b c", "a b d"], "held_out": [False, True]})
    sent = lm._send((3,), docs, 100_000, 3, 40)
    assert len(sent) <= 5 + 5 + 4 and sent["bucket"].is_unique  # words and ends, pairs, triples
    read = [lm._read(b, 3) for b in sent["blob"]]
    assert [sum(len(r[k][0]) for r in read) for k in range(3)] == [5, 5, 4]
    assert [sum(int(r[k][1].sum()) for r in read) for k in range(3)] == [4, 3, 2]


def test_lm_repeated_rows_are_spread(spark, make, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.range(3000).select(F.lit(8).cast("long").alias("doc_id"), F.lit("the same words again and again").alias("text"))
    got = lm.score(docs, chunk_chars=5000)
    assert got.count() == 3000 and got.select("score", "base_score", "train_tokens").distinct().count() == 1
    assert got.first().train_tokens == 3000 * 7 * (zlib.crc32(b"8") % 7 != 2)


def test_trie_in_a_file(tmp_path):
    rows = np.array([[0, 1], [0, 2], [2, 0]])
    trie = elias_fano.Trie.build(3, [(rows, np.array([5, 6, 7], dtype=np.uint16))]).mapped(str(tmp_path / "trie"))
    assert trie.levels[0].codes[trie.entry(rows)].tolist() == [5, 6, 7] and (tmp_path / "trie").stat().st_size > 0
    assert trie.entry(np.array([[1, 1], [2, 2], [0, 0]])).tolist() == [-1] * 3


def test_lm_empty(make):
    assert lm.score(make([])).count() == 0


def test_lm_query_uses_trigrams(spark, make, tmp_path):
    rows = [(i, " ".join(["a b c", "x b d"][(i + k) % 2] for k in range(12))) for i in range(60)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in queries.op10_lm(spark, str(tmp_path)).collect()}
    best = {order: {r.doc_id: r.score for r in lm.score(make(rows), order=order).collect()} for order in (2, 3)}
    assert got == pytest.approx(best[3]) and sum(got.values()) > sum(best[2].values()) + 100
