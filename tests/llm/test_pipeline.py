import hashlib
import struct
import zlib

import tokenizers

import corpus_pipeline
from vellumspark.llm import exact_dedup, langid, packing, quality, queries, simhash
from vellumspark.session import table

FOLDER = "/root/testdata/sf0.01"
LOWERED = {c: c + 32 for c in range(65, 91)}


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "exact_dedup", "near_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, FOLDER).cache()
        if name != "packing":
            assert docs.columns == columns and docs.count() <= before.count()
        if name == "exact_dedup":
            want = {r.doc_id for r in exact_dedup.exact_dedup(before).filter("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "near_dedup":
            near = simhash.near_duplicates(before).collect()
            assert {r.doc_id for r in docs.collect()} == {r.component_id for r in near}
        if name == "packing":
            assert docs.dtypes == [tuple(c.replace("long", "bigint").split()) for c in packing.SCHEMA.split(", ")]
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in before.collect()}


def folder_of(spark, tmp_path, rows):
    """Documents (with clashing extra columns) and labels as a data folder."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, digest string, _stay long"
    full = [(i, t, lang, "s", None if t is None else len(t), "x", f"d{n}", n) for n, (i, t, lang) in enumerate(rows)]
    spark.createDataFrame(full, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, FOLDER, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def roots(fps):
    """The first of each group of fingerprints that two bits or fewer link, by comparing all."""
    root = list(range(len(fps)))
    moved = True
    while moved:
        moved = False
        for i, a in enumerate(fps):
            near = min(root[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 2)
            if near < root[i]:
                root[i], moved = near, True
    return root


def test_run_by_brute_force(spark, tmp_path):
    """Every stage on nulls, empty and long texts, copies, near copies, shared ids, repeated rows and clashing columns."""
    base = [(r.doc_id, r.text, r.lang) for r in table(spark, FOLDER, "documents").orderBy("doc_id").limit(300).collect()]
    long = max((t for _, t, _ in base if t), key=len)
    copies = [(10_000 + n, t.upper(), lang) for n, (_, t, lang) in enumerate(base[:40])] + [(11_000 + n, t + " end", lang) for n, (_, t, lang) in enumerate(base[20:60])]
    odd = [(None, base[5][1], "en"), (base[7][0], base[8][1] + " other words", "en"), (12_000, None, None), (12_001, "", "en"), (12_002, "12 34 !", None), (12_003, " ".join([long] * 20), "en"), (None, None, None)]
    sf = folder_of(spark, tmp_path, base + copies + odd + base[:10] + odd[-3:])
    docs = table(spark, sf, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)

    def key(r):
        return (r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None, r.digest)

    def rows(df):
        return sorted(df.collect(), key=key)

    def written(name, df):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    model = langid.learn(docs)
    identified = written("language", stages["language"](spark, docs, sf))
    assert identified.columns == columns
    want = [r for r in rows(docs) if model.predict([r.text])[0][0] != langid.UNKNOWN]
    assert rows(identified) == want and 0 < len(want) < docs.count()

    judge = quality.learn(identified, table(spark, sf, "labels"))
    good = written("quality", stages["quality"](spark, identified, sf))
    want = [r for r in rows(identified) if judge.predict([r.text or ""], {})[0] >= quality.THRESHOLD]
    assert rows(good) == want and 0 < len(want) < identified.count()

    # of equal texts the largest id stays, and one of its repeated rows
    once = written("exact", stages["exact_dedup"](spark, good, sf))
    groups = {}
    for r in rows(good):
        groups.setdefault((r.text or "").translate(LOWERED), []).append(-1 if r.doc_id is None else r.doc_id)
    assert sorted((r.text.translate(LOWERED), -1 if r.doc_id is None else r.doc_id) for r in once.collect()) == sorted((t, max(ids)) for t, ids in groups.items())
    assert {tuple(r) for r in once.collect()} <= {tuple(r) for r in good.collect()} and len(groups) < good.count()

    # of each component the smallest id stays (and then the smallest digest); what has no id stays
    apart = written("near", stages["near_dedup"](spark, once, sf))
    known = sorted((r for r in once.collect() if r.doc_id is not None), key=lambda r: (r.doc_id, hashlib.sha256(r.text.encode()).digest()))
    found = roots([simhash.fingerprint(r.text) for r in known])
    want = [r for i, r in enumerate(known) if found[i] == i] + [r for r in once.collect() if r.doc_id is None]
    assert rows(apart) == sorted(want, key=key) and len(want) < once.count()

    tokenizer = tokenizers.Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    ids = sorted((-1 if r.doc_id is None else r.doc_id, [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0]) for r in apart.collect())
    pieces = sorted(stages["packing"](spark, apart, sf).collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.doc_tokens, r.start))
    assert {(i, len(x)) for i, x in ids} == {(-1 if r.doc_id is None else r.doc_id, r.doc_tokens) for r in pieces}
    assert sum(r.length for r in pieces) == sum(len(x) for _, x in ids)
    crcs = {(i, len(x), at, n): zlib.crc32(struct.pack(f"<{n}I", *x[at : at + n])) for i, x in ids for at, n in {(r.start, r.length) for r in pieces if r.doc_id == i or i == -1} if at + n <= len(x)}
    assert all(crcs[(-1 if r.doc_id is None else r.doc_id, r.doc_tokens, r.start, r.length)] == r.ids_crc32 for r in pieces)

    whole = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_tokens, r.start, r.length, r.ids_crc32) for r in whole.collect() if r.start == 0 and r.length == r.doc_tokens) and sum(r.length for r in whole.collect()) == sum(r.length for r in pieces)


def test_run_on_an_empty_table(spark, tmp_path):
    got = corpus_pipeline.run(spark, folder_of(spark, tmp_path, []))
    assert got.count() == 0 and "sequence_id" in got.columns
