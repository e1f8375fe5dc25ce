"""Extra columns, some named as the operators' own, change nothing and pass through the filtering stages."""

from pyspark.sql import functions as F

from vellumspark.llm import exact_dedup, langid, license_scan, lm, packing, quality, queries, sentencepiece_codec, simhash

CLASHES = ("row", "best", "keep_id", "kept", "group_size", "fp", "key", "component_id", "score", "lang_pred", "chunk", "bucket", "held_out", "bands", "shingles", "draw", "label", "ids", "n", "id", "digest", "rank", "stays", "root", "least", "node", "u", "v", "w", "keys", "text_sha256", "fingerprint", "_digest", "_again", "_kept_id", "_kept_digest", "_stay", "ID_", "Digest_")


def test_clashing_columns(spark, make):
    rows = [(1, "the cat and the dog"), (2, "THE cat and the dog"), (3, None), (4, "der hund und die katze. Released under the MIT License.")]
    plain = make(rows)
    more = plain.withColumns({c: F.lit("x") for c in CLASHES})
    model = langid.fit(["the cat and the dog", "der hund und die katze"] * 3, ["en", "de"] * 3)
    good = quality.Model(constant=1.0)
    bpe, piece = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
    applied = (
        exact_dedup.exact_dedup,
        simhash.near_duplicates,
        lambda d: langid.identify(d, model),
        lambda d: quality.score(d, good),
        lambda d: sentencepiece_codec.encode_decode(d, piece),
        lambda d: packing.pack(d, bpe).drop("sequence_id", "offset"),
        lambda d: license_scan.scan(d, license_scan.template_table(spark)),
        lm.score,
    )
    for f in applied:
        a, b = f(plain), f(more)
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    for f in (exact_dedup.keep_first_copies, simhash.keep_one_of_each_group, lambda d: langid.keep_identified(d, model), lambda d: quality.keep_good(d, good)):
        got = f(more)
        assert got.columns == more.columns
        assert {r.doc_id for r in got.collect()} == {r.doc_id for r in f(plain).collect()}
        assert {r["fp"] for r in got.collect()} == {"x"} and {r["_digest"] for r in got.collect()} == {"x"}
