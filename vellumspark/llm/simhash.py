"""SimHash near duplicates through Golay-code fuzzy hashing.

Fingerprints of 64 bits link at two or fewer differing bits. They are cut into three segments (22, 21 and
21 bits). With at most two errors one segment is free of errors, and its partner segment has at most two,
so the two fingerprints share the key (clean segment, Golay index of the partner) for one of the three
pairings. Distinct fingerprints are joined on these keys and each pair is verified by counting bits.

A key with more than ``bucket_pairs`` fingerprints is not expanded into pairs. Its members are linked
exactly by another way: each is written with its 64 one-bit neighbours, and two fingerprints share such a
neighbour (or one is it) exactly when they differ in at most two bits. Work there is linear.

Defined cases: null and empty texts and texts of white space have fingerprint zero and link like any
other; fewer words than a shingle make one shingle; repeated rows share fingerprint and component; a null
id never names a component unless all its members have none; rows that share an id but not a text each have
their own component; texts of any length are read whole; extra columns are ignored, whatever their names, and
the filtering form passes them on; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm import golay
from vellumspark.llm.common import cut, pieces, text_digest, text_or_empty, without
from vellumspark.operators.graph import connected_components

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str, words_per_shingle: int = 3) -> int:
    """Majority bits of the XXH64 hashes of all shingles, as an unsigned number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - words_per_shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()][:n]
    stops = (ends - 1).tolist()[-n:]
    h64 = xxhash.xxh64_intdigest
    hashes = np.array([h64(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(found)], ["doc_id", "digest", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, digest (32 bytes of the text, if asked for, else null), fp (the fingerprint as a signed long)."""
    text = text_or_empty(docs, text_col)
    given = docs.select(docs[id_col].cast("long").alias("doc_id"), (text_digest(text) if digest else F.lit(None).cast("binary")).alias("digest"), text.alias("text"))
    return given.mapInArrow(_fingerprint_batches, "doc_id long, digest binary, fp long")


def segment_keys(fps: np.ndarray) -> np.ndarray:
    """For each fingerprint 18 keys: pairing, clean segment, Golay index of the partner segment."""
    fps = fps.view(np.uint64)
    parts = [(fps >> np.uint64(at)) & np.uint64((1 << width) - 1) for at, width in SEGMENTS]
    out = []
    for i in range(3):
        near = golay.keys(parts[(i + 1) % 3]).astype(np.uint64)
        out.append((np.uint64(i) << np.uint64(34)) | (parts[i][:, None] << np.uint64(12)) | near)
    return np.concatenate(out, axis=1).view(np.int64)


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(fps):
            continue
        keys = np.sort(segment_keys(fps), axis=1)
        new = np.ones(keys.shape, dtype=bool)
        new[:, 1:] = keys[:, 1:] != keys[:, :-1]
        yield pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array(np.repeat(fps, new.sum(axis=1)))], ["key", "fp"])


def links(fps: DataFrame, bucket_pairs: int = 64) -> DataFrame:
    """u, v: links between distinct fingerprints, enough to connect all that differ in two bits or fewer."""
    keyed = cut(fps.mapInArrow(_key_batches, "key long, fp long"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(keyed.join(sizes, "key"))
    small = shared.filter(F.col("n") <= bucket_pairs)
    left, right = small.select("key", F.col("fp").alias("u")), small.select(F.col("key").alias("same"), F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2
    pairs = left.join(right, (F.col("key") == F.col("same")) & (F.col("u") < F.col("v")) & near).select("u", "v")
    hot = shared.filter(F.col("n") > bucket_pairs).select("fp").distinct()
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    balls = hot.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("w"))
    centre = balls.groupBy("w").agg(F.min("fp").alias("u"), F.count("*").alias("n")).filter("n > 1").select("w", "u")
    starred = balls.join(centre, "w").filter("fp <> u").select("u", F.col("fp").alias("v"))
    return pairs.unionByName(starred).distinct()


def classes(fps: DataFrame, bucket_pairs: int = 64) -> DataFrame:
    """fp, root: for each distinct fingerprint of a cut table (fp) the smallest fingerprint reachable."""
    roots = connected_components(links(fps, bucket_pairs=bucket_pairs))
    return fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_pairs: int = 64) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    marked = cut(fingerprints(docs, id_col, text_col).select("doc_id", "fp"))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = distinct.join(classes(distinct.select("fp"), bucket_pairs), "fp")
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(of_root, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each_group(docs: DataFrame, bucket_pairs: int = 64) -> DataFrame:
    """The document with the smallest id of each component, with all its columns; of repeated rows one stays.

    Rows are told apart by id and text, so of rows that share the smallest id, one for each component stays.
    Documents without an id can't be told apart by it, so all of them stay.
    """
    marked = cut(fingerprints(docs, digest=True).filter("doc_id IS NOT NULL").groupBy("fp", F.col("doc_id").alias("id"), "digest").agg(F.count("*").alias("n")))
    distinct = cut(marked.select("fp").distinct())
    grouped = marked.join(classes(distinct, bucket_pairs), "fp")
    best = grouped.groupBy("root").agg(F.min(F.struct("id", "digest")).alias("best"), F.count("*").alias("keys"))
    several = cut(grouped.join(best.filter("keys > 1"), "root").filter(F.struct("id", "digest") != F.col("best")).select("id", "digest"))
    again = marked.filter("n > 1").select("id", "digest")
    return without(docs, text_digest(text_or_empty(docs)), several, cut(again.join(several, ["id", "digest"], "left_anti")))
