"""Language identification with a blended-spectrum string kernel.

A text is the set of its character n-grams of lengths 1 to 3 (letters in lower case, runs of anything else
one space). The kernel of two texts is the number of n-grams they share over the geometric mean of their
numbers of n-grams. Landmark texts give Nyström features; one-versus-rest kernel ridge regression is solved
on them. Since the kernel against the landmarks is a product of presence vectors, landmarks and regression
weights fold into one matrix (n-gram by language); texts are scored in blocks, each by the product of the
block's presence matrix with it.

Learning collects at most ``per_lang`` texts of each language, drawn by a hash of id and text, copies once, of
which the first ``landmarks`` per language are landmarks; of a language column with more than ``max_langs``
values only the most frequent are learned. Texts over ``max_text_bytes`` are not learned from; none is
shortened, and all are scored whole.

Defined cases: a null text or one without a letter is ``und`` with score 0; a null language isn't learned
from; equal scores go to the language first by name; with no learnable language (as in an empty table) all
texts are ``und``; an empty table gives an empty result; repeated rows are scored each, rows that share an id
are drawn each by their text; extra columns are ignored, whatever their names, and the filtering form passes
them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.llm.common import crc_remainder, pieces

UNKNOWN = "und"
SHARPNESS = 8.0
BLOCK_BYTES = 16 << 20  # of a presence matrix


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str) -> np.ndarray:
    """Sorted distinct n-grams of lengths 1 to 3, each packed in 63 bits; empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    letter = _is_letter()[codes]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    codes = np.where(letter, codes, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    codes = codes[keep]
    codes = np.concatenate(([32], codes, [32]))
    two = codes[:-1] << 21 | codes[1:]
    return np.unique(np.concatenate((codes, two, two[:-1] << 21 | codes[2:])))


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # sorted n-grams of the landmarks
    weights: np.ndarray  # n-gram by language
    bias: np.ndarray

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """Decision values, one row per text: presence matrix times folded weights, over the texts' norms."""
        rows = max(1, BLOCK_BYTES // (4 * max(1, len(self.vocabulary))))
        weights = self.weights.astype(np.float32)
        parts = [_presence(sets[i : i + rows], self.vocabulary) @ weights for i in range(0, len(sets), rows)]
        norms = np.sqrt([max(1, len(s)) for s in sets])
        return np.concatenate(parts).astype(np.float64) / norms[:, None] + self.bias if parts else np.zeros((0, len(self.languages)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        sets = [grams(t) if t else np.zeros(0, dtype=np.int64) for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        values = SHARPNESS * self.scores(sets)
        values = np.exp(values - values.max(axis=1, keepdims=True))
        values /= values.sum(axis=1, keepdims=True)
        best = values.argmax(axis=1)
        none = np.array([len(s) == 0 for s in sets], dtype=bool)
        return [UNKNOWN if n else self.languages[b] for b, n in zip(best, none)], np.where(none, 0.0, values[np.arange(len(sets)), best])


def _presence(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    """1 where a text (row) holds an n-gram (column)."""
    out = np.zeros((len(sets), len(vocabulary)), dtype=np.float32)
    if not len(vocabulary) or not sets:
        return out
    every, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.searchsorted(vocabulary, every)
    at[at == len(vocabulary)] = 0
    known = vocabulary[at] == every
    out[rows[known], at[known]] = 1
    return out


def fit(texts: list[str], langs: list[str], landmarks: int = 40, ridge: float = 1e-3) -> Model:
    """Nyström features of the sample and a ridge solution per language."""
    sets = [grams(t) for t in texts]
    used = [i for i, s in enumerate(sets) if len(s)]
    sets, langs = [sets[i] for i in used], [langs[i] for i in used]
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros(0, dtype=np.int64), np.zeros((0, 0)), np.zeros(0))
    marks = [i for n in names for i in [k for k, x in enumerate(langs) if x == n][:landmarks]]
    vocabulary = np.unique(np.concatenate([sets[i] for i in marks]))
    size = np.sqrt([len(s) for s in sets])
    base = _presence([sets[i] for i in marks], vocabulary) / size[marks][:, None].astype(np.float32)
    kernel = np.concatenate([_presence(sets[i : i + 128], vocabulary) @ base.T for i in range(0, len(sets), 128)]).astype(np.float64) / size[:, None]
    values, vectors = np.linalg.eigh(kernel[marks] @ np.eye(len(marks)))
    inverse = np.where(values > 1e-8 * values.max(), 1 / np.sqrt(np.maximum(values, 1e-12)), 0)
    root = vectors * inverse @ vectors.T
    features = kernel @ root
    target = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = np.array([1 / langs.count(x) for x in langs])
    weight = weight / weight.mean()
    mean, shift = np.average(features, axis=0, weights=weight), np.average(target, axis=0, weights=weight)
    centred = features - mean
    solved = np.linalg.solve(centred.T @ (centred * weight[:, None]) + ridge * len(sets) * np.eye(len(marks)), centred.T @ ((target - shift) * weight[:, None]))
    return Model(names, vocabulary, base.T.astype(np.float64) @ (root @ solved), shift - mean @ solved)


def learn(docs: DataFrame, fold: int = 5, held_out: int = 0, per_lang: int = 300, landmarks: int = 40, max_langs: int = 200, max_text_bytes: int = 1 << 20) -> Model:
    """Fits on a bounded hash sample of the texts with a language, outside the held-out remainder of crc32(doc_id)."""
    usable = docs["lang"].isNotNull() & docs["text"].isNotNull() & (crc_remainder(docs["doc_id"], fold) != held_out)
    known = docs.filter(usable & (F.octet_length(docs["text"]) <= max_text_bytes))
    known = known.select(docs["text"].alias("text"), docs["lang"].alias("lang"), F.pmod(F.xxhash64(docs["doc_id"], docs["text"]), F.lit(1 << 40)).alias("draw"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    if not counts:
        return fit([], [])
    limits = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(int(min(1.0, 2 * per_lang / r["count"]) * (1 << 40))))])
    drawn = known.filter(F.col("draw") < F.try_element_at(limits, "lang")).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("draw")
    rows = drawn.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_lang).collect()
    rows.sort(key=lambda r: (r["draw"], r["lang"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], landmarks)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row; the model (under 2 MB for a few languages) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(it):
            langs, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(batches, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.0) -> DataFrame:
    """The rows whose language is identified with at least the given score, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(it):
            langs, scores = shared.value.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([x != UNKNOWN and s >= least_score for x, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
