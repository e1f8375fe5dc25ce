"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Each word, and each word shape (letters, digits and signs with runs made one), has a sparse random index
vector drawn from its hash. A word's vector is the sum of the index vectors of its neighbours in the
learning sample; words rare there take their shape's vector. A document is the mean of its words' and
shapes' vectors with its length. The network has one hidden layer; its logit is divided by a temperature
fitted on a fifth of the sample that the weights did not see.

Learning collects at most ``max_labelled`` labelled documents, drawn by a hash of the id, outside the held-out
remainder of crc32(doc_id), one text of each id, none over ``max_text_bytes``. No text is shortened, and all are
scored whole.

Defined cases: null and empty texts get the score of a document without words; a document with several
labels counts by their mean; with no labels, or one kind only, every score is the share of label 1 (0.5 if
none), and filtering by a constant under the threshold raises ValueError rather than drop a whole corpus; of
rows that share a labelled id the text of the least hash is learned from; repeated rows are scored each; an
empty table gives an empty result; extra columns are ignored, whatever their names, and the filtering form
passes them on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import crc_remainder, pieces, text_or_empty

SIZE, MARKS, WINDOW, HIDDEN = 64, 8, 2, 32
THRESHOLD = 0.7
CACHE_WORDS = 100_000
_RUNS = re.compile(r"(.)\1+", re.S)
_SHAPES = str.maketrans({**{chr(c): "A" for c in range(65, 91)}, **{chr(c): "a" for c in range(97, 123)}, **{chr(c): "0" for c in range(48, 58)}})


def shape(word: str) -> str:
    """The kinds of a word's characters in order, runs made one, eight at most."""
    marks = word.translate(_SHAPES)
    if not marks.isascii():
        marks = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in marks)
    return _RUNS.sub(r"\1", marks)[:8]


def index_vector(name: str) -> np.ndarray:
    """A sparse vector of MARKS entries +1 or -1 at places drawn from the name's hash."""
    h = xxhash.xxh3_128_intdigest(name)
    out = np.zeros(SIZE, dtype=np.float32)
    for _ in range(MARKS):
        out[h % SIZE] += 1 if h >> 7 & 1 else -1
        h >>= 14
    return out


def context_vectors(sequences: list[np.ndarray], index: np.ndarray) -> np.ndarray:
    """For each unit the normalised sum of the index vectors of its neighbours, and its own."""
    total = index.copy()
    for seq in sequences:
        for step in range(1, WINDOW + 1):
            if len(seq) <= step:
                continue
            centre, near = np.concatenate((seq[:-step], seq[step:])), np.concatenate((seq[step:], seq[:-step]))
            order = np.argsort(centre, kind="stable")
            own, first = np.unique(centre[order], return_index=True)
            for a in range(0, len(own), 4096):
                lo, hi = first[a], first[a + 4096] if a + 4096 < len(first) else len(order)
                total[own[a : a + 4096]] += np.add.reduceat(index[near[order[lo:hi]]], first[a : a + 4096] - lo, axis=0)
    return total / np.maximum(1e-6, np.linalg.norm(total, axis=1, keepdims=True))


@dataclass
class Model:
    words: dict[str, int] = field(default_factory=dict)
    shapes: dict[str, int] = field(default_factory=dict)  # 0 is any other
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, SIZE), dtype=np.float32))  # shapes, then words
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0
    constant: float | None = None

    def codes(self, words: list[str], cache: dict[str, int]) -> np.ndarray:
        """Unit and shape number of each word, packed in one number."""
        got = list(map(cache.get, words))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    w = words[i]
                    s = self.shapes.get(shape(w), 0)
                    got[i] = cache[w] = self.words.get(w, s) << 16 | s
            if len(cache) > CACHE_WORDS:
                cache.clear()
        return np.array(got, dtype=np.int64)

    def pooled(self, text: str, cache: dict[str, int]) -> np.ndarray:
        words = text.split()
        out = np.zeros(2 * SIZE + 2, dtype=np.float32)
        if words:
            codes = self.codes(words, cache)
            for i in range(0, len(codes), 65536):
                part = codes[i : i + 65536]
                out[:SIZE] += self.vectors[part >> 16].sum(axis=0)
                out[SIZE : 2 * SIZE] += self.vectors[part & 0xFFFF].sum(axis=0)
            out /= len(words)
            out[-2] = np.log1p(len(words))
        else:
            out[-1] = 1
        return out

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(0, (features - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def predict(self, texts: list[str], cache: dict[str, int]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if not texts:
            return np.zeros(0)
        z = self.logits(np.stack([self.pooled(t, cache) for t in texts]).astype(np.float64)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _train(x: np.ndarray, y: np.ndarray, rounds: int = 400, decay: float = 1e-3) -> tuple[np.ndarray, ...]:
    """Adam on the whole sample, cross-entropy."""
    rng = np.random.default_rng(7)
    layers = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for t in range(1, rounds + 1):
        hidden = np.maximum(0, x @ layers[0] + layers[1])
        error = (1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -40, 40))) - y) / len(y)
        back = np.outer(error, layers[2]) * (hidden > 0)
        for k, g in enumerate((x.T @ back + decay * layers[0], back.sum(axis=0), hidden.T @ error + decay * layers[2], error.sum())):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            layers[k] = layers[k] - 0.01 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return tuple(layers)


def fit(texts: list[str], labels: list[float], max_words: int = 20_000) -> Model:
    """Word vectors, network and temperature from labelled texts, given in an order drawn by hash."""
    y = np.array(labels, dtype=np.float64)
    if len(set(y >= 0.5)) < 2:
        return Model(constant=float(y.mean()) if len(y) else 0.5)
    split = [t.split() for t in texts]
    found = Counter(w for ws in split for w in ws)
    kinds = Counter()
    for w, n in found.items():
        kinds[shape(w)] += n
    shapes = {s: i + 1 for i, (s, n) in enumerate(sorted(kinds.items(), key=lambda x: (-x[1], x[0]))[:2000]) if n > 1}
    words = [w for w, n in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:max_words] if n >= 8]
    base = max(shapes.values(), default=0) + 1
    model = Model({w: base + i for i, w in enumerate(words)}, shapes)
    names = ["other", *shapes, *words]
    index = np.stack([index_vector(("word " if i >= base else "shape ") + n) for i, n in enumerate(names)])
    cache: dict[str, int] = {}
    codes = [model.codes(ws, cache) if ws else np.zeros(0, dtype=np.int64) for ws in split]
    del split
    context = context_vectors([c >> 16 for c in codes] + [c & 0xFFFF for c in codes], index)
    model.vectors = (context + index / np.sqrt(MARKS)).astype(np.float32)
    x = np.stack([model.pooled(t, cache) for t in texts]).astype(np.float64)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 0.01
    z = (x - model.mean) / model.scale
    unseen = np.arange(len(y)) % 5 == 0
    if len(set(y[~unseen] >= 0.5)) == 2 and unseen.any():
        model.layers = _train(z[~unseen], y[~unseen])
        logits = model.logits(x[unseen])
        grid = np.geomspace(0.5, 8, 33)
        loss = [np.mean(np.logaddexp(0, logits / t) - y[unseen] * logits / t) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    model.layers = _train(z, y)
    return model


def learn(docs: DataFrame, labels: DataFrame, fold: int = 4, held_out: int = 2, max_labelled: int = 3000, max_text_bytes: int = 1 << 20) -> Model:
    """Fits on a bounded hash sample of the labelled rows; the sample's ids are broadcast to the documents."""
    usable = labels.filter(labels["quality"].isNotNull() & labels["doc_id"].isNotNull() & (crc_remainder(labels["doc_id"], fold) != held_out))
    marked = usable.groupBy(usable["doc_id"].alias("labelled")).agg(F.avg("quality").alias("label")).withColumn("draw", F.xxhash64("labelled"))
    sample = marked.orderBy("draw", "labelled").limit(max_labelled)
    text = text_or_empty(docs)
    given = docs.filter(F.octet_length(text) <= max_text_bytes).select(docs["doc_id"].alias("doc_id"), text.alias("text"))
    found = given.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled")).groupBy("draw", "doc_id").agg(F.max("label").alias("label"), F.min(F.struct(F.xxhash64("text"), "text")).alias("least"))
    rows = found.select("draw", "doc_id", "label", "least.text").collect()
    rows.sort(key=lambda r: (r["draw"], r["doc_id"]))
    return fit([r["text"] for r in rows], [r["label"] for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for every row; the model (under 8 MB) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in pieces(it):
            scores = shared.value.predict(batch.column("text").to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text")).mapInArrow(batches, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows scored at the threshold or over, with all their columns."""
    if model.constant is not None and model.constant < threshold and not docs.isEmpty():
        raise ValueError("no labels of both kinds to learn from: a constant score would drop every document")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in pieces(it):
            scores = shared.value.predict([t or "" for t in batch.column("text").to_pylist()], cache)
            yield batch.filter(pa.array(scores >= threshold, pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
