"""Language-model scoring with an Elias-Fano n-gram trie.

Tokens are words of the text in lower case (A-Z), then one end. The model interpolates relative frequencies
of the longer orders (2 and 3, or 2 alone) with the add-one unigram model. Counts are taken over all training
documents; they are exact but for n-grams whose hashed keys meet: words have 64 bits, longer n-grams 13 bits
more than the corpus has characters (40 at least), so that about one foreign n-gram in 50,000 is taken for a
known one, whatever the size.

Rows are dealt by their number into chunks of about ``chunk_chars`` characters. A chunk writes its distinct
n-grams, with its own training counts, as sorted blocks, one per bucket of the key space that it has any in: the
keys in Elias-Fano form, about 3 bytes each, the counts one byte. A bucket adds up the counts of all chunks and
sends back to each chunk what the other chunks add to just its n-grams, in the same order. A hot word is one
entry per chunk there, and repeated rows are spread, so no key is heavy; there are as many buckets as chunks, so
chunk, bucket and trie have a bounded size whatever the corpus's, and rows sent are at most the n-grams.

From the answers a chunk builds a trie of the n-grams its documents can ask for: Elias-Fano pointers and
context-relative successor ids, smoothed probabilities and backoff weights quantised to 16 bits on a log scale,
all in one mapped file (in memory, so that nothing stays behind on an executor). All its documents are scored
by successor search in that: the longest n-gram found gives the probability, shorter ones are weighted by the
backoffs of the contexts passed.

How far to trust the longer contexts is chosen among the few ``PROFILES`` by the likelihood of the training
tokens with their own occurrence left out, summed over the whole corpus; one profile is the unigram model.

Defined cases: a null text counts as empty, one end token; a null id belongs to the remainder of the empty
text; repeated rows count and are scored each; texts of any length are scored whole; with no training token
every word is unknown; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import crc_remainder, cut, text_or_empty
from vellumspark.llm.elias_fano import Level, Trie, pack_sorted, unpack_sorted

#: Weight of a longer context seen c times: a * c / (c + s), for orders 2 and 3.
WEIGHTS = {2: ((0.0, 1.0), (0.15, 8.0), (0.35, 4.0), (0.6, 2.0), (0.85, 1.0)), 3: ((0.0, 1.0), (0.5, 1.0), (0.9, 0.5))}
PROFILES = {2: [(x, (0.0, 1.0)) for x in WEIGHTS[2]], 3: list(itertools.product(WEIGHTS[2], WEIGHTS[3]))}
STEPS = 1200  # quantisation steps per factor of two
END = b""
LEAST_BITS, MORE_BITS = 40, 13
SENT = "chunk int, bucket int, blob binary"
ANSWER = "chunk int, blob binary, bucket int"
SCORED = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, scores array<double>, left_out array<double>"


def key_bits(chars: int) -> int:
    """Bits of the keys of n-grams of order 2 and up in a corpus of so many characters."""
    return min(64, max(LEAST_BITS, chars.bit_length() + MORE_BITS))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """A chunk's tokens, its distinct n-grams of orders 1 to 2 or 3, their keys and their counts in its training documents."""

    def __init__(self, texts: list[str], held: np.ndarray, order: int) -> None:
        numbers: dict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        end = numbers[END]
        parts, lengths = [], []
        for t in texts:
            ids = list(map(numbers.__getitem__, t.encode("utf-8", "surrogatepass").lower().split()))
            ids.append(end)
            parts.append(np.array(ids, dtype=np.int32))
            lengths.append(len(ids))
        self.tokens = t = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        self.lengths = np.array(lengths, dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(~held, self.lengths)
        self.words = len(numbers)
        h = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), dtype=np.uint64, count=self.words)
        del numbers, parts
        self.keys, self.counts, self.of_token = [h], [np.bincount(t[self.train], minlength=self.words)], [t]
        inside = np.ones(len(t), dtype=bool)  # tokens with one token before them
        inside[self.starts] = False
        place = np.flatnonzero(inside)
        pair, inverse = np.unique(t[place - 1].astype(np.int64) * self.words + t[place], return_inverse=True)
        self.first, self.second = (pair // self.words).astype(np.int32), (pair % self.words).astype(np.int32)
        self._order(_mix(h[self.first] * np.uint64(0x9E3779B97F4A7C15) + h[self.second]), place, inverse)
        if order < 3:
            return
        of_pair = self.of_token[1]
        inside[self.starts[self.lengths > 1] + 1] = False
        place = np.flatnonzero(inside)
        triple, inverse = np.unique(of_pair[place - 1].astype(np.int64) * self.words + t[place], return_inverse=True)
        self.front = (triple // self.words).astype(np.int32)
        self.back = np.zeros(len(triple), dtype=np.int32)  # the pair without the first word
        self.back[inverse] = of_pair[place]
        self._order(_mix(self.keys[1][self.front] * np.uint64(0xD6E8FEB86659FD93) + h[self.second[self.back]]), place, inverse)

    def _order(self, keys: np.ndarray, place: np.ndarray, inverse: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(np.bincount(inverse[self.train[place]], minlength=len(keys)))
        of = np.full(len(self.tokens), -1, dtype=np.int32)
        of[place] = inverse
        self.of_token.append(of)

    def sorted_keys(self, order: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, their counts, and for each n-gram the place of its key."""
        keys = self.keys[order - 1] if order == 1 else self.keys[order - 1] >> np.uint64(64 - bits)
        by = np.argsort(keys)
        keys = keys[by]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        place = np.empty(len(keys), dtype=np.int32)
        place[by] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        counts = np.add.reduceat(self.counts[order - 1][by], at) if len(at) else np.zeros(0, dtype=np.int64)
        return keys[at], counts, place


def _bucket(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Ranges of the key space, by the upper 32 bits."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)


def _begin(bucket: int, bits: int, buckets: int) -> int:
    return -(-(bucket << 32) // buckets) << (bits - 32)


def _pack_counts(counts: np.ndarray) -> bytes:
    """A byte each; larger ones stand after all bytes."""
    large = counts[counts >= 255]
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype("<u8").tobytes()


def _unpack_counts(blob: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    counts = np.frombuffer(blob, np.uint8, n, at).astype(np.int64)
    large = np.flatnonzero(counts == 255)
    counts[large] = np.frombuffer(blob[at + n : at + n + 8 * len(large)], "<u8")
    return counts, at + n + 8 * len(large)


def _send(key: tuple, docs: pd.DataFrame, buckets: int, most: int, bits: int) -> pd.DataFrame:
    grams = Grams(docs["text"].tolist(), docs["held_out"].to_numpy(dtype=bool), most)
    blobs: dict[int, list[bytes]] = {}
    for order in range(1, most + 1):
        width = 64 if order == 1 else bits
        keys, counts, _ = grams.sorted_keys(order, width)
        bucket = _bucket(keys, width, buckets)
        some, cuts = np.unique(bucket, return_index=True)
        for b, lo, hi in zip(some.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
            own = blobs.setdefault(b, [b""] * most)
            own[order - 1] = pack_sorted(keys[lo:hi] - np.uint64(_begin(b, width, buckets))) + _pack_counts(counts[lo:hi])
    none = pack_sorted(np.zeros(0, dtype=np.uint64))
    rows = [(int(key[0]), b, b"".join(x or none for x in own)) for b, own in blobs.items()]
    return pd.DataFrame(rows, columns=["chunk", "bucket", "blob"])


def _read(blob: bytes, orders: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of a block, for orders 1 to ``orders``."""
    at, out = 0, []
    for _ in range(orders):
        keys, at = unpack_sorted(blob, at)
        counts, at = _unpack_counts(blob, at, len(keys))
        out.append((keys, counts))
    return out


def _count_words(key: tuple, sent: pd.DataFrame) -> pd.DataFrame:
    """Training tokens and distinct training tokens of a bucket."""
    read = [_read(b, 1)[0] for b in sent["blob"]]
    counts = np.concatenate([c for _, c in read])
    seen = np.unique(np.concatenate([k for k, _ in read])[counts > 0])
    return pd.DataFrame({"n": [int(counts.sum())], "v": [len(seen)]})


def _add_up(key: tuple, sent: pd.DataFrame, most: int) -> pd.DataFrame:
    """For each chunk's n-grams of a bucket, in the order it sent them, the counts that other chunks add."""
    read = [_read(b, most) for b in sent["blob"]]
    answers = [[] for _ in read]
    for order in range(most):
        keys = np.concatenate([r[order][0] for r in read])
        counts = np.concatenate([r[order][1] for r in read])
        cuts = np.cumsum([0, *[len(r[order][0]) for r in read]])
        for r in read:
            r[order] = None
        by = np.argsort(keys)
        new = np.ones(len(by), dtype=bool)
        keys = keys[by]
        new[1:] = keys[1:] != keys[:-1]
        sums = np.add.reduceat(counts[by], np.flatnonzero(new)) if len(by) else counts
        others = np.empty(len(by), dtype=np.int64)
        others[by] = sums[np.cumsum(new) - 1]
        others -= counts
        for own, a, b in zip(answers, cuts, cuts[1:]):
            own.append(_pack_counts(others[a:b]))
    return pd.DataFrame({"chunk": sent["chunk"].to_numpy(), "blob": [b"".join(x) for x in answers], "bucket": [int(key[0])] * len(read)})


def quantise(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities on a log scale; the error is under 0.03 %."""
    return np.minimum(np.rint(np.log2(p.astype(np.float32, copy=False)) * np.float32(-STEPS)), np.float32(65535)).astype(np.uint16)


def _weight(c: np.ndarray, of: tuple[float, float]) -> np.ndarray:
    return of[0] * c / (c + of[1])


class Model:
    """A chunk's part of the corpus model: the trie of its n-grams that training documents hold."""

    def __init__(self, grams: Grams, totals: list[np.ndarray], n: int, v: int) -> None:
        self.totals, self.order = totals, len(totals)
        one, two = totals[0], totals[1]
        self.unigram = (one + 1) / (n + v + 1)
        keep = np.flatnonzero((two > 0) & (one[grams.first] > 0))
        self.first, self.second, self.pairs = grams.first[keep], grams.second[keep], two[keep]
        levels = [Level.of(grams.words, self.first, self.second)]
        if self.order > 2:
            entry = np.full(len(two), -1, dtype=np.int64)
            entry[keep] = np.arange(len(keep))
            front, back = entry[grams.front], entry[grams.back]
            keep = np.flatnonzero((totals[2] > 0) & (front >= 0) & (back >= 0))
            self.front, self.back, self.triples = front[keep], back[keep], totals[2][keep]
            starts = np.searchsorted(self.first, np.arange(grams.words + 1))
            levels.append(Level.of(len(self.pairs), self.front, self.back - starts[self.first[self.back]]))
            del entry, front, back, starts
        words = np.zeros(grams.words, dtype=np.uint16)
        self.trie = Trie(levels, words, words.copy()).mapped()

        self.ratio2 = np.minimum(1, self.pairs / np.maximum(1, one[self.first])).astype(np.float32)
        if self.order > 2:
            self.ratio3 = np.minimum(1, self.triples / self.pairs[self.front]).astype(np.float32)

    def smooth(self, two: tuple[float, float]) -> None:
        """Writes smoothed probabilities of orders 1 and 2, and the words' backoffs, for the weight of one word of context."""
        w = _weight(self.totals[0].astype(np.float64), two)
        self.trie.codes[:], self.trie.backoffs[:] = quantise(self.unigram), quantise(1 - w)
        own, less = w.astype(np.float32)[self.first], self.unigram.astype(np.float32)[self.second]
        self.level2 = own * (self.ratio2 - less) + less
        self.trie.levels[0].codes[:] = quantise(self.level2)

    def smooth_longer(self, three: tuple[float, float]) -> None:
        """The same for order 3 and the pairs' backoffs."""
        w = _weight(self.pairs.astype(np.float64), three)
        self.trie.levels[0].backoffs[:] = quantise(1 - w)
        own, less = w.astype(np.float32)[self.front], self.level2[self.back]
        self.trie.levels[1].codes[:] = quantise(own * (self.ratio3 - less) + less)


def _scores(grams: Grams, model: Model) -> list[np.ndarray]:
    """Log10 probabilities of the documents under each profile, by search in the trie."""
    trie, t = model.trie, grams.tokens
    pair, before = grams.of_token[1], np.concatenate(([-1], t[:-1]))
    before[grams.starts] = -1
    found2 = trie.longer(0, grams.first, grams.second, None)
    two = np.append(found2, -1)[pair]
    if model.order > 2:
        triple = grams.of_token[2]
        found3 = trie.longer(1, found2[grams.front], found2[grams.back], grams.second[grams.front])
        three = np.append(found3, -1)[triple]
        context = np.concatenate(([-1], two[:-1]))
        context[grams.starts] = -1
        del found3
    del found2
    seen, unseen = np.flatnonzero(two >= 0), np.flatnonzero(two < 0)
    two, before, last = two[seen], before[unseen], t[unseen]
    if model.order > 2:
        longer, shorter = np.flatnonzero(three >= 0), np.flatnonzero(three < 0)
        three, context = three[longer], context[shorter]
    out = []
    scale = -np.log10(2) / STEPS
    lower = np.empty(len(t), dtype=np.int64)
    total = np.empty(len(t), dtype=np.int64)
    with_none = lambda codes: np.append(codes, np.uint16(0))  # noqa: E731 - place -1 is "no context"
    for w2 in WEIGHTS[2]:
        model.smooth(w2)
        lower[seen] = trie.levels[0].codes[two]
        lower[unseen] = with_none(trie.backoffs)[before].astype(np.int64) + trie.codes[last]
        for w3 in WEIGHTS[3] if model.order > 2 else ((0.0, 1.0),):
            if not w3[0]:  # no weight on the longer context: the shorter one's value
                out.append(np.add.reduceat(lower, grams.starts) * scale)
                continue
            model.smooth_longer(w3)
            total[longer] = trie.levels[1].codes[three]
            total[shorter] = with_none(trie.levels[0].backoffs)[context] + lower[shorter]
            out.append(np.add.reduceat(total, grams.starts) * scale)
    return out


def _left_out(grams: Grams, totals: list[np.ndarray], n: int, v: int) -> np.ndarray:
    """For each profile the log10 likelihood of the chunk's training tokens, each with its own occurrence left out."""
    most = len(totals)
    out = np.zeros(len(PROFILES[most]))
    totals = [np.append(t, 0) for t in totals]  # one more for "no such n-gram", at place -1
    first = np.append(grams.first, -1)
    step = 1 << 16
    for lo in range(0, len(grams.tokens), step):
        at = lo + np.flatnonzero(grams.train[lo : lo + step])
        pair = grams.of_token[1][at]
        l1 = np.maximum(totals[0][grams.tokens[at]], 1) / max(1, n + v)
        c1 = np.maximum(totals[0][first[pair]] - 1, 0)
        f2 = np.maximum(totals[1][pair] - 1, 0) / np.maximum(c1, 1)
        if most > 2:
            triple = grams.of_token[2][at]
            c2 = np.where(triple >= 0, np.maximum(totals[1][grams.of_token[1][at - 1]] - 1, 0), 0)
            f3 = np.maximum(totals[2][triple] - 1, 0) / np.maximum(c2, 1)
            weights = [_weight(c2, w3) for w3 in WEIGHTS[3]]
        k = 0
        for w2 in WEIGHTS[2]:
            w = _weight(c1, w2)
            q = w * f2 + (1 - w) * l1
            for w in weights if most > 2 else (0.0,):
                out[k] += np.log10(w * f3 + (1 - w) * q if most > 2 else q).sum()
                k += 1
    return out


def _score(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame, most: int, bits: int) -> pd.DataFrame:
    if not len(docs):
        return pd.DataFrame({c.split()[0]: [] for c in SCORED.split(", ")})
    ids, held = docs["doc_id"].to_numpy(), docs["held_out"].to_numpy(dtype=bool)
    texts = docs["text"].tolist()
    del docs
    grams = Grams(texts, held, most)
    del texts
    answers = answers.sort_values("bucket")
    n, v = int(answers["n"].iloc[0]), int(answers["v"].iloc[0])
    blobs, buckets, at = answers["blob"].tolist(), int(answers["buckets"].iloc[0]), [0] * len(answers)
    numbers = answers["bucket"].to_numpy()
    del answers
    totals = []
    for order in range(1, most + 1):
        width = 64 if order == 1 else bits
        keys, counts, place = grams.sorted_keys(order, width)
        cuts = np.searchsorted(_bucket(keys, width, buckets), numbers.astype(np.uint64))
        for i, (blob, a, b) in enumerate(zip(blobs, cuts.tolist(), [*cuts[1:].tolist(), len(keys)])):
            others, at[i] = _unpack_counts(blob, at[i], b - a)
            counts[a:b] += others
        totals.append(counts[place])
        grams.keys[order - 1] = None
    del blobs, keys, counts, place
    left = _left_out(grams, totals, n, v)
    model = Model(grams, totals, n, v)
    scores = np.stack(_scores(grams, model), axis=1)
    known = np.add.reduceat((totals[0] > 0).astype(np.int64)[grams.tokens], grams.starts)
    base = np.add.reduceat(np.log10(model.unigram)[grams.tokens], grams.starts)
    return pd.DataFrame(
        {
            "doc_id": ids,
            "held_out": held,
            "n_tokens": grams.lengths,
            "n_known": known,
            "train_tokens": np.full(len(held), n),
            "base_score": base,
            "scores": list(scores),
            "left_out": [left] + [None] * (len(held) - 1),
        }
    )


def score(docs: DataFrame, fold: int = 7, held_out: int = 2, order: int = 3, chunk_chars: int = 6_000_000) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    given = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    chars = int(given.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    chunks, bits = chars // chunk_chars + 1, key_bits(chars)
    marked = given.withColumn("held_out", crc_remainder(F.col("doc_id"), fold) == held_out)
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int")  # by number: equal rows are spread
    dealt = marked.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "held_out", chunk.alias("chunk"))  # ids go through pandas as text, to keep nulls and large numbers whole
    sent = dealt.groupBy("chunk").applyInPandas(lambda key, pdf: _send(key, pdf, chunks, order, bits), SENT)
    counted = sent.groupBy("bucket").applyInPandas(_count_words, "n long, v long").agg(F.struct(F.sum("n").alias("n"), F.sum("v").alias("v")).alias("both")).scalar()
    answers = sent.groupBy("bucket").applyInPandas(lambda key, pdf: _add_up(key, pdf, order), ANSWER)
    answers = answers.select("chunk", "bucket", "blob", counted["n"].alias("n"), counted["v"].alias("v"), F.lit(chunks).alias("buckets"))
    scored = cut(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(lambda key, d, a: _score(key, d, a, order, bits), SCORED))
    sums = scored.agg(*[F.sum(F.get("left_out", F.lit(k))).alias(f"p{k}") for k in range(len(PROFILES[order]))]).first()
    best = max(range(len(PROFILES[order])), key=lambda k: (sums[k] if sums[k] is not None else 0.0, -k))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.get("scores", F.lit(best)).alias("score"))
