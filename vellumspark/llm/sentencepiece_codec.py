"""Exact SentencePiece encoding of merge-type (BPE) models by backtracking, and decoding.

Encoding goes through a text from left to right, without a merge queue: an Aho-Corasick automaton gives the
pieces that start at each place, longest first; a piece is taken if it is compatible with the one before
it, that is if merging the two pieces' characters again gives just these two; a place from which nothing
compatible was found is noted in a bitfield and not tried again. No piece of these models has the space
mark after another character, so texts are encoded word by word, and the words met are remembered in a
bounded cache.

Runs of space marks, whose merges can tie in score, are merged directly, best score first. Characters
without a piece become byte pieces. Time is linear in a word's length (runs of spaces: times its logarithm),
whatever its characters.

Defined cases: null counts as empty; the empty text has no ids and decodes to the empty text; the space mark
itself is read as a space, as in the library; repeated rows are encoded each; texts of any length are encoded
whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from vellumspark.llm.common import text_or_empty

MARK = "▁"
CACHE_WORDS = 500_000
CACHE_CHARS = 64  # longer words are not remembered, only their parts
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_codecs: dict[bytes, Codec] = {}


class Codec:
    """Encoder and decoder of one model, given as the bytes of its file."""

    def __init__(self, model: bytes, cache_words: int = CACHE_WORDS) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        pieces, scores = [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.byte_of = {i: int(p[3:5], 16) for i, p in enumerate(pieces) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_of = {pieces[i]: i for i in normal}
        self.score_of = {pieces[i]: scores[i] for i in normal}
        self.piece_of = pieces
        self.longest_piece = max(map(len, self.id_of), default=1)
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece has the space mark after another character")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.plain = set(normal)
        self.letters = {p for p in self.id_of if len(p) == 1}
        self.number = [str(i) for i in range(n)]
        self.best: dict[str, int] = {}  # of each prefix of a piece the longest piece it begins with
        for p in self.id_of:
            held = -1
            for k in range(1, len(p) + 1):
                held = self.id_of.get(p[:k], held)
                self.best[p[:k]] = held
        self.options: dict[int, tuple[tuple[int, int], ...]] = {}
        self.compatible: dict[int, bool] = {}
        self.cache_words = cache_words
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.faithful = True  # so far every word met decodes to itself, as do texts of such words
        self.unit = self._unit()
        self.pairs = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.line = None if any("\n" in p for p in self.id_of) else self.number[self._ids("\n")[0]]

    def _unit(self) -> int:
        """The longest piece of space marks alone, if long runs begin with whole ones; else 0."""
        unit = max((len(p) for p in self.id_of if not p.strip(MARK)), default=0)
        sure = all(self.merge(MARK * n)[: n // unit - 2] == [MARK * unit] * (n // unit - 2) for n in range(3 * unit, 7 * unit)) if unit else False
        return unit if sure else 0

    def merge(self, text: str) -> list[str]:
        """Plain merging: again and again the adjacent pair with the best score, the leftmost of equals."""
        parts: list[str | None] = list(text)
        n, score = len(parts), self.score_of
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(-s, i, 2) for i in range(n - 1) if (s := score.get(text[i : i + 2])) is not None]
        heapify(queue)
        while queue:
            _, i, size = heappop(queue)
            left = parts[i]
            if left is None or after[i] >= n or len(left) + len(parts[after[i]]) != size:
                continue  # one of the pair has been merged since
            gone = after[i]
            parts[i], parts[gone] = left + parts[gone], None
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (s := score.get(both := parts[a] + parts[after[a]])) is not None:
                    heappush(queue, (-s, a, len(both)))
        return [p for p in parts if p is not None]

    def _fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        got = self.compatible.get(key)
        if got is None:
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            left, right = self.piece_of[a], self.piece_of[b]
            got = self.compatible[key] = self.merge(left + right) == [left, right]
        return got

    def _backtrack(self, word: str) -> list[int]:
        """Ids of a word all of whose characters have pieces."""
        n = len(word)
        longest, best, options = self.automaton.longest_prefix, self.best, self.options
        reach = self.longest_piece
        failed = bytearray(n // 8 + 1)  # bit p: no way on from place p
        ids: list[int] = []
        steps: list[tuple[int, tuple, int]] = []  # for each piece its place, the pieces that could stand there, how many were tried
        at, last, found, k = 0, -1, None, 0
        while at < n:
            if found is None:
                rest = word[at : at + reach]
                key = last << 32 | best[rest[: longest(rest)]]
                found, k = options.get(key) or self._options(key, last), 0
            for size, i in found[k:] if k else found:
                k += 1
                if not failed[at + size >> 3] >> (at + size & 7) & 1:
                    steps.append((at, found, k))
                    ids.append(i)
                    at, last, found = at + size, i, None
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not ids:
                    raise ValueError(f"no encoding: {word!r}")
                ids.pop()
                at, found, k = steps.pop()
                last = ids[-1] if ids else -1
        return ids

    def _options(self, key: int, last: int) -> tuple[tuple[int, int], ...]:
        """Size and id of the pieces that can follow last where a certain piece is the longest match, longest first."""
        if len(self.options) > 1_000_000:
            self.options.clear()
        piece = self.piece_of[key & 0xFFFFFFFF]
        fitting = [(n, self.id_of[piece[:n]]) for n in range(len(piece), 0, -1) if piece[:n] in self.id_of]
        got = self.options[key] = tuple(x for x in fitting if last < 0 or self._fits(last, x[1]))
        return got

    def segment(self, word: str) -> list[int]:
        """Ids of leading space marks and the characters up to the next mark."""
        if word.startswith(MARK * 2):
            whole = max(0, len(word) - len(word.lstrip(MARK)) - 2 * self.unit) // self.unit if self.unit else 0
            return [self.id_of[MARK * self.unit]] * whole + [x for p in self.merge(word[whole * self.unit :]) for x in self._ids(p)]
        if self.letters.issuperset(word):
            return self._backtrack(word)
        ids: list[int] = []
        run = ""
        for c in word:
            if c in self.letters:
                run += c
                continue
            if run:
                ids += self._backtrack(run)
                run = ""
            ids += self._ids(c)
        return ids + self._backtrack(run) if run else ids

    def _ids(self, piece: str) -> list[int]:
        got = self.id_of.get(piece)
        if got is not None:
            return [got]
        return [self.byte_id.get(b, self.unknown) for b in piece.encode("utf-8", "surrogatepass")]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return [i for w in _SEGMENT.findall(MARK + text.replace(" ", MARK)) for i in self.segment(w)]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids; first: without the space that encoding puts in front."""
        if self.plain.issuperset(ids):
            text = "".join([self.piece_of[i] for i in ids]).replace(MARK, " ")
            return text[1:] if first and text.startswith(" ") else text
        out, held = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(" ⁇ " if i == self.unknown else self.piece_of[i].replace(MARK, " "))
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if first and text.startswith(" ") else text

    def _word(self, word: str) -> str:
        """Joined ids of a word with the space, or the line end, before it.

        A line end is a byte piece, and no piece holds certain pairs of characters; on both sides of such
        a place the ids are those of the parts. Parts, read as if at a line's start, have no such place.
        """
        got = self.young.get(word) or self.old.get(word)
        if got is None:
            if self.line is not None and "\n" in word[1:]:
                lines = word[1:].split("\n")
                return ",".join([self._word(word[0] + lines[0]), *[self.line + ("," + self._word("\n" + x) if x else "") for x in lines[1:]]])
            pairs = self.pairs
            cuts = [i for i in range(2, len(word)) if word[i - 1 : i + 1] not in pairs]
            if cuts:
                got = ",".join([self._word(word[: cuts[0]]), *[self._word("\n" + word[i:j]) for i, j in zip(cuts, [*cuts[1:], len(word)])]])
            else:
                ids = self.segment(MARK + word[1:] if word[0] == " " else word[1:])
                got = ",".join([self.number[i] for i in ids])
                self.faithful &= self.decode(ids, first=False) == (word if word[0] == " " else word[1:])
        if len(word) <= CACHE_CHARS:
            self.young[word] = got
        return got

    def round_trip(self, text: str) -> tuple[str, str]:
        """The ids joined by commas, and the decoded text."""
        if not text:
            return "", ""
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            ids = self.encode(text)
            return ",".join(map(str, ids)), self.decode(ids)
        words = [" " + w for w in text.split(" ")]
        got = list(map(self.young.get, words))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    got[i] = self._word(words[i])
            if len(self.young) > self.cache_words:
                self.young, self.old = {}, self.young
        joined = ",".join(got)
        return joined, text if self.faithful else self.decode([int(x) for x in joined.split(",")])


def codec(model: bytes) -> Codec:
    key = hashlib.md5(model).digest()
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, ids (joined by commas), decoded. The model's file is read on the driver and sent to the workers (0.5 MB)."""
    model = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(model.value)
        for batch in it:
            done = [both.round_trip(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.string())], ["doc_id", "ids", "decoded"])

    given = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))
    return given.mapInArrow(batches, "doc_id long, ids string, decoded string")
