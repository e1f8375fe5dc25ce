"""Cost-balanced packing of documents into training sequences.

A document becomes its token ids and one end id. Whole sequences' worth of ids are cut off its front and
stand alone; what remains of all documents of a group is assigned in descending length, each remainder to
the sequence of lowest estimated attention cost (linear plus quadratic in each document's length) that has
room. A group opens just as many sequences as its tokens need, so a remainder that fits nowhere whole is
cut to fill the rooms left; padding is then under one sequence per group. A last sequence that would be
less than half full is divided at powers of two, which need no padding.

Documents are packed where they are read, in groups of ``group_docs`` documents, without a shuffle. The
sequence ids are the partition's number times 2^40 plus a counter, so a task that runs again gives the
same rows.

Defined cases: null and empty texts are one end id; a null id stays null; repeated rows are packed each;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vellumspark.llm.common import pieces, text_or_empty

SEQUENCE = 1024
END_ID = 0
CACHE_WORDS = 100_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: The pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = re.compile("[\x00-\u024f\u2010-\u203a]*")
_encoders: dict[int, Callable[[str], bytes]] = {}


def ranks_of(tokenizer_json: str) -> dict[bytes, int] | None:
    """The byte sequence of each id if the tokenizer is byte-level BPE whose ids are in merge order, else None."""
    spec = json.loads(tokenizer_json)
    model = spec["model"]
    if model.get("type") != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
        return None
    if spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True):
        return None
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printed]
    byte_of = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(other)}
    added = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    return ranks if merged == sorted(set(merged)) and len(merged) == len(ranks) - 256 else None


def word_encoder(tokenizer_json: str, cache_words: int = CACHE_WORDS) -> Callable[[str], bytes]:
    """A function from text to its ids as little-endian 32-bit numbers, with the words met so far remembered.

    Words of Latin letters are merged by the faster tiktoken, given the same vocabulary; the rest, and
    texts that can't be divided at spaces, by tokenizers itself.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    young: dict[str, bytes] = {}
    old: dict[str, bytes] = {}
    same = None
    if ranks := ranks_of(tokenizer_json):
        import tiktoken

        same = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
    plain = _PLAIN.fullmatch

    def raw(text: str) -> bytes:
        ids = same(text) if same and (text.isascii() or plain(text)) else tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    opens = np.zeros(0, dtype=bool)
    if same:
        opens = np.zeros(max(ranks.values()) + 1, dtype=bool)
        opens[[i for t, i in ranks.items() if t[:1] == b" "]] = True

    def learn(words: list[str]) -> None:
        """Encodes new words, all of which begin with a space, in one call: a piece that opens with a space begins a word."""
        together = "".join(words)
        if same and (together.isascii() or plain(together)):
            ids = np.array(same(together), dtype="<u4")
            at = np.flatnonzero(opens[ids])
            if len(at) == len(words):
                blob, cuts = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                young.update(zip(words, [blob[a:b] for a, b in zip(cuts, cuts[1:])]))
                return
        for w in words:
            young[w] = raw(w)

    def encode(text: str) -> bytes:
        """A space that no other white space touches always begins a new pre-token, so a text is encoded word by word there."""
        nonlocal young, old
        if not text:
            return b""
        if any(s in text for s in special):
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        first, *words = text.split(" ")
        if not first or first[-1].isspace():
            return raw(text)
        words = [" " + w for w in words]
        got = list(map(young.get, words))
        if None in got:
            new = {w for w, ids in zip(words, got) if ids is None}
            if any(len(w) == 1 or w[1].isspace() or w[-1].isspace() for w in new):
                return raw(text)
            unseen = []
            for w in new:
                if (ids := old.get(w)) is not None:
                    young[w] = ids
                else:
                    unseen.append(w)
            if unseen:
                learn(unseen)
            got = [young[w] for w in words]
            if len(young) > cache_words:
                young, old = {}, young
        return raw(first) + b"".join(got)

    return encode


def assign(lengths: list[int], capacity: int = SEQUENCE, linear: float = 1.0, quadratic: float = 1 / 512) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (item, start, length, sequence, offset) for items shorter than capacity, and the number of sequences.

    Descending items go to the lowest-cost sequence with room; one that fits nowhere whole fills the roomiest
    sequences in turn. The sequence count is the least that holds all tokens. Sequences are in one heap per room
    left, under a tree that gives the lowest cost of all rooms from a certain one up.
    """
    count = -(-sum(lengths) // capacity)
    used, cost = [0] * count, [0.0] * count
    out: list[tuple[int, int, int, int, int]] = []
    cut: list[int] = []
    size, none = 1 << capacity.bit_length(), (float("inf"), -1)
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(size)]
    heaps[capacity] = [(0.0, s) for s in range(count)]
    tree = [none] * (2 * size)

    def put(item: int, start: int, length: int, s: int) -> None:
        out.append((item, start, length, s, used[s]))
        used[s] += length
        cost[s] += linear * length + quadratic * length * length

    def renew(room: int) -> None:
        i = room + size
        tree[i] = heaps[room][0] if heaps[room] else none
        while i > 1:
            i >>= 1
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def lowest(room: int) -> int:
        """The sequence of lowest cost with so much room, or -1."""
        best, i, end = none, room + size, 2 * size
        while i < end:
            if i & 1:
                best = min(best, tree[i])
                i += 1
            i, end = i >> 1, end >> 1
        return best[1]

    renew(capacity)
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        s = lowest(lengths[item])
        if s < 0:
            cut.append(item)
            continue
        room = capacity - used[s]
        heapq.heappop(heaps[room])
        renew(room)
        put(item, 0, lengths[item], s)
        heapq.heappush(heaps[capacity - used[s]], (cost[s], s))
        renew(capacity - used[s])
    rooms = [(used[s] - capacity, s) for s in range(count) if used[s] < capacity]
    heapq.heapify(rooms)
    for item in cut:
        start = 0
        while start < lengths[item]:
            free, s = heapq.heappop(rooms)
            length = min(-free, lengths[item] - start)
            put(item, start, length, s)
            start += length
            if free + length:
                heapq.heappush(rooms, (free + length, s))
    return out, count


def split_last(pieces: list[tuple[int, int, int, int, int]], count: int, capacity: int = SEQUENCE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Cuts a sequence that is less than half full at powers of two, largest first; these need no padding."""
    fill: dict[int, int] = {}
    for p in pieces:
        fill[p[3]] = fill.get(p[3], 0) + p[2]
    small = {s for s, n in fill.items() if 2 * n < capacity and n & (n - 1)}
    out = [p for p in pieces if p[3] not in small]
    for s in sorted(small):
        left, at = 1 << (fill[s].bit_length() - 1), 0
        target, rest = s, fill[s] - left
        for item, start, length, _, _ in sorted((p for p in pieces if p[3] == s), key=lambda p: p[4]):
            while length:
                take = min(length, left)
                out.append((item, start, take, target, at))
                start, length, left, at = start + take, length - take, left - take, at + take
                if not left and rest:
                    left = 1 << (rest.bit_length() - 1)
                    rest, target, at, count = rest - left, count, 0, count + 1
    return out, count


def pack_group(docs: list[tuple[int | None, bytes]], first_sequence: int, capacity: int = SEQUENCE) -> tuple[list[tuple], int]:
    """Rows of SCHEMA for documents given as (doc_id, ids in 4 bytes each), and the next free sequence number."""
    rows: list[tuple] = []
    crc, sequence = zlib.crc32, first_sequence
    rest: list[tuple[int, int]] = []
    for d, (doc_id, ids) in enumerate(docs):
        n = len(ids) // 4
        whole = n // capacity * capacity
        for at in range(0, whole, capacity):
            rows.append((doc_id, at, capacity, crc(ids[4 * at : 4 * (at + capacity)]), n, sequence, 0))
            sequence += 1
        if n > whole:
            rest.append((d, whole))
    pieces, count = assign([len(docs[d][1]) // 4 - at for d, at in rest], capacity)
    pieces, count = split_last(pieces, count, capacity)
    for item, start, length, s, offset in pieces:
        d, at = rest[item]
        doc_id, ids = docs[d]
        at += start
        rows.append((doc_id, at, length, crc(ids[4 * at : 4 * (at + length)]), len(ids) // 4, sequence + s, offset))
    return rows, sequence + count


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE, end_id: int = END_ID, group_docs: int = 4096) -> DataFrame:
    """One row per piece, with SCHEMA. The tokenizer's file is read on the driver and sent to the workers (1.5 MB)."""
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    tail = np.array([end_id], dtype="<u4").tobytes()
    given = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))
    arrow = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(spec.value)
        if key not in _encoders:
            _encoders[key] = word_encoder(spec.value)
        encode = _encoders[key]
        number = TaskContext.get().partitionId() << 40
        group: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, group, size
            rows, number = pack_group(group, number, capacity)
            group, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=arrow)

        for batch in pieces(it):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                group.append((doc_id, encode(text) + tail))
                size += len(group[-1][1])
                if len(group) >= group_docs or size >= 64 << 20:
                    yield flush()
        if group:
            yield flush()

    return given.mapInArrow(batches, SCHEMA)
