"""Exact top-k inner-product search with vector-approximation files.

Vectors become integers, floor(scale * component). Where they are read they are written once, without a
shuffle, as blocks of at most ``block_rows`` vectors: for each component the range of the block is cut into
``2^4`` cells of equal width, and each component is kept as the four bits of its cell, beside the exact
vectors. With cells of equal width the bounds of all scores of a block are one matrix product of the (scaled)
queries with the cells themselves, plus a term of the query alone; lower bounds differ from upper ones by a
term of the query alone as well.

Queries (ids divisible by ``query_every``) are sent to the blocks in waves of at most about ``wave_bytes``;
a wave is one scan of the blocks. A task carries each query's kth score from block to block. In a block it
drops all rows whose upper bound is under that score or under the kth lower bound of the block, and reads the
exact vectors of the others in the order of their bounds until the kth score found exceeds every bound left.
The best k of each task are merged by rank. Vectors of different lengths don't meet.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do null
ids; components and scores beyond a long are held at its ends; ties go to the smaller id; rows that repeat an
id are each candidates (a query's own id never is), but ask once, as the first by value; an empty table gives
no rows; columns other than vec_id and embedding are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.llm.common import cut

RESULT = "query_id long, vec_id long, score long"
BLOCK = "dim int, ids binary, cells binary, low binary, width binary, gap binary, kind string, exact binary"
CELLS = 16
LEAST, MOST = -(1 << 63), (1 << 63) - 1
EXACT_DOUBLE, EXACT_SINGLE = 1 << 53, 1 << 24


class ApproximationFile:
    """Cells of a block of integer vectors beside the vectors, and bounds of their scores."""

    def __init__(self, vectors: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray, gap: np.ndarray) -> None:
        self.vectors, self.cells, self.low, self.width, self.gap = vectors, cells, low, width, gap
        self.largest = np.abs(vectors.astype(np.float64)).max(axis=0, initial=0)

    @classmethod
    def of(cls, vectors: np.ndarray) -> ApproximationFile:
        """Cells of equal width in each component; whole numbers where the vectors leave room for that."""
        if np.abs(vectors.astype(np.float64)).max(initial=0) < EXACT_DOUBLE >> 2:
            low = vectors.min(axis=0)
            width = -(-(vectors.max(axis=0) - low + 1) // CELLS)
            return cls(vectors, ((vectors - low) // width).astype(np.uint8), low.astype(np.float64), width.astype(np.float64), width - 1.0)
        real = vectors.astype(np.float64)
        low = real.min(axis=0)
        width = np.maximum((real.max(axis=0) - low) / CELLS, 1.0)
        return cls(vectors, np.clip((real - low) // width, 0, CELLS - 1).astype(np.uint8), low, width, width)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(part, base, spread): base + part are upper bounds of the scores, one row per query, and spread less are lower ones."""
        q = queries.astype(np.float64)
        scaled, size = q * self.width, np.abs(q) @ self.largest
        single = (np.abs(scaled).sum(axis=1) * (CELLS - 1) < EXACT_SINGLE).all() and (self.width == np.floor(self.width)).all()
        kind = np.float32 if single else np.float64
        part = scaled.astype(kind) @ self.cells.astype(kind).T
        # what rounding may take from sums too large for doubles
        slack = np.where(4 * (size + np.abs(q) @ self.width) < EXACT_DOUBLE, 0.0, (size + np.abs(q) @ self.width) * len(self.low) * 2.0**-44)
        base = q @ self.low + np.maximum(q, 0) @ self.gap + slack
        return part, base, np.abs(q) @ self.gap + 2 * slack

    def scores(self, places: np.ndarray, query: np.ndarray) -> list[int]:
        """Exact scores of some of the vectors, held at the ends of a long."""
        rows = self.vectors[places]
        if np.abs(query.astype(np.float64)) @ self.largest < EXACT_DOUBLE:
            return (rows.astype(np.int64) @ query).tolist()
        whole = query.tolist()
        return [max(LEAST, min(MOST, sum(a * b for a, b in zip(row, whole)))) for row in rows.tolist()]

    def pack(self) -> tuple[bytes, bytes, bytes, bytes, str, bytes]:
        """Cells (two to a byte), edges, and the vectors in the least kind of integer that holds them."""
        flat = self.cells.ravel()
        flat = np.append(flat, np.uint8(0)) if len(flat) % 2 else flat
        largest = self.largest.max(initial=0)
        kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"
        edges = (x.astype("<f8").tobytes() for x in (self.low, self.width, self.gap))
        return ((flat[0::2] | flat[1::2] << 4).tobytes(), *edges, kind, self.vectors.astype(kind).tobytes())

    @classmethod
    def unpack(cls, dim: int, cells: bytes, low: bytes, width: bytes, gap: bytes, kind: str, exact: bytes) -> ApproximationFile:
        vectors = np.frombuffer(exact, dtype=kind).reshape(-1, dim)
        both = np.frombuffer(cells, dtype=np.uint8)
        flat = np.stack([both & 15, both >> 4], axis=1).ravel()[: vectors.size]
        return cls(vectors, flat.reshape(vectors.shape), *(np.frombuffer(x, dtype="<f8") for x in (low, width, gap)))


class Best:
    """The k best (-score, id) of each query of a wave so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.kth = np.full(len(ids), -np.inf)
        self.read = 0

    def search(self, file: ApproximationFile, ids: np.ndarray, chunk: int = 256) -> None:
        """Takes in a block."""
        order = np.argsort(ids, kind="stable")
        for start in range(0, len(self.ids), chunk):
            asked = self.ids[start : start + chunk]
            part, base, spread = file.bounds(self.queries[start : start + chunk])
            first, after = np.searchsorted(ids[order], asked, "left"), np.searchsorted(ids[order], asked, "right")
            for i in np.flatnonzero(after > first):  # a query is no candidate of its own
                part[i, order[first[i] : after[i]]] = -np.inf
            least = np.maximum(self.kth[start : start + chunk], LEAST) - base
            least[np.isneginf(self.kth[start : start + chunk])] = -np.inf
            if len(ids) > self.k:
                least = np.maximum(least, np.partition(part, len(ids) - self.k, axis=1)[:, len(ids) - self.k] - spread)
            least = np.minimum(least, MOST - base)  # of scores held at an end only ids tell apart
            least[base + part.max(axis=1) <= LEAST] = -np.inf
            hits = (part >= least[:, None]) & (part > -np.inf)
            for i in np.flatnonzero(hits.any(axis=1)):
                self._read(file, ids, start + i, np.flatnonzero(hits[i]), part[i], base[i])

    def _read(self, file: ApproximationFile, ids: np.ndarray, n: int, places: np.ndarray, part: np.ndarray, base: float) -> None:
        """Exact vectors in the order of their bounds, until the kth score exceeds every bound left."""
        places = places[np.argsort(-part[places], kind="stable")]
        found, step = self.found[n], 4 * self.k
        for at in range(0, len(places), step):
            if len(found) == self.k and max(base + part[places[at]], LEAST) < -found[-1][0]:
                break
            read = places[at : at + step]
            self.read += len(read)
            found = sorted(found + [(-s, i) for s, i in zip(file.scores(read, self.queries[n]), ids[read].tolist())])[: self.k]
        self.found[n] = found
        if len(found) == self.k:
            self.kth[n] = -found[-1][0]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _blocks(vectors: DataFrame, block_rows: int) -> DataFrame:
    """vec_id, vector, dim as rows of BLOCK, made where the vectors are read."""
    schema = pa.schema([(c.split()[0], {"int": pa.int32(), "string": pa.string()}.get(c.split()[1], pa.binary())) for c in BLOCK.split(", ")])

    def block(dim: int, ids: list[np.ndarray], vectors: list[np.ndarray]) -> pa.RecordBatch:
        file = ApproximationFile.of(np.concatenate(vectors).reshape(-1, dim))
        return _batch([(dim, np.concatenate(ids).astype("<i8").tobytes(), *file.pack())], schema)

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[list, list]] = {}
        held = 0
        for whole in it:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                dims, ids = batch.column("dim").to_numpy(), batch.column("vec_id").to_numpy()
                for dim in np.unique(dims).tolist():
                    mine = np.flatnonzero(dims == dim)
                    flat = batch.column("vector").take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    kept = open_.setdefault(dim, ([], []))
                    kept[0].append(ids[mine])
                    kept[1].append(flat)
                    held += len(flat)
                    if sum(map(len, kept[0])) + 1024 > block_rows:
                        held -= sum(map(len, kept[1]))
                        yield block(dim, *open_.pop(dim))
                if held > 1 << 22:  # vectors of very many lengths, or very long ones
                    for dim in list(open_):
                        yield block(dim, *open_.pop(dim))
                    held = 0
        for dim in list(open_):
            yield block(dim, *open_.pop(dim))

    return vectors.mapInArrow(build, BLOCK)


def _scan(blocks: DataFrame, wave: DataFrame, k: int) -> DataFrame:
    """The k best of each task for the queries of a wave, which is sent to all tasks."""
    asked: dict[int, tuple[list, list]] = {}
    for row in wave.collect():
        kept = asked.setdefault(row["dim"], ([], []))
        kept[0].append(row["vec_id"])
        kept[1].append(row["vector"])
    sent = blocks.sparkSession.sparkContext.broadcast({d: (np.array(i, dtype=np.int64), np.array(v, dtype=np.int64)) for d, (i, v) in asked.items()})
    schema = pa.schema([(c.split()[0], pa.int64()) for c in RESULT.split(", ")])

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for batch in it:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n].as_py() for name in batch.schema.names}
                dim, ids = row.pop("dim"), np.frombuffer(row.pop("ids"), dtype="<i8")
                if dim in sent.value:
                    if dim not in best:
                        best[dim] = Best(*sent.value[dim], k)
                    best[dim].search(ApproximationFile.unpack(dim, **row), ids)
        for dim in list(best):
            own = best.pop(dim)
            for at in range(0, len(own.ids), 4096):
                rows = [(int(q), i, -s) for q, found in zip(own.ids[at : at + 4096], own.found[at : at + 4096]) for s, i in found]
                if rows:
                    yield _batch(rows, schema)

    return blocks.mapInArrow(search, RESULT)


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, block_rows: int = 4096, wave_bytes: int = 8 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k best other rows.

    A wave of queries, at most about wave_bytes of vectors, is all that reaches the driver at a time; results of
    several waves are written one after another.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    given = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("embedding"))
    usable = given.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(finite)
    usable = usable.select("vec_id", whole.alias("vector"), F.size("embedding").alias("dim"))
    asking = usable.filter(F.col("vec_id") % query_every == 0)
    asked = cut(asking.groupBy("vec_id", "dim").agg(F.min("vector").alias("vector")))
    blocks = cut(_blocks(usable, block_rows))
    size = asked.agg(F.coalesce(F.sum(F.col("dim").cast("long") * 8), F.lit(0))).first()[0]
    waves = max(1, -(-size // wave_bytes))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(wave: DataFrame) -> DataFrame:
        found = _scan(blocks, wave, k)
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    if waves == 1:
        return ranked(asked)
    numbered = asked.withColumn("wave", F.pmod(F.xxhash64("vec_id", "dim"), F.lit(waves)))
    done = cut(ranked(numbered.filter(F.col("wave") == 0)))
    for wave in range(1, waves):
        done = done.unionByName(cut(ranked(numbered.filter(F.col("wave") == wave))))
    return done


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
