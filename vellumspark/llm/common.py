"""What the training-data operators share: text rules, the checkpoint folder, id columns."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from vellumspark.session import cut, ensure_checkpoint_dir

__all__ = ["ascii_lower", "crc_remainder", "cut", "ensure_checkpoint_dir", "free_names", "pieces", "release_memory", "small", "text_digest", "text_or_empty", "without"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts take the fast built-in, others a character map."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_or_empty(df: DataFrame, col: str = "text") -> Column:
    return F.coalesce(df[col].cast("string"), F.lit(""))


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def release_memory() -> None:
    """Gives what a worker no longer uses back to the system: workers live on from stage to stage, beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not on every system
        pass


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of so many rows and bytes (or one row), so that few texts at a time become Python objects."""
    for batch in batches:
        at, step = 0, rows
        while at < batch.num_rows:
            piece = batch.slice(at, step)
            if piece.nbytes > size and piece.num_rows > 1:
                step = piece.num_rows // 2
                continue
            yield piece
            at, step = at + piece.num_rows, min(rows, 2 * step)
        piece = None
    batch = None
    release_memory()


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, lengthened until none is one of the columns (names differ beyond their case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, rows: int = 150_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows (of about 100 bytes each); df should be cut."""
    return F.broadcast(df) if df.count() <= rows else df


def text_digest(text: Column) -> Column:
    """32 bytes that tell texts apart."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def without(docs: DataFrame, digest: Column, dropped: DataFrame, again: DataFrame) -> DataFrame:
    """docs with all their columns, less the rows of the keys in ``dropped``, and one row of each key in ``again``.

    Both tables have columns id and digest, are cut and hold each key once. Rows are matched by id (null matches
    null) and digest, so that rows which share an id but not a text are told apart. Keys are few beside
    documents: while they are few enough they are broadcast, and texts stay where they are; a key's repeated
    rows, however many, are reduced where they are before one of them is chosen, by the hash of all columns.
    """
    id_, d, rank = free_names(docs.columns, "id", "digest", "rank")
    own = docs.withColumns({id_: docs["doc_id"], d: digest})

    def matched(keys: DataFrame) -> Column:
        return own[id_].eqNullSafe(keys["id"]) & (own[d] == keys["digest"])

    given = docs.columns
    rest = own.join(small(dropped), matched(dropped), "left_anti") if not dropped.isEmpty() else own
    if again.isEmpty():
        return rest.select(*[rest[c] for c in given])
    keys = small(again)
    hashed = [own[f.name] for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))]
    order = Window.partitionBy(id_, d).orderBy(F.xxhash64(*hashed))
    once = rest.join(keys, matched(again), "left_anti")
    many = rest.join(keys, matched(again), "left_semi").withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1)
    return once.select(*[once[c] for c in given]).unionByName(many.select(*[many[c] for c in given]))
