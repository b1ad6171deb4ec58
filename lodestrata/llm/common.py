"""Helpers that the operators share: worker paths and memory, text chunks, and what the rest of the package has for tables."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, least_labels
from ..sources.tables import checked, stow, table, workers_import

#: Bytes of text that the array code works on at once; a longer single text is a chunk of its own.
CHUNK_BYTES = 1 << 21
#: Bytes of arrays that get a worker's own memory while it is reused, and most free bytes that then stay at its end.
REUSED, KEPT = 8 << 20, 32 << 20


def give_back() -> None:
    """Have large arrays mapped, so that workers give their memory back as soon as an array goes."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has this
        ctypes.CDLL(None).mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD


give_back()


@contextlib.contextmanager
def reused_memory() -> Iterator[None]:
    """Meanwhile arrays of up to REUSED bytes get memory that the worker has in hand, as the pages of a new mapping cost more than the arithmetic on them; afterwards all that is free goes, as workers outlive their tasks."""
    libc = ctypes.CDLL(None)
    with contextlib.suppress(AttributeError):
        libc.mallopt(-1, KEPT)  # M_TRIM_THRESHOLD
        libc.mallopt(-3, REUSED)
    try:
        yield
    finally:
        give_back()
        with contextlib.suppress(AttributeError):
            libc.mallopt(-1, 1 << 17)  # as it is by default
            libc.malloc_trim(0)


def keyed_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that the operators need, so extra columns of any name are out of the way."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def remainder_of_id(doc_id, modulus: int):
    """crc32 of the id written as text, modulo: fixes the held-out rows."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def text_chunks(batch: pa.RecordBatch, limit: int = CHUNK_BYTES, columns: tuple[str, ...] = ("text",)) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `limit` bytes of its text columns each, or a single row; null is as empty."""
    sizes = np.zeros(len(batch), np.int64)
    for name in columns:
        sizes += np.asarray(pa.compute.fill_null(pa.compute.binary_length(column_of(batch, name)), 0), dtype=np.int64)
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def filtered(docs: DataFrame, verdicts: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of docs, with all their columns, whose verdict holds; verdicts sees chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                yield part.filter(pa.array(verdicts(part)))

    return docs.mapInArrow(run, docs.schema)


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def empty_where_null(texts: pa.Array) -> pa.Array:
    return pa.compute.fill_null(texts, "")


__all__ = ["checked", "column_of", "components", "empty_where_null", "filtered", "give_back", "keyed_text", "least_labels", "remainder_of_id", "reused_memory", "stow", "table", "text_chunks", "workers_import"]
