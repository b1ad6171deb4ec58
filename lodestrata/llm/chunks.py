"""Chunks of documents as units of exchange.

Documents are taken in chunks of about half a megabyte, which are written once, compressed and numbered, and read again by
every pass. A chunk sends what it has to say to a bucket in one row of packed arrays, and gets its answers back by its number.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import column_of, empty_where_null, keyed_text, stow, text_chunks

#: Bytes of text in a chunk; a longer single text is a chunk of its own.
CHUNK_BYTES = 1 << 19
#: Bytes of text for each bucket, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 256
#: Bytes of chunks in an Arrow batch.
BATCH_BYTES = 4 << 20
#: Stands for a null doc_id: larger than all others.
LAST = np.iinfo(np.int64).max


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, so that of a batch of chunks only one is held twice."""
    for batch in batches:
        for k in range(len(batch)):
            yield batch.slice(k, 1).to_pylist()[0]


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While tables of chunks are read and written at once, a Python worker gets few of them together; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, held)


def chunk_table(docs: DataFrame, rest: list[str] | None = None) -> DataFrame:
    """chunk, ids, sizes, body: the chunks of documents, compressed and stowed, so that every pass sees the same ones.

    rest: the named other columns, and whether text is null, as Arrow bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, CHUNK_BYTES):
                texts = W.Texts.of(empty_where_null(column_of(part, "text")))
                body = zstandard.ZstdCompressor(level=3).compress(texts.data.tobytes())
                sink = pa.BufferOutputStream()
                if rest is not None:
                    held = pa.RecordBatch.from_arrays([*(column_of(part, c) for c in rest), column_of(part, "text").is_null()], [str(k) for k in range(len(rest) + 1)])
                    with pa.ipc.new_stream(sink, held.schema) as out:
                        out.write_batch(held)
                ids = column_of(part, "doc_id").cast(pa.int64()).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([np.diff(texts.at).tolist()], pa.list_(pa.int64())), pa.array([body], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["ids", "sizes", "body", "rest"])

    rows = (keyed_text(docs) if rest is None else docs).mapInArrow(run, "ids array<long>, sizes array<long>, body binary, rest binary")
    return stow(rows.withColumn("chunk", F.monotonically_increasing_id()))


def bucket_count(chunks: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    size = chunks.agg(F.coalesce(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")), F.lit(0)).alias("n")).first().n
    return max(LEAST_BUCKETS, size // bucket_bytes)


def opened(ids: list, sizes: list, body: bytes) -> tuple[W.Texts, np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    return W.Texts(data, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), np.array([LAST if i is None else i for i in ids], np.int64)


def marked(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def slices(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if not len(buckets):
        return
    edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    yield from zip(buckets[edges].tolist(), edges.tolist(), np.append(edges[1:], len(buckets)).tolist(), strict=True)


def ids_of(column: pa.Array) -> np.ndarray:
    return np.asarray(pa.compute.fill_null(column, LAST), np.int64)
