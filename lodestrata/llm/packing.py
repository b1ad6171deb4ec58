"""Best-fit packing of token sequences by minimum bin slack.

Each document is encoded and cut into pieces of at most `capacity` tokens. What the packing needs of the corpus is only
how many pieces there are of each length: at most `capacity` numbers. From this histogram the driver works out the bins.
Each step takes the largest length left, and a subset-sum bitset over the other available lengths finds the fullest
bin that holds it. That combination stays the fullest as long as its lengths last, so it is used as many times at once;
the plan then has a number of rows that depends on `capacity` alone. Pieces get their rank within their length from
salted counts, and the plan turns length and rank into a bin and a place in it.

Null text counts as empty: one piece with the end token alone. Repeated rows are packed one by one. An empty table gives
an empty result. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import column_of, empty_where_null, keyed_text, stow, text_chunks
from .tokens import PLAIN, special_strings

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_worker: dict = {}


class Encoder:
    """Token ids as the JSON vocabulary's library gives them; the same ranks run by the faster library on plain text."""

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str):
        self.whole = Tokenizer.from_file(json_path)
        self.specials = special_strings(json_path)
        self.fast = None
        if ranks_path:
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.specials) or not PLAIN.fullmatch(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str | None, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. All pieces but the first of a document are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _worker.get("path") != json_path:
            _worker.update(path=json_path, encoder=Encoder(json_path, ranks_path, pattern))
        encoder = _worker["encoder"]
        for batch in batches:
            for part in text_chunks(batch):
                rows: list[tuple] = []
                for doc, text in zip(column_of(part, "doc_id").to_pylist(), empty_where_null(column_of(part, "text")).to_pylist(), strict=True):
                    ids = np.array([*encoder.ids(text), END_ID], "<u4")
                    first = (len(ids) - 1) % capacity + 1
                    for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                        end = first + k * capacity
                        rows.append((doc, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return keyed_text(docs).mapInArrow(run, PIECES)


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The fullest combination, as (length, times), that holds the largest length; large lengths go first among equals."""
    largest = max(counts)
    room = capacity - largest
    keep = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(n for n in counts if n <= room):
        left = min(counts[length] - (length == largest), room // length)
        steps.append((length, left, reach))
        block = 1
        while left > 0:  # binary splitting: 1, 2, 4, ... copies at a time
            take = min(block, left)
            reach |= (reach << (take * length)) & keep
            left -= take
            block *= 2
        if reach >> room & 1:
            break  # a full bin
    at, found = reach.bit_length() - 1, {largest: 1}
    for length, left, before in reversed(steps):
        times = next(t for t in range(left, -1, -1) if at >= t * length and before >> (at - t * length) & 1)
        if times:
            found[length] = found.get(length, 0) + times
            at -= times * length
    return sorted(found.items(), reverse=True)


def bin_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, times in a bin, first bin, place in the bin) that cover every rank of every length."""
    counts, used, bins, plan = dict(histogram), dict.fromkeys(histogram, 0), 0, []
    while counts:
        combination = fullest(counts, capacity)
        repeats, place = min(counts[n] // times for n, times in combination), 0
        for n, times in combination:
            plan.append((n, used[n], repeats * times, times, bins, place))
            used[n] += repeats * times
            counts[n] -= repeats * times
            place += n * times
            if not counts[n]:
                del counts[n]
        bins += repeats
    return plan


def ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Adds rank, from 0 within each length. Common lengths are salted; the table of offsets stays under 101,024 rows."""
    spark = pieces.sparkSession
    share = max(1_000, sum(histogram.values()) // 100_000)
    salts = spark.createDataFrame([(n, 1 + c // share) for n, c in histogram.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")))
    offsets = salted.groupBy("length", "salt").count().withColumn("first", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("first", F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return salted.withColumn("within", within).join(F.broadcast(offsets), ["length", "salt"]).withColumn("rank", F.col("first") + F.col("within")).select(*pieces.columns, "rank")


def pack(docs: DataFrame, json_path: str, ranks_path: str | None, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stow(token_pieces(docs, json_path, ranks_path, pattern, capacity))
    histogram = {n: c for n, c in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = np.array(sorted(bin_plan(histogram, capacity)), np.int64).reshape(-1, 6)
    keys = plan[:, 0] << 40 | plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (column_of(batch, c).to_numpy() for c in ("length", "rank"))
            row = plan[np.searchsorted(keys, length << 40 | rank, side="right") - 1]
            k = rank - row[:, 1]
            out = [column_of(batch, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(row[:, 4] + k // row[:, 3]), pa.array(row[:, 5] + k % row[:, 3] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(pieces, histogram).mapInArrow(run, PIECES + ", sequence_id long, offset long")
