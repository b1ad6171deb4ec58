"""Binary files read in byte ranges, so that a file of any size spreads over tasks.

Records of unlike sizes give their bounds away one after the other only. An index pass therefore reads the heads alone, file by
file, and notes where ranges of whole records begin; a second pass decodes each range by itself. A serial byte stream has no
heads: where a reader takes up a packet depends on all bytes before. But it enters a range at one of five places, and each of
these leads to one exit. So each range says where each entry would leave it, the chain of exits is followed over the few
numbers of all ranges, and then each range is read once from the entry that is its own.

Ranges are read through pyarrow's file systems (local, HDFS, S3, GCS). In a store that only Spark reads, records.read_stream
takes whole files instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import checked, stow

#: Bytes of a range; a longer record is a range of its own.
RANGE_BYTES = 32 << 20
#: Bytes that are read at once where heads are looked for.
_LOOK = 1 << 16
PACKET = 5
#: Bytes of ranges for each task that reads many of them.
TASK_BYTES = 8 << 20


def place(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a URI; an error for schemes that pyarrow doesn't know."""
    return pa.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def in_reach(path: str) -> bool:
    try:
        place(path)
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        return False
    return True


def rolled(name: str) -> str:
    """Pattern of a file and of those it goes on in, which have a number behind its name."""
    return f"{{{name},{name}.[0-9]*}}"


def numbered(held: DataFrame) -> DataFrame:
    """held(session_id, path, first, n, ...) with `first` counted over all files of a session, in order of their names; one row for each file is sorted."""
    own = Window.partitionBy("session_id").orderBy(F.length("path"), "path").rowsBetween(Window.unboundedPreceding, -1)
    before = held.groupBy("session_id", "path").agg(F.sum("n").alias("_n")).select("path", F.coalesce(F.sum("_n").over(own), F.lit(0)).alias("_before"))
    return held.join(checked(stow(before)), "path").withColumn("first", F.col("first") + F.col("_before")).select(*held.columns)


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """session_id (the file's folder), path, length of the files below root; no content is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return found.select(F.element_at(F.split("path", "/"), -2).alias("session_id"), "path", "length")


def _record_bounds(path: str, length: int, head: int, size_of: Callable[[bytes], int], limit: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, first record, records) of ranges of whole records; a record cut short at the end is left out."""
    system, name = place(path)
    with system.open_input_file(name) as source:
        start = at = first = n = 0
        held, base = b"", 0
        while at + head <= length:
            if not base <= at <= base + len(held) - head:
                source.seek(at)
                held, base = source.read(_LOOK), at
            end = at + size_of(held[at - base : at - base + head])
            if end > length:
                break
            if n and end - start > limit:
                yield start, at, first, n
                start, first, n = at, first + n, 0
            at, n = end, n + 1
        if n:
            yield start, at, first, n


def record_ranges(found: DataFrame, head: int, size_of: Callable[[bytes], int], limit: int = RANGE_BYTES) -> DataFrame:
    """session_id, path, start, end, first, n: ranges of whole records of files(session_id, path, length)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(s, p, *r) for s, p, n in part.itertuples(index=False) for r in _record_bounds(p, int(n), head, size_of, limit)]
            yield pd.DataFrame(rows, columns=["session_id", "path", "start", "end", "first", "n"])

    return found.mapInPandas(run, "session_id string, path string, start long, end long, first long, n long")


def fixed_ranges(found: DataFrame, size: int, limit: int = RANGE_BYTES) -> DataFrame:
    """The same for records of one size: arithmetic alone."""
    each = max(1, limit // size)
    n = F.floor(F.col("length") / size)
    held = found.where(n > 0).select("session_id", "path", n.alias("records"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / each))).alias("k"))
    first = F.col("k") * each
    last = F.least(first + each, F.col("records"))
    return held.select("session_id", "path", (first * size).alias("start"), (last * size).alias("end"), first.alias("first"), (last - first).alias("n"))


def range_bytes(path: str, start: int, end: int) -> bytes:
    system, name = place(path)
    with system.open_input_file(name) as source:
        source.seek(start)
        return source.read(end - start)


def spread(ranges: DataFrame) -> DataFrame:
    """Ranges dealt over tasks, a few megabytes to each, or one range to each while there are few."""
    n, size = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()
    tasks = min(n, max(4 * ranges.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES))
    return ranges.repartition(tasks, "path", "start") if n > 1 else ranges


def _steps(data: bytes) -> np.ndarray:
    """For each byte whether a packet may begin there: its two start marks differ and its check bit is set."""
    x = np.frombuffer(data, np.uint8)
    good = ((x ^ x >> 1) & 1).astype(bool)
    good[:-1] &= (x[1:] & 1).astype(bool)
    good[-1:] = False
    return good


def packets_from(good: np.ndarray, entry: int, end: int) -> tuple[list[int], int]:
    """Starts of the packets that a reader takes from `entry` on, and where it is once it is at `end` or past it."""
    at, total, found = entry, len(good), []
    places = np.flatnonzero(good)
    while at < end:
        if at + PACKET > total:
            return found, end
        if good[at]:
            found.append(at)
            at += PACKET
        else:
            k = int(np.searchsorted(places, at))
            at = min(int(places[k]), end) if k < len(places) else end
    return found, at


def _bytes_and_next(path: str, start: int, end: int, length: int, after: list[str]) -> bytes:
    """A range and what a packet that begins in it may reach beyond it, be it in the files that follow."""
    data = range_bytes(path, start, min(end + PACKET - 1, length))
    for name in after:
        if (missing := end - start + PACKET - 1 - len(data)) > 0:
            data += range_bytes(name, 0, missing)
    return data


def serial_packets(spark: SparkSession, root: str, pattern: str = "*.serial", limit: int = RANGE_BYTES) -> DataFrame:
    """session_id, seq, start, degrees, mm, quality: the packets of serial captures, as one reader of a whole capture takes them.

    A capture may go on in files with a number behind its name; packets may lie across their bounds.
    """
    each = max(PACKET, limit)
    found = files(spark, root, rolled(pattern)).where("length > 0").withColumn("capture", F.regexp_replace("path", r"(\.serial)\.[0-9]+$", "$1"))
    place = Window.partitionBy("capture").orderBy(F.length("path"), "path")
    found = found.withColumn("file", F.row_number().over(place).cast("long")).withColumn("after", F.collect_list("path").over(place.rowsBetween(1, PACKET - 1)))
    ranges = found.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / each))).alias("k"))
    kept = ["session_id", "capture", "file", "path", "length", "after"]
    ranges = ranges.select(*kept, "k", (F.col("k") * each).alias("start"), F.least((F.col("k") + 1) * each, "length").alias("end"))
    fields = "session_id string, capture string, file long, path string, length long, after array<string>, k long, start long, end long"

    def exits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            leaves, counts = [], []
            for path, length, after, start, end in part[["path", "length", "after", "start", "end"]].itertuples(index=False):
                good = _steps(_bytes_and_next(path, start, end, length, after))
                ways = [packets_from(good, e, end - start) if e < end - start else ([], e) for e in range(PACKET)]
                leaves.append([w[1] - (end - start) for w in ways])
                counts.append([len(w[0]) for w in ways])
            yield part.assign(leaves=leaves, counts=counts)

    known = stow(spread(ranges).mapInPandas(exits, f"{fields}, leaves array<int>, counts array<long>"))

    def chained(part: pd.DataFrame) -> pd.DataFrame:
        """A few numbers of each range of a capture, in order."""
        part = part.sort_values(["file", "k"])
        entry, seq, entries, firsts = 0, 0, [], []
        for leaves, counts in zip(part["leaves"], part["counts"], strict=True):
            entries.append(entry)
            firsts.append(seq)
            entry, seq = int(leaves[entry]), seq + int(counts[entry])
        return part[["path", "start"]].assign(entry=entries, first=firsts)

    numbers = known.select("capture", "file", "path", "k", "start", "leaves", "counts").groupBy("capture").applyInPandas(chained, "path string, start long, entry int, first long")
    entered = known.select(*kept, "start", "end").join(numbers, ["path", "start"])

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for session, path, length, after, start, end, entry, first in part[["session_id", "path", "length", "after", "start", "end", "entry", "first"]].itertuples(index=False):
                data = _bytes_and_next(path, start, end, length, after)
                at = np.array(packets_from(_steps(data), entry, end - start)[0], np.int64)
                x = np.frombuffer(data, np.uint8).astype(np.int64)
                for low in range(0, len(at), 100_000):
                    p = at[low : low + 100_000]
                    a, b, c, d, e = (x[p + k] for k in range(PACKET))
                    yield pd.DataFrame({"session_id": session, "seq": first + low + np.arange(len(p)), "start": (a & 1).astype(bool), "degrees": (b >> 1 | c << 7) / 64, "mm": (d | e << 8) / 4, "quality": (a >> 2).astype(np.int32)})

    return spread(stow(entered)).mapInPandas(read, "session_id string, seq long, start boolean, degrees double, mm double, quality int")
