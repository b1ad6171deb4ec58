"""Product codes of vectors: integer codebooks learnt by part, each vector stored as one entry number for each part.

Vectors are made integers and cut into equal consecutive parts. Each round is one pass: tasks assign every part to the
nearest entry of its codebook and add up components by entry; what leaves a task is one number for each entry component,
and the sums, of a size that only the codebooks' shape sets, make the next codebooks. All arithmetic that decides is in
integers, so the result doesn't depend on how rows are dealt, and a lost task gives the same numbers again.

The nearest entry is found from coarse to fine. A part is cut into 1, 2, 4, ... blocks. By the triangle inequality two
blocks of s components with sums S, T and norms p, q of what is left beside the mean are at least
(S - T)^2 / s + (p - q)^2 apart. Entries whose bound is over the exact distance of the best one so far go; what survives
all levels gets its exact distance. Bounds are kept low by more than the rounding error of their floating-point terms.

Rows are dropped whose vector is null, holds a null, a non-finite component or one of 1e24 or more in absolute value (whose
squares no column could sum), or has another length than the rest: the length is the most frequent one that can be cut into
the parts (of equally frequent ones the least). Repeated rows count each time; of equal vec_ids the lesser vector comes
first among the starting entries, and null vec_ids come last. With fewer vectors than entries the codebooks are shorter.
Entries that no part is assigned to stay. Errors over the range of a long are null. An empty table gives an empty result.
Columns besides vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, column_of, stow

#: Components from this size on count as non-finite.
TOO_LARGE = 1e24
#: Vectors that are compared with the entries at once.
SLAB = 8192
#: Squared distances up to this are summed as 64-bit integers, others as Python's.
_NARROW = 1 << 62
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Shape:
    """scale: integers are floor(scale * component); rounds of assigning and averaging."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096


def integers(vectors: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the lists count, and these as integers: int64, or Python's where they are too large for that."""
    right = pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(vectors), dims), False)
    values = np.asarray(vectors.filter(right).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
    good = (np.abs(values) < TOO_LARGE).all(axis=1)  # false for NaN, which stands for null too
    keep = np.asarray(right).astype(bool)
    keep[np.flatnonzero(keep)[~good]] = False
    values = np.floor(values[good] * scale)
    if values.size and np.abs(values).max() >= 1 << 52:
        return keep, np.array([int(v) for v in values.ravel()], object).reshape(values.shape)
    return keep, values.astype(np.int64)


def _numbers(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as Python's integers if a distance could leave 64 bits."""
    most = max((int(np.abs(a).max()) for a in (x, entries) if a.size), default=0)
    return (x, entries) if x.shape[-1] ** 2 * (2 * most) ** 2 < _NARROW else (x.astype(object), entries.astype(object))


def _blocks(x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of blocks over the square roots of their sizes, and norms of what is left beside their means."""
    size = np.diff(np.append(edges, x.shape[1]))
    total, squares = np.add.reduceat(x, edges, axis=1), np.add.reduceat(x * x, edges, axis=1)
    rest = size * squares - total * total  # exact: no cancellation of rounded numbers
    return total.astype(np.float64) / np.sqrt(size), np.sqrt(rest.astype(np.float64) / size)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances row by row."""
    return ((x - entries) ** 2).sum(axis=1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the nearest entry, ties to the lower number, and its exact squared distance."""
    n, width = x.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, x.dtype)
    x, entries = _numbers(x, entries)
    slack = 1e-9 * (((x * x).sum(axis=1).astype(np.float64))[:, None] + (entries * entries).sum(axis=1).astype(np.float64))
    row, entry = np.repeat(np.arange(n), len(entries)), np.tile(np.arange(len(entries)), n)
    least, blocks = None, 1
    while True:
        edges = np.arange(blocks) * width // blocks
        (mean, rest), (theirs, others) = _blocks(x, edges), _blocks(entries, edges)
        bound = ((mean[row] - theirs[entry]) ** 2 + (rest[row] - others[entry]) ** 2).sum(axis=1)
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        lowest = np.minimum.reduceat(bound, first)
        guess = entry[_firsts(bound == lowest[row], row, n)]
        tried = distances(x, entries[guess]).astype(np.float64)
        least = tried if least is None else np.minimum(least, tried)
        alive = bound <= least[row] + slack[row, entry]
        row, entry = row[alive], entry[alive]
        if blocks * 2 >= width or len(row) == n:
            break
        blocks *= 2
    exact = distances(x[row], entries[entry])
    order = np.lexsort((entry, exact, row)) if exact.dtype != object else np.array(sorted(range(len(row)), key=lambda k: (row[k], exact[k], entry[k])))
    best = order[np.flatnonzero(np.concatenate([[True], row[order][1:] != row[order][:-1]]))]
    return entry[best], exact[best]


def _firsts(marked: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The first marked place of each row."""
    places = np.flatnonzero(marked)
    out = np.empty(n, np.int64)
    out[row[places][::-1]] = places[::-1]
    return out


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each part and squared distances summed over the parts. books: part, entry, component."""
    codes, errors = np.zeros((len(x), len(books)), np.int64), np.zeros(len(x), object)
    width = books.shape[2]
    for low in range(0, len(x), SLAB):
        for part in range(len(books)):
            code, error = nearest(x[low : low + SLAB, part * width : (part + 1) * width], books[part])
            codes[low : low + SLAB, part] = code
            errors[low : low + SLAB] += error.astype(object)
    return codes, errors


def most_frequent_length(vectors: DataFrame, parts: int) -> int | None:
    size = F.size(vectors["embedding"])
    found = vectors.select(size.alias("n")).where((F.col("n") > 0) & (F.col("n") % parts == 0)).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    return found and found.n


def _vectors(vectors: DataFrame) -> DataFrame:
    return vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding"), vectors["label"].alias("label"))


def starting_books(vectors: DataFrame, dims: int, shape: Shape) -> np.ndarray:
    """The vectors of the smallest ids, cut into parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = integers(column_of(batch, "embedding"), dims, shape.scale)
            yield pa.RecordBatch.from_arrays([column_of(batch, "vec_id").filter(pa.array(keep)), pa.array([[Decimal(int(v)) for v in r] for r in x], pa.list_(pa.decimal128(38)))], ["vec_id", "v"])

    held = vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, v array<decimal(38,0)>")
    rows = held.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(shape.entries).collect()
    return np.array([[int(v) for v in r.v] for r in rows], object).reshape(len(rows), shape.parts, dims // shape.parts).transpose(1, 0, 2) if rows else np.zeros((shape.parts, 0, dims // shape.parts), object)


def _narrowed(books: np.ndarray) -> np.ndarray:
    return books.astype(np.int64) if books.size and int(np.abs(books).max()) < 1 << 52 else books


def _totals(vectors: DataFrame, books: np.ndarray, shape: Shape) -> dict[int, int]:
    """By slot: number of parts assigned to an entry, and sums of their components. One pass."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), object)
        for batch in batches:
            _, x = integers(column_of(batch, "embedding"), parts * width, shape.scale)
            codes, _ = assigned(x, books)
            for part in range(parts):
                order = np.argsort(codes[:, part], kind="stable")
                code = codes[order, part]
                first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
                if len(first):
                    total[part, code[first], 1:] += np.add.reduceat(x[order, part * width : (part + 1) * width], first, axis=0).astype(object)
                    total[part, code[first], 0] += np.diff(np.append(first, len(code))).astype(object)
        flat = total.ravel()
        slots = np.flatnonzero(flat != 0)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array([Decimal(int(v)) for v in flat[slots]], pa.decimal128(38))], ["slot", "total"])

    held = vectors.select("embedding").mapInArrow(run, "slot long, total decimal(38,0)")
    return {r.slot: int(r.total) for r in held.groupBy("slot").agg(F.sum("total").alias("total")).collect()}


def learnt_books(vectors: DataFrame, shape: Shape = Shape()) -> np.ndarray | None:
    """Codebooks as integers by part, entry and component; None if no vector can be cut into the parts."""
    dims = most_frequent_length(vectors, shape.parts)
    if dims is None:
        return None
    rows = _vectors(vectors)
    books = _narrowed(starting_books(rows, dims, shape))
    if not books.shape[1]:
        return None
    for _ in range(shape.rounds):
        totals = _totals(rows, books, shape)
        fresh = books.astype(object)
        for part, entry in np.ndindex(*books.shape[:2]):
            slot = (part * books.shape[1] + entry) * (books.shape[2] + 1)
            if count := totals.get(slot):
                fresh[part, entry] = [totals.get(slot + 1 + k, 0) // count for k in range(books.shape[2])]
        books = _narrowed(fresh)
    return books


def encoded(vectors: DataFrame, books: np.ndarray, shape: Shape = Shape()) -> DataFrame:
    """vec_id, label, code (entry numbers as hex digits), error."""
    rows = _vectors(vectors)
    digits = 2 * ((max(books.shape[1] - 1, 1).bit_length() + 7) // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = integers(column_of(batch, "embedding"), books.shape[0] * books.shape[2], shape.scale)
            codes, errors = assigned(x, books)
            text = codes.astype(f">u{digits // 2}").tobytes().hex()
            step = digits * books.shape[0]
            found = [text[k * step : (k + 1) * step] for k in range(len(x))]
            held = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([column_of(held, "vec_id"), column_of(held, "label"), pa.array(found, pa.string()), pa.array([int(e) if e <= _LONG else None for e in errors], pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def decoded(code: str, books: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    digits = len(code) // len(books)
    return np.concatenate([books[part][int(code[part * digits : (part + 1) * digits], 16)] for part in range(len(books))])


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(v) for v in books.ravel()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """vec_id, code, error, label_error (errors of equal labels, nulls together), codebooks_sha256."""
    books = learnt_books(vectors, shape)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows = stow(encoded(vectors, books, shape))
    known = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(28,0)")).try_cast("long"))
    sums = rows.groupBy(F.col("label").alias("of")).agg(known.alias("label_error"))
    joined = rows.join(checked(sums), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _sql(shape: Shape = Shape()) -> str:
    whole = "list_sum(list_transform(list_zip(v, c), lambda z: cast((z[1] - z[2]) * (z[1] - z[2]) as hugeint)))"
    steps = [
        f"kept as materialized (select row_number() over (order by vec_id) r, vec_id, label, list_transform(embedding, lambda x: cast(floor({shape.scale} * cast(x as double)) as bigint)) w from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"cut as materialized (select r, p, w[p * len(w) // {shape.parts} + 1:(p + 1) * len(w) // {shape.parts}] v from kept, range({shape.parts}) t(p))",
        f"books0 as materialized (select p, r - 1 e, v c from cut where r <= {shape.entries})",
    ]
    for k in range(shape.rounds + 1):
        steps.append(f"near{k} as materialized (select r, cut.p, arg_min(e, ({whole}, e)) e, min({whole}) d, any_value(v) v from cut join books{k} b on cut.p = b.p group by r, cut.p)")
        if k < shape.rounds:
            steps.append(f"sums{k} as (select p, e, i, sum(v[i]) s, count(*) n from near{k}, lateral (select unnest(range(1, len(v) + 1)) i) group by p, e, i)")
            steps.append(f"means{k} as (select p, e, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) c from sums{k} group by p, e)")
            steps.append(f"books{k + 1} as materialized (select b.p, b.e, coalesce(m.c, b.c) c from books{k} b left join means{k} m on b.p = m.p and b.e = m.e)")
    last = shape.rounds
    steps.append(f"codes as (select r, string_agg(printf('%02x', e), '' order by p) code, cast(sum(d) as bigint) error from near{last} group by r)")
    steps.append(f"sha as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) codebooks_sha256 from books{last})")
    return f"with {', '.join(steps)} select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, codebooks_sha256 from kept join codes using (r), sha"


#: The same in SQL, for vectors of one length.
SQL = _sql()
