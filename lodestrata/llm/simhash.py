"""Near-duplicate documents by SimHash: 64-bit fingerprints that differ in few bits are linked, and links make components.

A fingerprint bit is 1 if it is set in over half the hashes of a text's shingles. Two fingerprints that differ in at most
three bits agree on at least two of five blocks of bits, so each fingerprint is put under the ten pairs of its blocks, those
of one key meet, and a pair is a link if its Hamming distance says so: no link is missed. Documents of one fingerprint are
one node. A key of 25 bits or more holds few nodes by chance: about 1,000 of 50,000,000,000.

Keys sorted within partitions are compared in runs, and of a run's links only a forest leaves the task. A key with more
nodes than that (close copies of one text) is never one task: its nodes are linked by neighbours in one bit, which share a
fingerprint with that bit left out, and by the distance from the node of most documents; only nodes that aren't in the
key's largest component then meet all others, in tiles of bounded size that are dealt over tasks. What lies in one
component already needn't meet. So dense groups cost little more than their size, and every link still counts.

Null text counts as empty. Without words the fingerprint is zero, linked like any other; with fewer words than a shingle the
whole sequence is one. Null doc_ids are larger than all others; a component of nothing else has none. Repeated rows are
copies of each other. An empty table gives an empty result. Columns besides doc_id and text are ignored. A text is hashed in
blocks of about a megabyte, so memory follows the text, not its number of shingles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, column_of, components, empty_where_null, keyed_text, least_labels, stow, text_chunks

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Blocks that a fingerprint is split into; pairs at DISTANCE agree on BLOCKS - DISTANCE of them.
BLOCKS = 5
#: Nodes of a key that are compared at once as a run; keys with more are hot.
RUN_NODES = 256
#: Nodes on either side of a tile of a hot key.
TILE_NODES = 4096
#: Links that a task holds before it makes a forest of them.
HELD_LINKS = 1 << 20
TEXT_BLOCK = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Bits of each key: all choices of blocks that may be the ones without a difference. Signed 64-bit numbers."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    bits = [sum(1 << b for b in range(low, high)) for low, high in zip(edges[:-1], edges[1:], strict=True)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(bits, blocks - distance))]


def _word_blocks(text: bytes) -> Iterator[list[bytes]]:
    first = 0
    while first < len(text):
        edge = _SPACE.search(text, first + TEXT_BLOCK)
        last = edge.start() if edge else len(text)
        yield text[first:last].lower().split()  # bytes: A-Z, and the same spaces
        first = last


def shingle_hashes(text: bytes, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of each block of words."""
    held: list[bytes] = []
    whole = True
    for words in _word_blocks(text):
        held += words
        if len(held) < size:
            continue
        whole = False
        line, ends, at = b" ".join(held), [], -1
        for w in held:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends)]
        yield np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])), np.uint64, len(held) - size + 1)
        held = held[1 - size :]
    if whole and held:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Signed: the bits are those of an unsigned number."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, size):
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                texts = empty_where_null(column_of(part, "text")).cast(pa.large_binary())
                found = pa.array([fingerprint(t.as_py(), size) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([column_of(part, "doc_id"), found], ["doc_id", "fp"])

    return keyed_text(docs).mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Links between fingerprints, of which only what joins components is kept."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.label = fps, np.arange(len(fps))
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.count += len(a)
        if self.count > HELD_LINKS:
            self.settle()

    def settle(self) -> None:
        if self.count:
            a, b = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.label = least_labels(a, b, self.label)
        self.held, self.count = [], 0

    def links(self) -> pa.RecordBatch:
        self.settle()
        a = np.flatnonzero(self.label != np.arange(len(self.label)))
        return pa.RecordBatch.from_arrays([pa.array(self.fps[a]), pa.array(self.fps[self.label[a]])], ["a", "b"])


def close(a: np.ndarray, b: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= distance


def run_links(run: np.ndarray, fps: np.ndarray, distance: int = DISTANCE) -> pa.RecordBatch:
    """A forest of the links within runs of equal numbers."""
    found, step, here = Forest(fps), 1, np.arange(len(fps))
    while True:
        here = here[here + step < len(fps)]
        here = here[run[here] == run[here + step]]
        if not len(here):
            return found.links()
        good = here[close(fps[here], fps[here + step], distance)]
        found.add(good, good + step)
        step += 1


def _runs(distance: int):
    """Rows come sorted by table and key; a run may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            rows = [np.concatenate([r, np.asarray(column_of(batch, c), np.int64)]) for r, c in zip(rest, ("t", "key", "fp"), strict=True)]
            number = np.cumsum(np.concatenate([[0], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])])) if len(rows[0]) else rows[0]
            open_ = int(np.searchsorted(number, number[-1])) if len(number) else 0
            rest = [r[open_:] for r in rows]
            yield run_links(number[:open_], rows[2][:open_], distance)
        yield run_links(np.zeros(len(rest[2]), np.int64), rest[2], distance)

    return run


def _tile(distance: int):
    def run(table: pa.Table) -> pa.Table:
        left = np.asarray(table.column("left"), bool)
        fps = np.asarray(table.column("fp"), np.int64)
        one, other = np.flatnonzero(left), np.flatnonzero(~left)
        found = Forest(fps)
        for k in one:
            good = other[close(fps[other], fps[k : k + 1], distance)]
            found.add(np.full(len(good), k), good)
        links = pa.Table.from_batches([found.links()])
        return links.filter(pa.compute.not_equal(links["a"], links["b"]))

    return run


def _hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def keyed(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """t, key, and the columns of nodes: a row for each choice of blocks."""
    found = F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks(blocks, distance)))
    return nodes.select(*nodes.columns, F.posexplode(found).alias("t", "key"))


def _hot_links(members: DataFrame, links: DataFrame, distance: int) -> DataFrame:
    """links, with those that members(t, key, n, fp, weight) of hot keys add."""
    fps = members.select("fp").distinct()
    bit = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(~(1 << b) if b < 63 else (1 << 63) - 1).cast("long")) for b in range(64)))).alias("bit", "rest"))
    beside = bit.groupBy("bit", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("a", "b")
    heads = members.groupBy("t", "key").agg(F.max(F.struct("weight", "fp"))["fp"].alias("head"))
    near = members.join(checked(heads), ["t", "key"]).where((F.col("fp") != F.col("head")) & (_hamming(F.col("fp"), F.col("head")) <= distance)).select(F.col("fp").alias("a"), F.col("head").alias("b"))
    links = stow(links.unionByName(beside).unionByName(near).distinct())
    labels = components(links)
    known = members.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    known = stow(known.select("t", "key", "fp", "label"))
    sizes = known.groupBy("t", "key", "label").agg(F.count("*").alias("n"))
    keys = sizes.groupBy("t", "key").agg(F.sum("n").alias("n"), F.count("*").alias("several"), F.max(F.struct("n", "label")).alias("most")).where("several > 1")
    slices = lambda n: F.floor((F.col(n) - 1) / TILE_NODES) + 1
    keys = keys.select("t", "key", F.col("most.label").alias("common"), (F.col("n") - F.col("most.n")).alias("others"), "n").select("t", "key", "common", slices("others").alias("down"), slices("n").alias("across"))
    dealt = known.join(checked(stow(keys)), ["t", "key"])
    outside = dealt.where("label <> common").select("t", "key", "fp", F.lit(True).alias("left"), F.pmod(F.xxhash64("fp"), "down").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)).alias("j"))
    every = dealt.select("t", "key", "fp", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("down") - 1)).alias("i"), F.pmod(F.xxhash64("fp"), "across").alias("j"))
    tiles = outside.unionByName(every).groupBy("t", "key", "i", "j").applyInArrow(_tile(distance), "a long, b long")
    return labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(tiles)


def links(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """a, b: fingerprints of nodes(fp, weight); their components are those of all pairs at the distance."""
    rows = keyed(nodes, distance, blocks)
    hot = stow(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > RUN_NODES))
    light = rows.join(checked(hot.select("t", "key")), ["t", "key"], "left_anti").select("t", "key", "fp")
    found = light.repartition("t", "key").sortWithinPartitions("t", "key", "fp").mapInArrow(_runs(distance), "a long, b long").distinct()
    if hot.isEmpty():
        return found
    return _hot_links(stow(rows.join(checked(hot.select("t", "key")), ["t", "key"])), found, distance)


def simhash_components(docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, fp, component_id (smallest doc_id that links lead to)."""
    rows = stow(fingerprints(docs, size))
    nodes = stow(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("weight")))
    labels = components(stow(links(nodes.select("fp", "weight"), distance))).withColumnRenamed("node", "fp")
    classed = nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = labels.join(nodes, "fp").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    moved = classed.join(least, "label", "left").select("fp", "weight", "doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
    moved = stow(moved.where("weight > 1 or component_id is distinct from doc_id").select("fp", "component_id"))
    return rows.join(checked(moved), "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def hexadecimal(fp: Column) -> Column:
    """16 lower-case digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
