"""Benchmark decontamination: n-gram seeds that no copy can lack, then Smith-Waterman alignment.

Benchmark items are broadcast in blocks of bounded size, each block against all documents, so nothing that is broadcast
grows with the corpus, and a larger benchmark means more passes. A first pass counts in how many documents each of the
block's word n-grams stands. Of an item's n-grams so many are seeds that every alignment at the threshold holds one of
them, however many documents hold copies; the counts only say which such set is the cheapest. In a second pass each seed in
a document opens a passage around it. The words that passage and item share bound the alignment score from above; passages
that can reach the threshold are aligned.

Words are runs of ASCII letters, digits and characters beyond ASCII, in lower case. Null and empty texts and items match
nothing; items with fewer words than a seed are seeds as a whole. Repeated document rows are reported one by one, repeated
item rows once. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import column_of, empty_where_null, filtered, keyed_text, text_chunks

SEED_WORDS = 3
#: Alignment scores, and the share of an item's perfect score from which a passage counts.
MATCH, MISMATCH, GAP, THRESHOLD = 2, -1, -1, 0.5
#: Bytes of benchmark text in a broadcast block.
BLOCK_BYTES = 8 << 20

_END_BITS = 20
_END = np.uint64((1 << _END_BITS) - 1)
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def lowered(texts: pa.Array) -> W.Texts:
    """Of items and documents alike: two libraries would lower some letters differently."""
    return W.Texts.of(pa.compute.utf8_lower(empty_where_null(texts)))


class Block:
    """Items of a block: word hashes, and for each seed hash the items and places where it stands."""

    def __init__(self, ids: list[int], texts: list[str]):
        found = lowered(pa.array(texts, pa.string()))
        hashes, at = word_hashes(found)
        self.ids = ids
        self.words = [hashes[at[i] : at[i + 1]] for i in range(len(ids))]
        self.sorted = [np.unique(w, return_counts=True) for w in self.words]
        self.set(range(len(ids)), None)

    def grams(self, item: int, n: int) -> list[int]:
        w = self.words[item]
        return W.grams(w, np.array([0, len(w)]), n)[0].tolist()

    def set(self, items, seen: dict[int, int] | None) -> None:
        """Take as seeds all n-grams, or the cheapest set of them that every alignment at the threshold meets."""
        self.places: dict[int, list[tuple[int, int]]] = {}
        for i in items:
            n = len(self.words[i])
            sizes = [n] if n < SEED_WORDS else range(1, SEED_WORDS + 1)
            grams = {g: self.grams(i, g) for g in sizes if g}
            if seen is None or n < SEED_WORDS:
                picked = [(g, range(len(grams[g]))) for g in grams]
            else:
                picked = cheapest({g: [seen.get(x, 0) for x in grams[g]] for g in grams})
            for g, places in picked:
                for k in places:
                    self.places.setdefault(grams[g][k], []).append((i, k))
        self.seeds = np.array(sorted(self.places), np.uint64)
        self.ends = np.zeros(1 << _END_BITS, bool)  # which ends of hashes the seeds have
        self.ends[(self.seeds & _END).astype(np.int64)] = True
        self.sizes = range(1, SEED_WORDS + 1)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the grams that are seeds, and the numbers of these."""
        likely = np.flatnonzero(self.ends[(grams & _END).astype(np.int64)])
        held = grams[likely]
        slot = np.minimum(np.searchsorted(self.seeds, held), len(self.seeds) - 1)
        same = self.seeds[slot] == held
        return likely[same], slot[same]


def cheapest(held: dict[int, list[int]]) -> list[tuple[int, list[int]]]:
    """(n, places of n-grams) that together meet every alignment at the threshold, from the documents that hold each n-gram.

    An alignment of m matches and e errors reaches half the perfect score of n words if 2 m - e >= n, so m >= n / 2. Its
    matches lie in at most e + 1 runs, so at least m - (g - 1) (2 m - n + 1) of the item's g-grams are whole in it. If
    fewer than k are, m is bounded from below, and few words of the item are without a match: any more words than those,
    with all but k - 1 of the g-grams, are met.
    """
    n = len(held[1])
    order = {g: np.argsort(c, kind="stable") for g, c in held.items()}
    sums = {g: np.concatenate([[0], np.cumsum(np.array(c)[order[g]])]) for g, c in held.items()}
    half = -(-n // 2)
    best = (sums[1][n - half + 1], [(1, n - half + 1)])
    for k in range(1, n):
        for g, least in ((2, n - k), (3, -(-(2 * n - 1 - k) // 3))):
            grams, words = len(held[g]) - k + 1, n - max(least, half) + 1
            if grams > 0 and (cost := sums[g][grams] + sums[1][words]) < best[0]:
                best = cost, [(g, grams), (1, words)]
    return [(g, order[g][:number].tolist()) for g, number in best[1]]


def word_hashes(texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, at = texts.tokens(_LETTERS[texts.data])
    return W.span_hashes(texts.prefix_hashes(), starts, ends), at


def _found_seeds(block: Block, hashes: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of seeds: documents of the chunk, word places in them, numbers of the seeds that stand there."""
    for n in block.sizes:
        grams, gram_at = W.grams(hashes, at, n)
        if not len(grams) or not len(block.seeds):
            continue
        found, slots = block.find(grams)
        docs = np.searchsorted(gram_at, found, side="right") - 1
        yield docs, found - gram_at[docs], slots


def _hits(block: Block, hashes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(document of the chunk, word place in it, seed) wherever a seed stands."""
    for docs, places, slots in _found_seeds(block, hashes, at):
        yield from zip(docs.tolist(), places.tolist(), block.seeds[slots].tolist(), strict=True)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Best local alignment of two word sequences: score and the end of it in the passage."""
    row, best, end = np.zeros(len(passage) + 1), 0.0, 0
    ramp = np.arange(len(passage) + 1) * -GAP
    for w in item:
        fresh = np.maximum(row[:-1] + np.where(passage == w, MATCH, MISMATCH), np.maximum(row[1:] + GAP, 0))
        fresh = np.concatenate([[0.0], fresh])
        row = np.maximum.accumulate(fresh + ramp) - ramp  # gaps in the item
        k = int(row.argmax())
        if row[k] > best:
            best, end = float(row[k]), k
    return best, end


def _leaks(block: Block, words: np.ndarray, hits: list[tuple[int, int]]) -> Iterator[tuple[int, float, int, int]]:
    """(item, score, end word, seeds) for each item that the document holds."""
    by_item: dict[int, list[int]] = {}
    for place, seed in hits:
        for item, k in block.places[seed]:
            by_item.setdefault(item, []).append(place - k)
    for item, starts in by_item.items():
        n = len(block.words[item])
        slack, best, starts, (own, times) = n + 4, (0.0, 0), sorted(starts), block.sorted[item]  # no more than n words are put in
        groups = [[starts[0], starts[0]]]
        for s in starts[1:]:
            if s - groups[-1][1] <= slack and s - groups[-1][0] <= 4 * n:
                groups[-1][1] = s
            else:
                groups.append([s, s])
        for first, last in groups:
            low, high = max(0, first - slack), min(len(words), last + n + slack)
            passage = words[low:high]
            slot = np.searchsorted(own, passage)
            slot[slot == len(own)] = 0
            slot = slot[own[slot] == passage]
            if len(slot) >= THRESHOLD * n and np.minimum(np.bincount(slot, minlength=len(own)), times).sum() >= THRESHOLD * n:
                score, end = align(block.words[item], words[low:high])
                best = max(best, (score / (MATCH * n), low + end))
        if best[0] >= THRESHOLD:
            yield item, best[0], best[1], len(starts)


def _document_counts(docs: DataFrame, block: Block) -> dict[int, int]:
    """In how many documents each n-gram of the block stands; at most as many rows as the block has n-grams."""
    held = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(held.value.seeds), np.int64)
        for batch in batches:
            for part in text_chunks(batch):
                hashes, at = word_hashes(lowered(column_of(part, "text")))
                for docs, _, slots in _found_seeds(held.value, hashes, at):
                    found += np.bincount(np.unique(docs * len(found) + slots) % len(found), minlength=len(found))
        there = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held.value.seeds[there].view(np.int64)), pa.array(found[there])], ["gram", "n"])

    rows = docs.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r.gram % (1 << 64): r.n for r in rows}


def _found(block: Block, part: pa.RecordBatch) -> Iterator[tuple[int, int, float, int, int]]:
    """(row of the chunk, item, score, end word, seeds)."""
    hashes, at = word_hashes(lowered(column_of(part, "text")))
    by_doc: dict[int, list[tuple[int, int]]] = {}
    for d, place, seed in _hits(block, hashes, at):
        by_doc.setdefault(d, []).append((place, seed))
    for d, hits in by_doc.items():
        for leak in _leaks(block, hashes[at[d] : at[d + 1]], hits):
            yield d, *leak


def _blocks(docs: DataFrame, benchmark: DataFrame, block_bytes: int) -> Iterator[Block]:
    """The benchmark in blocks with their seeds."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    blocks = 1 + size // block_bytes
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        block = Block([r.item_id for r in rows], [r.text for r in rows])
        block.set(range(len(rows)), _document_counts(docs, block))
        yield block


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document and item that it holds a copy of: doc_id, item_id, score (of 1), end_word, n_seeds."""
    docs, out = keyed_text(docs), None
    for block in _blocks(docs, benchmark, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_chunks(batch):
                    ids = column_of(part, "doc_id").to_pylist()
                    rows = [(ids[d], held.value.ids[i], score, end, seeds) for d, i, score, end, seeds in _found(held.value, part)]
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["doc_id", "item_id", "score", "end_word", "n_seeds"])

        found = docs.mapInArrow(run, "doc_id long, item_id long, score double, end_word long, n_seeds long")
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without those that hold a copy of an item."""
    out = docs
    for block in _blocks(keyed_text(docs), benchmark, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def verdicts(part: pa.RecordBatch, held=held) -> np.ndarray:
            clean = np.ones(len(part), bool)
            clean[[d for d, *_ in _found(held.value, part)]] = False
            return clean

        out = filtered(out, verdicts)
    return out
