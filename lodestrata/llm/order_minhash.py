"""Near-duplicate documents by Order MinHash.

The k-mers of a text are its five-word shingles, each labelled with how often it has occurred before, so repeats count.
For each of several hash functions a sketch takes the three k-mers of least hash and keeps them in text order; two texts
share such a key the likelier the smaller their edit distance, and reordered texts share few. Exact copies fall together
by digest first. The texts of a key are compared with one representative; where they aren't of one class then, they meet by
the rarest of their shingles instead, which no pair at the similarity can miss and which parts texts that share a template
alone. There each key has more representatives from round to round, until its texts are in one class or have met. Parities
of the numbers of shingles of several kinds rule out most pairs of unlike texts without their words. A pair is a link if its shingle sets have a Jaccard
similarity of 0.8 or more and a banded alignment of its words needs edits for at most a fifth of them. Classes are the
connected components of the links.

Null text counts as empty. Texts of one to four words have one shingle of all words; texts without words are in a class
only with exact copies of theirs. A class bears its smallest doc_id (null where all are null). Repeated rows are copies
of each other. An empty table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import checked, column_of, components, empty_where_null, keyed_text, stow, text_chunks

SHINGLE, SIMILARITY = 5, 0.8
#: Hash functions, and k-mers kept by each.
FUNCTIONS, KEPT = 12, 3
#: Kinds of shingles whose parities are kept, growth of a key's heads from round to round, members of a key in a slice.
BITS, MORE_HEADS, SLICE_ROWS = 256, 8, 4096
ODD = [f"odd{k}" for k in range(BITS // 64)]
#: Agreeing shingles that two texts of n and m must have at least, as a share of n + m; ratio of the bounds of a size class.
_SHARE, SIZE_CLASS = SIMILARITY / (1 + SIMILARITY), 1.05
_ODD = np.random.default_rng(5).integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(6).integers(1, 1 << 63, KEPT + 1, dtype=np.uint64) | np.uint64(1)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of a text's shingles in text order."""
    if not len(words):
        return words
    return W.grams(words, np.array([0, len(words)]), min(SHINGLE, len(words)))[0]


def labelled(grams: np.ndarray) -> np.ndarray:
    """Tells repeats of a k-mer apart by their occurrence number."""
    order = np.argsort(grams, kind="stable")
    held = grams[order]
    edge = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    if len(edge) == len(grams):
        return grams
    number = np.arange(len(grams)) - np.repeat(edge, np.diff(np.append(edge, len(grams))))
    out = grams.copy()
    again = number > 0
    out[order[again]] = W.mix(held[again] + number[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def sketch(grams: np.ndarray) -> np.ndarray:
    """A key for each hash function; none for a text without words."""
    if not len(grams):
        return np.zeros(0, np.uint64)
    marks, n = labelled(grams), min(KEPT, len(grams))
    picked = [np.argpartition(marks * odd, n - 1)[:n] for odd in _ODD] if len(marks) > 4096 else np.argpartition(marks[None, :] * _ODD[:, None], n - 1, axis=1)[:, :n]
    kept = W.mix(marks[np.sort(np.array(picked), axis=1)])
    return W.mix((kept * _PLACE[:n]).sum(axis=1, dtype=np.uint64) + np.arange(FUNCTIONS, dtype=np.uint64) * _PLACE[KEPT])


def parities(grams: np.ndarray) -> np.ndarray:
    """Whether the different shingles of each of BITS kinds are odd in number, as bits of 64-bit words."""
    odd = np.bincount((grams >> np.uint64(56)).astype(np.int64) % BITS, minlength=BITS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = W.Texts.of(empty_where_null(column))
    starts, ends, at = texts.words()
    return W.span_hashes(texts.prefix_hashes(), starts, ends), at


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest, keys, size and parities; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                hashes, at = _hashed(column_of(part, "text"))
                grams = [shingles(hashes[at[i] : at[i + 1]]) for i in range(len(part))]
                keys = pa.array([sketch(g).view(np.int64) for g in grams], pa.list_(pa.int64()))
                sets = [np.unique(g) for g in grams]
                odd = np.array([parities(g) for g in sets], np.int64).reshape(-1, len(ODD))
                found = keys, pa.array([len(g) for g in sets], pa.int64()), *(pa.array(odd[:, k]) for k in range(len(ODD)))
                yield pa.RecordBatch.from_arrays([column_of(part, "doc_id"), column_of(part, "digest"), *found], ["doc_id", "digest", "keys", "size", *ODD])

    return digested(docs).mapInArrow(run, f"doc_id long, digest binary, keys array<long>, size long, {', '.join(f'{c} long' for c in ODD)}")


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, text and digest, which is equal for equal texts."""
    return keyed_text(docs).withColumn("digest", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))


class Prefix:
    """Word hashes of a text with constant-time comparison of its runs."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        up = W._power("up", self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(words * up[: self.n], out=self.sums[1:])
        self.down = W._power("down", self.n + 1)

    def run(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


def common_run(a: Prefix, b: Prefix, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common run from places i and j, by binary search."""
    low, high = np.zeros_like(i), np.minimum(a.n - i, b.n - j)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = a.run(i, mid) == b.run(j, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Word edits from a to b, or limit + 1 if there are more: furthest reach on each diagonal of the band."""
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return limit + 1
    x, y = Prefix(a), Prefix(b)
    reach = common_run(x, y, np.array([0]), np.array([0]))
    for d in range(limit + 1):
        if -d <= m - n <= d and reach[m - n + d] >= n:
            return d
        k = np.arange(-d - 1, d + 2)
        wide = np.full(2 * d + 5, -10, np.int64)
        wide[2:-2] = reach
        i = np.maximum(np.maximum(wide[1:-1] + 1, wide[2:] + 1), wide[:-2])  # replaced, left out, put in
        i = np.minimum(np.minimum(i, n), m - k)
        good = (i >= 0) & (i + k >= 0)
        reach = np.where(good, i, -10)
        reach[good] += common_run(x, y, i[good], (i + k)[good])
    return limit + 1


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Of two texts' word hashes."""
    x, y = np.unique(shingles(a)), np.unique(shingles(b))
    if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    if both < SIMILARITY * (len(x) + len(y) - both):
        return False
    limit = int((1 - SIMILARITY) * max(len(a), len(b)) + 1e-9)
    if len(a) == len(b) and int((a != b).sum()) <= limit:  # the band's middle alone
        return True
    return edit_distance(a, b, limit) <= limit


def with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """digest, text of the wanted digests."""
    return digested(docs).join(checked(wanted), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))


def beside(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs(a, b) with the columns of rows(digest, ...) of both, as left_... and right_...; a digest of many pairs is dealt over slices."""
    for side, name in (("a", "left"), ("b", "right")):
        slices = pairs.groupBy(F.col(side).alias("digest")).agg(F.expr(f"count(*) div {SLICE_ROWS}").alias("last"))
        dealt = rows.join(slices, "digest").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("last"))))
        dealt = dealt.select(F.col("digest").alias(side), "slice", "last", *(F.col(c).alias(f"{name}_{c}") for c in rows.columns if c != "digest"))
        other = "b" if side == "a" else "a"
        many = slices.where("last > 0").withColumnRenamed("digest", side)
        pairs = pairs.join(checked(many), side, "left").withColumn("slice", F.pmod(F.xxhash64(other), F.coalesce("last", F.lit(0)) + 1)).drop("last").join(dealt.drop("last"), [side, "slice"]).drop("slice")
    return pairs


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs(a, b) that are links; texts: digest, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, columns=("left_text", "right_text")):
                (left, left_at), (right, right_at) = _hashed(column_of(part, "left_text")), _hashed(column_of(part, "right_text"))
                good = pa.array([similar(left[left_at[i] : left_at[i + 1]], right[right_at[i] : right_at[i + 1]]) for i in range(len(part))])
                yield pa.RecordBatch.from_arrays([column_of(part, "a").filter(good), column_of(part, "b").filter(good)], ["a", "b"])

    return beside(pairs, texts).select("a", "b", "left_text", "right_text").mapInArrow(run, "a binary, b binary")


def rare_shingle_keys(texts: DataFrame) -> DataFrame:
    """key, digest, size, place, side: two texts whose shingle sets have the similarity share a key; exact, by pigeonhole.

    With shingles in one order, the rarest first, two similar texts of n and m shingles share at least (n + m) * 0.8 / 1.8,
    so the first that they share has at most n less that many before it in the one text, and likewise in the other. Keys
    are these shingles for each pair of size classes; place counts the shingles before it, side tells the classes apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                hashes, at = _hashed(column_of(part, "text"))
                grams = [np.unique(shingles(hashes[at[i] : at[i + 1]])) for i in range(len(part))]
                digest = column_of(part, "digest").take(pa.array(np.repeat(np.arange(len(part)), [len(g) for g in grams])))
                yield pa.RecordBatch.from_arrays([digest, pa.array(np.concatenate([np.zeros(0, np.uint64), *grams]).view(np.int64))], ["digest", "gram"])

    held = stow(texts.mapInArrow(run, "digest binary, gram long"))
    sizes = held.groupBy("digest").agg(F.count("*").alias("size"))
    several = held.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    shared = held.join(several, "gram").groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("grams"))
    placed = shared.join(sizes, "digest").select("digest", "size", (F.col("size") - F.size("grams")).alias("alone"), F.posexplode("grams").alias("k", "g"))
    placed = placed.select("digest", "size", F.col("g.gram").alias("gram"), (F.col("alone") + F.col("k")).alias("place")).where(F.col("size") - F.col("place") >= SIMILARITY * F.col("size") - 1e-6)
    own = F.floor(F.log(F.col("size")) / np.log(SIZE_CLASS))
    low, high = F.floor(F.log(SIMILARITY * F.col("size")) / np.log(SIZE_CLASS) - 1e-9), F.floor(F.log(F.col("size") / SIMILARITY) / np.log(SIZE_CLASS) + 1e-9)
    dealt = placed.withColumn("own", own).withColumn("theirs", F.explode(F.sequence(low, high)))
    least = F.greatest(F.pow(F.lit(SIZE_CLASS), F.col("theirs")) - 1e-6 * F.col("size"), SIMILARITY * F.col("size"))  # shingles of the other text
    dealt = dealt.where(F.col("size") - F.col("place") >= _SHARE * (F.col("size") + least) - 1e-6)
    key = F.xxhash64("gram", F.least("own", "theirs"), F.greatest("own", "theirs"))
    return dealt.select(key.alias("key"), "digest", "size", "place", F.signum(F.col("own") - F.col("theirs")).cast("int").alias("side"))


class _Meetings:
    """Classes so far, as node and label (texts without links are in no row), and pairs that have met."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, members: DataFrame):
        # texts in the fullest keys are heads first: the middle of a star is in more of them than its copies
        weights = members.groupBy("digest").agg(F.sum("count").alias("weight"))
        self.held = stow(weights.join(nodes.select("digest", *ODD), "digest"))
        self.texts = stow(with_text(docs, self.held.select("digest")))
        self.labels: DataFrame | None = None
        self.seen: DataFrame | None = None

    def labelled(self, members: DataFrame) -> DataFrame:
        """members with the class of each text so far."""
        if self.labels is None:
            return members.withColumn("label", F.col("digest"))
        known = self.labels.withColumnRenamed("node", "digest").withColumnRenamed("label", "known")
        return members.join(known, "digest", "left").withColumn("label", F.coalesce("known", "digest")).drop("known")

    def run(self, members: DataFrame, wanted: int = 1, rounds: int | None = None) -> DataFrame:
        """Lets the members(key, digest, size, place, side) of each key meet; gives those of keys that aren't of one class after the rounds."""
        members = stow(self.labelled(members.join(self.held, "digest")))
        while True:
            labels = members.groupBy("key", "label").agg(F.count("*").alias("n"), F.max(F.struct("weight", F.xxhash64("key", "digest").alias("h"), "digest")).alias("first"))
            keys = labels.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("classes"), F.max(F.struct("n", "label")).alias("most"), F.max("first")["digest"].alias("first")).where("classes > 1")
            keys = stow(keys.select("key", "n", (F.col("n") - F.col("most.n")).alias("others"), F.col("most.label").alias("common"), "first"))
            if keys.isEmpty() or rounds == 0:
                return members.join(checked(keys), "key", "left_semi")
            chance = F.pmod(F.xxhash64("digest", "key"), F.lit(1 << 20)) * F.col("others") < F.lit(wanted << 20)
            head = (F.col("digest") == F.col("first")) | ((F.col("label") != F.col("common")) & chance if wanted > 1 else F.lit(False))
            rows = stow(members.join(checked(keys), "key").withColumn("head", head).withColumn("slices", F.expr(f"1 + n div {SLICE_ROWS}")))
            theirs = [F.col(c).alias(f"other_{c}") for c in ("digest", "label", "size", "place", "side", *ODD)]
            heads = rows.where("head").select("key", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), *theirs)
            met = rows.withColumn("slice", F.pmod(F.xxhash64("digest"), F.col("slices"))).join(heads, ["key", "slice"]).where("label <> other_label and (not head or other_digest < digest) and (side = 0 or side <> other_side)")
            met = met.where(F.least(F.col("size") - F.col("place"), F.col("other_size") - F.col("other_place")) >= _SHARE * (F.col("size") + F.col("other_size")) - 1e-6)
            unlike = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"other_{c}"))) for c in ODD), F.lit(0))  # at most the shingles that one text alone has
            met = met.where(unlike <= (1 - 2 * _SHARE) * (F.col("size") + F.col("other_size")) + 1e-6)
            pairs = met.select(F.least("digest", "other_digest").alias("a"), F.greatest("digest", "other_digest").alias("b")).distinct()
            self.meet(pairs if self.seen is None else pairs.join(self.seen, ["a", "b"], "left_anti"))
            members, wanted, rounds = stow(self.labelled(rows.where("not head").select("key", "digest", "size", "place", "side", "weight", *ODD))), wanted * MORE_HEADS, rounds and rounds - 1

    def meet(self, pairs: DataFrame) -> None:
        pairs = stow(pairs)
        self.seen = pairs if self.seen is None else self.seen.unionByName(pairs)
        good = stow(verified(pairs, self.texts))
        if good.isEmpty():
            return
        if self.labels is None:
            self.labels = components(good)
            return
        known = self.labels
        for side in ("a", "b"):  # links join classes
            good = good.join(known.select(F.col("node").alias(side), F.col("label").alias("of")), side, "left").withColumn(side, F.coalesce("of", side)).drop("of")
        joined = components(stow(good.where("a <> b"))).select(F.col("node").alias("label"), F.col("label").alias("fresh"))
        moved = known.join(joined, "label", "left").select("node", F.coalesce("fresh", "label").alias("label"))
        self.labels = stow(moved.unionByName(joined.select(F.col("label").alias("node"), F.col("fresh").alias("label")).join(known, "node", "left_anti")))


def classes(docs: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """node, label: digest of each text that has a similar one, and a mark of its class; None if there are none.

    In each round some members of a key are heads, which meet all its members of other classes and leave. The first head is
    the text in the fullest keys; after it those outside a key's largest class are heads first, so a few strangers don't
    hold up a large class. Keys that aren't of one class after their first head, such as those of a template in unlike
    texts, have their texts met by the keys of rare shingles instead, which part unlike texts without pairing them.
    """
    spread = nodes.select("digest", "size", F.explode("keys").alias("key"))
    shared = stow(spread.groupBy("key").count().where("count > 1"))
    members = stow(spread.join(shared, "key"))
    if members.isEmpty():
        return None
    meetings = _Meetings(docs, nodes, members)
    rest = meetings.run(members.select("key", "digest", "size", F.lit(0).alias("place"), F.lit(0).alias("side")), rounds=1)
    rest = stow(rest.select("digest").distinct())
    if not rest.isEmpty():
        meetings.run(rare_shingle_keys(meetings.texts.join(checked(rest), "digest", "left_semi")), MORE_HEADS)
    return meetings.labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, digest, class_id, kept (true for one document of each class)."""
    rows = stow(sketches(docs))
    nodes = rows.groupBy("digest").agg(*(F.first(c).alias(c) for c in ("keys", "size", *ODD)), F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    nodes = stow(nodes)
    labels = classes(docs, nodes)
    if labels is None:
        classed = nodes.select("digest", F.col("doc_id").alias("class_id"))
    else:
        labelled_nodes = nodes.select("digest", "doc_id").join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
        least = labelled_nodes.groupBy("label").agg(F.min("doc_id").alias("class_id"))
        classed = labelled_nodes.join(least, "label").select("digest", "class_id")
    moved = stow(classed.join(nodes.select("digest", "doc_id", "n"), "digest").where("n > 1 or class_id is distinct from doc_id").select("digest", "class_id"))
    one = F.col("doc_id").eqNullSafe(F.coalesce("class_id", "doc_id"))
    return rows.select("doc_id", "digest").join(checked(moved), "digest", "left").select("doc_id", "digest", F.coalesce("class_id", "doc_id").alias("class_id"), one.alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each class."""
    found = stow(near_duplicates(docs))
    gone = found.where("not kept").select("doc_id", "digest").distinct()
    repeated = found.where("kept").groupBy("doc_id", "digest").count().where("count > 1")
    taken = {c.lower() for c in docs.columns}
    own, theirs, number = (next(n for k in range(len(taken) + 1) if (n := f"{name}{k}") not in taken) for name in ("digest_", "gone_digest_", "gone_"))
    held = docs.withColumn(own, F.unhex(F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"))))
    gone = checked(gone.select(F.col("doc_id").alias(number), F.col("digest").alias(theirs)))
    rest = held.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col(number)) & (F.col(own) == F.col(theirs)), "left_anti")
    if not repeated.isEmpty():
        rest = rest.dropDuplicates(["doc_id", own])
    return rest.drop(own)
