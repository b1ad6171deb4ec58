"""Quality rules: an isolation forest over rule statistics.

Every document gets exact rule statistics in one pass without a shuffle. A forest of random splits is grown on the
statistics of the labelled documents: each tree, as the method has it, on SUBSAMPLE rows drawn from all of them. The mean
path length at which a document is isolated is its anomaly score, and the scores and labels of all labelled documents fix
the score above which a document is rejected.

Null text has no words, as has empty text: both fail the base rule. Without labelled rows of both kinds there is no
threshold, and the base rule alone decides. Labels that repeat a doc_id are taken once; null labels are left out.
Columns besides doc_id and text (labels: doc_id and quality) are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import BROADCAST_ROWS
from . import words as W
from .common import column_of, empty_where_null, filtered, keyed_text, stow, text_chunks

#: Rows of labelled documents that `labelled_sample` gives at most, about.
SAMPLE_ROWS = 12_000
TREES, SUBSAMPLE, SEED = 120, 256, 11
#: Share of the labelled good documents that the threshold must keep.
KEEP_GOOD = 0.98

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"[#*$%&|<>]"[1:-1])] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?.,;:")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["word_length", "symbols", "marks", "exclaims", "upper", "digits", "dup_lines", "repeats", "variety", "top_word", "lines"]
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", " + ", ".join(f"{c} double" for c in FEATURES)


def _repeats(keys: np.ndarray) -> np.ndarray:
    """For each key, whether it occurs more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _per_document(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    return keys ^ W.mix(of.astype(np.uint64) + np.uint64(1))


def _first_of_kind(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = True
    return out


def statistics(texts: W.Texts) -> dict[str, np.ndarray]:
    """BASE counts and FEATURES rates of each document."""
    data, at = texts.data, texts.at
    prefix = texts.prefix_hashes()
    starts, ends, word_at = texts.words()
    n_words, inside = np.diff(word_at), ~W.SPACES[data]
    head = (data & 0xC0) != 0x80
    hashes = W.span_hashes(prefix, starts, ends)
    base = {"n_words": n_words, "word_chars": W.sums(inside & head, at), "n_symbols": W.sums(SYMBOLS[data], at)}

    line_starts, line_ends, line_at = texts.tokens(data != 0x0A)
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    lines = _per_document(W.span_hashes(prefix, line_starts, line_ends), W.owner(line_at))
    again = np.zeros(len(lines), bool)
    again[with_word] = ~_first_of_kind(lines[with_word])
    base["n_dup_lines"] = W.sums(again, line_at)

    threes, three_at = W.grams(hashes, word_at, 3)
    of = W.owner(three_at)
    twice = _repeats(_per_document(threes, of))
    covered = np.zeros(len(starts), bool)
    first = np.arange(len(threes)) + (word_at[:-1] - three_at[:-1])[of]
    for j in range(3):
        covered[first[twice] + j] = True
    base["n_repeat_words"] = W.sums(covered, word_at)

    keyed = _per_document(hashes, W.owner(word_at))
    order = np.argsort(keyed, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], keyed[order[1:]] != keyed[order[:-1]]])) if len(keyed) else np.zeros(0, int)
    counts, holder = np.diff(np.append(edges, len(keyed))), W.owner(word_at)[order[edges]]
    kinds, most = np.bincount(holder, minlength=len(n_words)), np.zeros(len(n_words), np.int64)
    np.maximum.at(most, holder, counts)

    w, c = np.maximum(n_words, 1), np.maximum(base["word_chars"], 1)
    rates = {
        "word_length": base["word_chars"] / w,
        "symbols": base["n_symbols"] / w,
        "marks": W.sums(_MARKS[data], at) / w,
        "exclaims": W.sums(data == 0x21, at) / w,
        "upper": W.sums(_UPPER[data], at) / c,
        "digits": W.sums(_DIGIT[data], at) / c,
        "dup_lines": base["n_dup_lines"] / np.maximum(W.sums(with_word, line_at), 1),
        "repeats": base["n_repeat_words"] / w,
        "variety": kinds / np.power(w, 0.8),
        "top_word": most / w,
        "lines": W.sums(with_word, line_at) / w,
    }
    return base | rates


def document_statistics(docs: DataFrame) -> DataFrame:
    """One row per document, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                found = statistics(W.Texts.of(empty_where_null(column_of(part, "text"))))
                yield pa.RecordBatch.from_arrays([column_of(part, "doc_id"), *(pa.array(found[c].astype(np.int64)) for c in BASE), *(pa.array(found[c].astype(np.float64)) for c in FEATURES)], ["doc_id", *BASE, *FEATURES])

    return keyed_text(docs).mapInArrow(run, STATS)


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class IsolationForest:
    """Random splits; rows with short paths are anomalies. Trees are arrays: feature (-1: leaf), cut, left, right, length."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self._plant((rows[rng.choice(len(rows), min(subsample, len(rows)), replace=False)] for _ in range(trees)), min(subsample, len(rows)), rng)

    def _plant(self, drawn: Iterable[np.ndarray], subsample: int, rng: np.random.Generator) -> None:
        self.usual = _expected(subsample)
        self.trees = [self._grow(rows, rng) for rows in drawn]

    @classmethod
    def of(cls, drawn: list[np.ndarray], seed: int = SEED) -> IsolationForest:
        """A tree for each of the given sets of rows."""
        made = cls.__new__(cls)
        made._plant(drawn, max(map(len, drawn)), np.random.default_rng(seed))
        return made

    @staticmethod
    def _grow(rows: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
        nodes: list[list[float]] = []
        deepest = int(np.ceil(np.log2(max(len(rows), 2))))

        def node(part: np.ndarray, depth: int) -> int:
            here = len(nodes)
            nodes.append([-1, 0.0, -1, -1, depth + _expected(len(part))])
            low, high = part.min(0), part.max(0)
            free = np.flatnonzero(high > low)
            if depth < deepest and len(part) > 1 and len(free):
                f = int(rng.choice(free))
                cut = rng.uniform(low[f], high[f])
                left = part[:, f] <= cut
                nodes[here][:2] = [f, cut]
                nodes[here][2] = node(part[left], depth + 1)
                nodes[here][3] = node(part[~left], depth + 1)
            return here

        node(rows, 0)
        table = np.array(nodes)
        return [table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4]]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path): towards 1 for anomalies."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, left, right, length in self.trees:
            at = np.zeros(len(rows), np.int64)
            open_ = every[feature[at] >= 0]
            while len(open_):
                here = at[open_]
                at[open_] = np.where(rows[open_, feature[here]] <= cut[here], left[here], right[here])
                open_ = open_[feature[at[open_]] >= 0]
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(self.usual, 1e-9))


def threshold(scores: np.ndarray, good: np.ndarray, keep_good: float = KEEP_GOOD) -> float:
    """The score that parts the labels best while it keeps `keep_good` of the good rows; scores above it are rejected."""
    if good.all() or not good.any():
        return np.inf
    cuts = np.unique(scores)
    kept_good = np.searchsorted(np.sort(scores[good]), cuts, side="right") / good.sum()
    kept_bad = np.searchsorted(np.sort(scores[~good]), cuts, side="right") / (~good).sum()
    value = np.where(kept_good >= keep_good, kept_good - kept_bad, -np.inf)
    best = int(value.argmax())
    return float((cuts[best] + cuts[best + 1]) / 2 if best + 1 < len(cuts) else np.inf)


def labelled_sample(labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id and label of about `rows` labelled documents at most, picked by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    total = known.count()
    if total > rows:
        known = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * rows / total))
    return known.groupBy("doc_id").agg(F.min("label").alias("label"))


def drawn_for_trees(rows: DataFrame, total: int, trees: int = TREES, subsample: int = SUBSAMPLE) -> list[np.ndarray]:
    """For each tree FEATURES of `subsample` rows at most, those of least hashes of tree and row: any row is as likely as any other.

    Rows far from the least hashes never leave their task, so what is sorted and comes to the driver depends on trees and subsample alone.
    """
    hashed = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("_hash", F.pmod(F.xxhash64("tree", "doc_id", *FEATURES), F.lit(1 << 40)))
    near = hashed.where(F.col("_hash") < int(min(1.0, (2 * subsample + 64) / total) * (1 << 40)))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("_hash", "doc_id", *FEATURES))
    found = near.withColumn("_place", place).where(F.col("_place") <= subsample).select("tree", "_place", *FEATURES).toPandas().sort_values(["tree", "_place"])
    return [part[FEATURES].to_numpy() for _, part in found.groupby("tree")]


def score_threshold(scored: DataFrame, keep_good: float = KEEP_GOOD) -> float:
    """threshold() of scored(score, good) of any size: scores are counted, and summed up over ranges of their order."""
    counts = scored.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    held = stow(counts.repartitionByRange("score").withColumn("_range", F.spark_partition_id()))
    good, bad = held.agg(F.sum("good"), F.sum("bad")).first()
    if not good or not bad:
        return np.inf
    parts = held.groupBy("_range").agg(F.sum("good").alias("_good"), F.sum("bad").alias("_bad"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = parts.select("_range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_good", "_bad")))
    within = Window.partitionBy("_range").orderBy("score")
    summed = held.join(F.broadcast(starts), "_range").select("score", *((F.col(f"_{c}") + F.sum(c).over(within)).alias(c) for c in ("good", "bad")))
    kept = summed.select("score", (F.col("good") / good).alias("good"), (F.col("bad") / bad).alias("bad")).where(F.col("good") >= keep_good)
    cut = kept.orderBy((F.col("good") - F.col("bad")).desc(), "score").first().score
    above = held.where(F.col("score") > cut).agg(F.min("score")).first()[0]
    return np.inf if above is None else (cut + above) / 2


def labelled_statistics(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, FEATURES, label of all labelled documents of 50 words or more, stowed. Texts are never shuffled."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = stow(known.groupBy("doc_id").agg(F.min("label").alias("label")))
    if known.count() <= BROADCAST_ROWS:
        rows = document_statistics(keyed_text(docs).join(F.broadcast(known.select("doc_id")), "doc_id")).join(F.broadcast(known), "doc_id")
    else:
        rows = document_statistics(docs).join(known, "doc_id")
    return stow(rows.where("n_words >= 50").select("doc_id", *FEATURES, "label"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[IsolationForest, float] | None:
    """The forest and its threshold, from all labelled documents; None if there is none. TREES * SUBSAMPLE rows at most come to the driver."""
    rows = labelled_statistics(docs, labels)
    total = rows.count()
    if not total:
        return None
    forest = IsolationForest.of(drawn_for_trees(rows, total))
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"score": held.value.scores(frame[FEATURES].to_numpy()), "good": frame["label"].to_numpy() == 1})

    return forest, score_threshold(rows.mapInPandas(run, "score double, good boolean"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, BASE, base_failed, anomaly, kept."""
    fitted = fit(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = held.value[0].scores(frame[FEATURES].to_numpy()) if held.value else np.zeros(len(frame))
            yield frame[["doc_id", *BASE]].assign(anomaly=scores, rejected=scores > (held.value[1] if held.value else np.inf)).astype({"doc_id": "Int64"})

    scored = document_statistics(docs).mapInPandas(run, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", anomaly double, rejected boolean")
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.col("rejected")).select("doc_id", *BASE, "base_failed", "anomaly", "kept")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the rules reject, in one pass."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def verdicts(part: pa.RecordBatch) -> np.ndarray:
        found = statistics(W.Texts.of(empty_where_null(column_of(part, "text"))))
        good = (found["n_words"] >= 50) & (100 * found["n_repeat_words"] <= 50 * found["n_words"])
        if held.value:
            good &= held.value[0].scores(np.column_stack([found[c] for c in FEATURES])) <= held.value[1]
        return good

    return filtered(docs, verdicts)
