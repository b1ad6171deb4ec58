"""Language-model scores by a subword lattice.

The pieces are those of an existing vocabulary; their weights are counted in the training documents: every distinct
training word is cut by the existing tokenizer, and a piece's probability is its smoothed share of all pieces and end
marks. A word's probability is the sum over all its segmentations into pieces (bytes where a character has no piece), by
a forward recursion in log space, and a document's the product over its words and its end.

Counts and word probabilities sit in one table of all distinct words, which grows with the corpus. Documents look up the
words of a bounded frequent part by broadcast; only their other words go through a join with the whole table.

Null text counts as empty: just the end token. Without training documents all counts are 0 and pieces are equally
likely. Repeated rows are scored one by one; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, keyed_text, remainder_of_id, stow, text_chunks

MODULUS, HELD_OUT = 7, 2
#: Most words in the broadcast table, and in a task's counter before it hands its counts on.
FREQUENT, FLUSH = 300_000, 500_000
#: Buckets of counts for each doubling; there are fewer than 64 times as many.
STEPS = 16
_MARK = "▁"

_worker: dict = {}


def _pieces(path: str) -> sentencepiece.SentencePieceProcessor:
    if _worker.get("path") != path:
        _worker.update(path=path, pieces=sentencepiece.SentencePieceProcessor(model_file=path))
    return _worker["pieces"]


class Lattice:
    """Log10 probability of a word over all its segmentations."""

    def __init__(self, path: str, counts: dict[int, int], ends: int):
        model = _pieces(path)
        total = sum(counts.values()) + ends + model.get_piece_size() + 1
        self.logs, self.bytes = {}, [0.0] * 256
        for i in range(model.get_piece_size()):
            log = math.log((counts.get(i, 0) + 1) / total)
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[3:5], 16)] = log
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.logs[model.id_to_piece(i)] = log
        self.longest = max(map(len, self.logs), default=1)
        self.end = math.log((ends + 1) / total) / math.log(10)

    def log10(self, word: str) -> float:
        text, logs, longest, exp, log1p = _MARK + word, self.logs, self.longest, math.exp, math.log1p
        alpha: list[float] = [0.0]
        for i in range(1, len(text) + 1):
            best = -math.inf
            for j in range(max(0, i - longest), i):
                log = logs.get(text[j:i])
                if log is not None:
                    x = alpha[j] + log
                    best = x + log1p(exp(best - x)) if x > best else best + log1p(exp(x - best))
            if text[i - 1] not in logs:
                x = alpha[i - 1] + sum(self.bytes[b] for b in text[i - 1].encode("utf-8", "surrogatepass"))
                best = x + log1p(exp(best - x)) if x > best else best + log1p(exp(x - best))
            alpha.append(best)
        return alpha[-1] / math.log(10)


def _words(text: str | None) -> list[bytes]:
    """A-Z in lower case, cut at 0x20 and 0x09 to 0x0D; bytes methods do exactly that."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c: every distinct word of all documents with its count in those where `learn` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "c"])

        found: Counter = Counter()
        for batch in batches:
            for text, learn in zip(column_of(batch, "text").to_pylist(), column_of(batch, "learn").to_pylist(), strict=True):
                if learn:
                    found.update(_words(text))
                else:
                    for w in _words(text):
                        found.setdefault(w, 0)
                if len(found) > FLUSH:
                    yield rows(found)
                    found = Counter()
        yield rows(found)

    return docs.select("text", "learn").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def piece_counts(words: DataFrame, path: str) -> dict[int, int]:
    """Occurrences of each piece in the training words; as many rows as the vocabulary has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(path)
        found = np.zeros(model.get_piece_size(), np.int64)
        for batch in batches:
            counts = column_of(batch, "c").to_numpy()
            cut = model.encode([w.decode("utf-8", "replace") for w in column_of(batch, "word").to_pylist()], num_threads=1)
            ids = np.fromiter((i for x in cut for i in x), np.int64)
            np.add.at(found, ids, np.repeat(counts, [len(x) for x in cut]))
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(found[held])], ["piece", "n"])

    return {r.piece: r.n for r in words.where("c > 0").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()}


def word_scores(words: DataFrame, lattice: Lattice) -> DataFrame:
    """word, c, log."""
    held = words.sparkSession.sparkContext.broadcast(lattice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = [held.value.log10(w.decode("utf-8", "replace")) for w in column_of(batch, "word").to_pylist()]
            yield pa.RecordBatch.from_arrays([column_of(batch, "word"), column_of(batch, "c"), pa.array(logs, pa.float64())], ["word", "c", "log"])

    return words.mapInArrow(run, "word binary, c long, log double")


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The words from a count up; the count is the least that leaves at most `most` words."""
    step = F.floor(F.log2(F.col("c") + 1) * STEPS).cast("int")
    sizes = sorted(((r.step, r.n) for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    held, least = 0, None
    for s, n in sizes:
        if held + n > most:
            break
        held, least = held + n, s
    return words.where(step >= least) if least is not None else words.limit(0)


def document_scores(docs: DataFrame, path: str, modulus: int = MODULUS, held_out: int = HELD_OUT, most: int = FREQUENT) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    sc = docs.sparkSession.sparkContext
    marked = keyed_text(docs).withColumn("learn", F.coalesce(remainder_of_id(F.col("doc_id"), modulus) != held_out, F.lit(True)))
    counted = stow(word_counts(marked))
    ends = marked.where("learn").count()
    sums = counted.where("c > 0").agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n, v = sums.n + ends, sums.v + (ends > 0)
    lattice = Lattice(path, piece_counts(counted, path), ends)
    scored = stow(word_scores(counted, lattice))
    top = frequent(scored, most).toPandas()
    held = sc.broadcast({w: (c, g) for w, c, g in zip(map(bytes, top["word"]), top["c"].tolist(), top["log"].tolist(), strict=True)})
    floor, end_log = math.log10(n + v + 1), lattice.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with what the frequent words give, keyed by something that is no word; and a row for each other word."""
        table = held.value
        for batch in batches:
            for part in text_chunks(batch):
                out: list[list] = [[] for _ in range(9)]
                for row, doc, text, learn in zip(*(column_of(part, x).to_pylist() for x in ("row", "doc_id", "text", "learn")), strict=True):
                    tokens, known, base, score = 1, int(ends > 0), math.log10(ends + 1) - floor, end_log
                    for word, times in Counter(_words(text)).items():
                        tokens += times
                        found = table.get(word)
                        if found is None:
                            for x, y in zip(out, (row, None, None, word, times, 0, 0, 0.0, 0.0), strict=True):
                                x.append(y)
                        else:
                            known += times * (found[0] > 0)
                            base += times * (math.log10(found[0] + 1) - floor)
                            score += times * found[1]
                    for x, y in zip(out, (row, doc, not learn, b" %d" % row, 0, tokens, known, base, score), strict=True):
                        x.append(y)
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["row", "doc_id", "held_out", "word", "times", "n_tokens", "n_known", "base", "score"])

    rows = marked.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "row long, doc_id long, held_out boolean, word binary, times long, n_tokens long, n_known long, base double, score double")
    joined = rows.join(scored.withColumnRenamed("log", "found"), "word", "left")
    rare, times = F.col("times") > 0, F.col("times")
    per = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.when(rare, F.when(F.col("c") > 0, times).otherwise(0)).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum(F.when(rare, times * (F.log10(F.col("c") + 1) - floor)).otherwise(F.col("base"))).alias("base_score"),
        F.sum(F.when(rare, times * F.col("found")).otherwise(F.col("score"))).alias("score"),
    )
    return per.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
