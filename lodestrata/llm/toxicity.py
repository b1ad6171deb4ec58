"""Toxicity: a weighted lexicon found by an Aho-Corasick automaton on folded text.

Folding makes disguised spellings equal: lower case, no invisible characters, look-alike letters of other scripts and
digit or sign substitutions replaced by the letter they stand for. The lexicon holds whole words and word beginnings,
each weighted by its log odds between toxic and other labelled documents of a bounded sample; two-word phrases that
contain a lexicon word but stand in harmless documents become exceptions, which cancel the hits inside them. A
document's score is a logistic function of its weight sum, its weight per hundred words and its number of kinds, fitted
on the same sample. All candidates of the sample are compared: the sample alone bounds what comes to the driver, patterns in
MIN_DOCUMENTS toxic documents of it.

Null and empty texts have no hits and get the score of such documents. With no labelled rows of both kinds the lexicon
is empty and every score is the share of toxic labels (0 without labels). Repeated rows are scored one by one; labels
that repeat a doc_id are taken once. Columns besides doc_id and text (labels: doc_id and toxic) are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, remainder_of_id
from .quality import labelled_sample

#: Labelled documents that the lexicon and the score are fitted on, at most about so many.
SAMPLE_ROWS = 12_000
MIN_DOCUMENTS, MIN_WEIGHT, STEMS = 5, 2.5, range(4, 9)
MODULUS, HELD_OUT = 4, 2
CUT = 0.3

#: Characters that look like a letter, and what they stand for.
LOOK_ALIKES = {
    "a": "аαａ@4", "b": "вβｂ", "c": "сϲｃ", "d": "ԁｄ", "e": "еεｅ3", "f": "ｆ", "g": "ɡｇ9", "h": "һｈ", "i": "іιｉ1!", "j": "јｊ", "k": "кκｋ", "l": "ӏｌ|",
    "m": "мｍ", "n": "ｎη", "o": "оοσｏ0", "p": "рρｐ", "q": "ԛｑ", "r": "ｒ", "s": "ѕｓ$5", "t": "тτｔ7", "u": "υｕ", "v": "νｖ", "w": "ԝωｗ", "x": "хχｘ", "y": "уγｙ", "z": "ｚ",
}
INVISIBLE = "­​‌‍⁠﻿"
_FOLD = {ord(c): letter for letter, cs in LOOK_ALIKES.items() for c in cs}
_GONE = dict.fromkeys(map(ord, INVISIBLE))
_SIGNS = re.compile("[0-9@!$|]")
_WORD = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"\S+")


def visible(text: str) -> str:
    """Lower case without invisible characters; as long as folded() of it."""
    return text.translate(_GONE).lower()


def folded(text: str) -> str:
    """Of visible text, character by character."""
    return text.translate(_FOLD) if not text.isascii() or _SIGNS.search(text) else text


def patterns_of(text: str) -> set[str]:
    """Whole words (marked by a space at the end) and word beginnings."""
    seen = visible(text)
    words = set(_WORD.findall(seen))
    other = folded(seen)
    if other is not seen:
        words.update(_WORD.findall(other))
    return {w + " " for w in words if len(w) > 2} | {w[:n] for w in words for n in STEMS if len(w) > n}


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    coefficients: np.ndarray = field(default_factory=lambda: np.array([-20.0, 0, 0, 0]))
    _automaton: ahocorasick.Automaton | None = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "coefficients": self.coefficients, "_automaton": None}

    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            entries: dict[str, list[tuple[bool, float, str | None]]] = {}  # a whole word and a beginning may have the same letters
            for p, w in sorted(self.weights.items()):
                entries.setdefault(p.rstrip(" "), []).append((p[-1] == " ", w, p))
            for p in sorted(self.exceptions):
                entries.setdefault(p, []).append((True, 0.0, None))
            self._automaton = ahocorasick.Automaton()
            for letters, found in entries.items():
                self._automaton.add_word(letters, (len(letters), found))
            self._automaton.make_automaton()
        return self._automaton

    def hits(self, text: str) -> list[tuple[int, int, float, str]]:
        """(start, end, weight, pattern) of lexicon entries outside of exception phrases, the heaviest at each start."""
        if not self.weights:
            return []
        seen = visible(text)
        shown = folded(seen)
        best: dict[int, tuple[int, int, float, str]] = {}
        freed: list[tuple[int, int]] = []
        for last, (n, entries) in self.automaton().iter(shown):
            start, end = last - n + 1, last + 1
            if start and (seen[start - 1].isalpha() or shown[start - 1].isalpha() and not _SIGNS.match(seen[start - 1])):
                continue
            goes_on = end < len(seen) and seen[end].isalpha()
            for whole, weight, pattern in entries:
                if whole and goes_on:
                    continue
                if pattern is None:
                    freed.append((start, end))
                elif start not in best or weight > best[start][2]:
                    best[start] = (start, end, weight, pattern)
        return [h for h in best.values() if not any(a <= h[0] and h[1] <= b for a, b in freed)]

    def features(self, text: str) -> tuple[float, float, float]:
        found = self.hits(text)
        if not found:
            return 0.0, 0.0, 0.0
        total = sum(h[2] for h in found)
        words = len(_SPACED.findall(text))
        return float(np.log1p(total)), float(np.log1p(100 * total / max(words, 10))), float(np.log1p(len({h[3] for h in found})))

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.coefficients[0] + features @ self.coefficients[1:], -30, 30)))


def choose(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weights of the patterns that are kept, from their numbers of toxic and other documents."""
    weights = {p: float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))) for p, (t, c) in counts.items()}
    kept = {p for p, w in weights.items() if w >= MIN_WEIGHT and counts[p][0] >= MIN_DOCUMENTS}
    carried: dict[str, int] = {}  # the most documents of one longer pattern
    for p in kept:
        body = p.rstrip(" ")
        for n in STEMS:
            if n < len(body):
                carried[body[:n]] = max(carried.get(body[:n], 0), counts[p][0])
    stems = {p for p in kept if p[-1] != " " and carried.get(p, 0) < 0.9 * counts[p][0]}
    out = {p for p in kept if p[-1] == " "} | stems
    return {p: weights[p] for p in sorted(out) if not any(p[:n] in stems and weights[p[:n]] >= weights[p] - 1 for n in STEMS if n < len(p.rstrip(" ")))}


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Intercept and coefficients by Newton's method."""
    x = np.column_stack([np.ones(len(labels)), features])
    beta, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (labels - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _counted(texts: DataFrame, wanted: set[str] | None) -> DataFrame:
    """pattern, n: sums over each task, then over tasks."""
    held = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for frame in frames:
            for text in frame["text"].fillna(""):
                found.update(patterns_of(text) if held.value is None else patterns_of(text) & held.value)
        yield pd.DataFrame({"pattern": list(found.keys()), "n": list(found.values())}).astype({"pattern": object, "n": "int64"})

    return texts.select("text").mapInPandas(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def _phrases(texts: DataFrame, lexicon: Lexicon) -> dict[tuple[str, bool], int]:
    """Documents by two-word phrase around a hit and by label."""
    held = texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for frame in frames:
            for text, label in zip(frame["text"].fillna(""), frame["label"], strict=True):
                shown = folded(visible(text))
                around: set[str] = set()
                for start, end, _, _ in held.value.hits(text):
                    if m := re.search(r"[^\W\d_]+ $", shown[max(0, start - 24) : start]):
                        around.add(shown[start - len(m[0]) : end])
                    if m := re.match(r" [^\W\d_]+", shown[end : end + 24]):
                        around.add(shown[start : end + len(m[0])])
                found.update((p, bool(label)) for p in around)
        yield pd.DataFrame([(p, t, n) for (p, t), n in found.items()], columns=["phrase", "toxic", "n"]).astype({"phrase": object, "toxic": bool, "n": "int64"})

    rows = texts.mapInPandas(run, "phrase string, toxic boolean, n long").groupBy("phrase").agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(~F.col("toxic"), F.col("n")).otherwise(0)).alias("clean"))
    return {r.phrase for r in rows.where("clean >= 3 and clean > 4 * toxic").collect()}


def _features(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, label, a, b, c and whatever else is in texts, but for the text."""
    held = texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = np.array([held.value.features(t) for t in frame["text"].fillna("")]).reshape(-1, 3)
            yield frame.drop(columns="text").assign(a=values[:, 0], b=values[:, 1], c=values[:, 2])

    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name != "text"]
    return texts.mapInPandas(run, ", ".join([*rest, "a double", "b double", "c double"]))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = MODULUS, held_out: int = HELD_OUT) -> Lexicon:
    """Learns from labelled rows that aren't held out, a bounded sample of them."""
    learn = labels.where(remainder_of_id(labels["doc_id"].cast("long"), modulus) != held_out)
    sample = labelled_sample(learn, "toxic", SAMPLE_ROWS)
    texts = keyed_text(docs).join(F.broadcast(sample), "doc_id").select("text", "label")
    sizes = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    lexicon = Lexicon()
    if not toxic or not clean:
        return lexicon if not toxic else Lexicon(coefficients=np.array([20.0, 0, 0, 0]))
    in_toxic = {r.pattern: r.n for r in _counted(texts.where("label = 1"), None).where(F.col("n") >= MIN_DOCUMENTS).collect()}
    in_clean = {r.pattern: r.n for r in _counted(texts.where("label = 0"), set(in_toxic)).collect()}
    lexicon.weights = choose({p: (n, in_clean.get(p, 0)) for p, n in in_toxic.items()}, toxic, clean)
    lexicon.exceptions = _phrases(texts, lexicon)
    rows = _features(texts, lexicon).select("a", "b", "c", "label").toPandas()
    lexicon.coefficients = logistic(rows[["a", "b", "c"]].to_numpy(), rows["label"].to_numpy().astype(float))
    return lexicon


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = MODULUS, held_out: int = HELD_OUT) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    lexicon = fit(docs, labels, modulus, held_out)
    beta = [float(x) for x in lexicon.coefficients]
    found = _features(keyed_text(docs), lexicon)
    z = F.lit(beta[0]) + F.lit(beta[1]) * F.col("a") + F.lit(beta[2]) * F.col("b") + F.lit(beta[3]) * F.col("c")
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return found.select("doc_id", (remainder_of_id(F.col("doc_id"), modulus) == held_out).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
