"""Operators that look at one document at a time."""

import math
import os
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestrata.llm import lattice, packing, quality, tokens, toxicity

from . import corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [l for l in text.split("\n") if WORD.search(l)]
    threes = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics_against_plain_python(spark):
    rows = [*corpus.documents(), (90, "a b\na b\nc\n\n \na b c a b c ### <b> $1 100% | *"), (91, "x\ny\nx\ny " * 20)]
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(45, 0), (46, 0), (None, 0), (2, None), (3, 1)], "doc_id long, quality int")
    found = quality.quality_verdicts(corpus.table(spark, rows), labels).collect()
    assert sorted((str(r.doc_id), *r[1:6]) for r in found) == sorted((str(i), *base_rules(t)) for i, t in rows)
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    kept = quality.good_documents(corpus.table(spark, rows), labels)
    assert kept.schema == corpus.table(spark, rows).schema and kept.count() == sum(r.kept for r in found)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_verdicts(corpus.empty(spark), none).count() == 0
    assert all(r.kept != r.base_failed for r in quality.quality_verdicts(corpus.table(spark, rows), none).collect())


def test_forest_isolates_what_lies_apart():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(0, 1, (500, 3)), rng.normal(9, 0.5, (20, 3))])
    scores = quality.IsolationForest(rows).scores(rows)
    assert scores[500:].min() > np.quantile(scores[:500], 0.97)
    good = np.arange(520) < 500
    cut = quality.threshold(scores, good)
    assert (scores[~good] > cut).all() and (scores[good] <= cut).mean() >= 0.98


def test_the_forest_and_its_threshold_come_from_all_labelled_documents(spark):
    """12,500 of them, more than were sampled once; broadcast labels and joined ones; and the cut of the counts is that of the arrays."""
    ids = spark.range(12_500)
    docs = ids.selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 55), x -> cast((x * id) % 97 as string))) as text")
    labels = ids.selectExpr("id as doc_id", "cast(id % 3 > 0 as int) as quality")
    rows = quality.labelled_statistics(docs, labels)
    assert rows.select("doc_id").distinct().count() == rows.count() == 12_500
    drawn = quality.drawn_for_trees(rows, 12_500)
    assert [len(d) for d in drawn] == [quality.SUBSAMPLE] * quality.TREES
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality, "BROADCAST_ROWS", 10)
        assert quality.labelled_statistics(docs, labels).exceptAll(rows).isEmpty()
    rng = np.random.default_rng(1)
    for n in (2, 300, 4000):
        good = rng.random(n) < 0.8
        good[:2] = True, False
        scores = np.round(rng.normal(np.where(good, 0.4, 0.55), 0.05), 3)
        held = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(scores, good, strict=True)], "score double, good boolean")
        assert quality.score_threshold(held) == quality.threshold(scores, good)
    assert quality.score_threshold(held.where("good")) == np.inf


def test_token_counts_against_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows, t = corpus.documents(), Tokenizer.from_file(path)
    found = tokens.token_counts(corpus.table(spark, rows), path).collect()
    want = sorted((str(i), len((s or "").encode()), n := len(t.encode(s or "", add_special_tokens=False).ids), n > 2048) for i, s in rows)
    assert sorted((str(r.doc_id), *r[1:]) for r in found) == want
    assert tokens.token_counts(corpus.empty(spark), path).count() == 0


def test_a_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 3)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    held = tokens.Lengths({"a": 1}, t)
    words = [f"qz{c}x" for c in "abcdefghij"] * 2
    assert [held[w] for w in words] == [len(t.encode(w, add_special_tokens=False).ids) for w in words] and len(held) <= 6


def packed(spark, docs):
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_packing_round_trip(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus.documents()
    found = packed(spark, corpus.table(spark, rows)).collect()
    want = []
    for i, s in rows:
        ids = np.array([*t.encode(s or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        want += [(str(i), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r.doc_id), *r[1:5]) for r in found) == sorted(want)
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        ends = np.cumsum([0, *(n for _, n in sorted(pieces))])
        assert [o for o, _ in sorted(pieces)] == ends[:-1].tolist() and ends[-1] <= 1024
    assert len(bins) <= math.ceil(sum(r.length for r in found) / 1024) + 1
    assert packed(spark, corpus.empty(spark)).count() == 0


def test_fullest_against_all_combinations():
    rng = np.random.default_rng(0)
    for _ in range(200):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 30, 5), rng.integers(1, 4, 5))}
        got = packing.fullest(counts, 30)
        assert all(t <= counts[n] for n, t in got) and got[0][0] == max(counts)
        reach = {max(counts)}
        for n, c in counts.items():
            reach = {s + k * n for s in reach for k in range(c + 1 - (n == max(counts))) if s + k * n <= 30}
        assert sum(n * t for n, t in got) == max(reach)


def test_a_plan_covers_every_rank():
    histogram = {1024: 5, 700: 3, 324: 2, 300: 9, 24: 50, 1: 3000}
    plan = packing.bin_plan(histogram)
    assert {n: sum(p[2] for p in plan if p[0] == n) for n in histogram} == histogram and len(plan) < 100


def test_toxic_words_are_learnt_and_found_in_disguise(spark):
    rows, labels = [], []
    for k, (_, text) in enumerate(corpus.documents(1, 200)[:200]):
        toxic = k % 5 == 0
        rows.append((k, f"{text} you grumfus and {text[:30]} vilekin!" if toxic else text))
        labels.append((k, int(toxic)))
    rows += [(900, "this is a gr\u200bumf\u03c5s"), (901, "GRUMFUS"), (902, None), (903, ""), (904, "grumfusion is a place"), (905, "v1lek1n"), (906, "a plain text about nothing at all")]
    found = {r.doc_id: r for r in toxicity.toxicity_scores(corpus.table(spark, rows), spark.createDataFrame(labels + [(None, 1), (5, None), (7, 0)], "doc_id long, toxic int")).collect()}
    right = sum((found[k].predicted == 1) == bool(t) for k, t in labels)
    assert right >= 196 and {found[k].predicted for k in (901, 905)} == {1} and {found[k].predicted for k in (902, 903, 906)} == {0}
    assert found[900].score > found[906].score and found[902].score == found[903].score
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for k, r in found.items())
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(corpus.empty(spark), none).count() == 0
    assert {r.predicted for r in toxicity.toxicity_scores(corpus.table(spark, rows[:5]), none).collect()} == {0}


def test_exception_phrases_cancel_hits():
    x = toxicity.Lexicon({"trash ": 3.0, "moro": 4.0}, {"trash can"})
    assert [h[3] for h in x.hits("the trash can, Trash! and tr4sh, untrash trashy moronic")] == ["trash ", "trash ", "moro"]
    assert x.hits("") == [] and toxicity.Lexicon().hits("trash") == []


def test_entries_with_the_same_letters(spark):
    text = "a trash here, trashy there"
    for weights in ({"trash": 4.5, "trash ": 3.0}, {"trash ": 3.0, "trash": 4.5}):
        assert sorted(h[2:] for h in toxicity.Lexicon(weights).hits(text)) == [(4.5, "trash"), (4.5, "trash")]
    assert [h[2:] for h in toxicity.Lexicon({"trash": 2.5, "trash ": 3.0}).hits(text)] == [(3.0, "trash "), (2.5, "trash")]
    assert toxicity.Lexicon({"trash can": 3.0, "trash can ": 4.0}, {"trash can"}).hits("a trash can") == []


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab c4@"), max_size=40), st.dictionaries(st.text(st.sampled_from("abc"), min_size=1, max_size=3).flatmap(lambda w: st.sampled_from([w, w + " "])), st.integers(1, 9), max_size=6), st.sets(st.sampled_from(["a b", "b ca", "ab c"])))
def test_hits_against_a_plain_search(text, weights, exceptions):
    seen = text.lower()
    shown = seen.replace("4", "a").replace("@", "a")
    begins = lambda i: i == 0 or not (seen[i - 1].isalpha() or shown[i - 1].isalpha() and seen[i - 1] not in "4@")
    found = {}
    for i in range(len(text)):
        for p, w in weights.items():
            body = p.rstrip(" ")
            end = i + len(body)
            if shown.startswith(body, i) and begins(i) and not (p[-1] == " " and end < len(seen) and seen[end].isalpha()):
                found[i] = max(found.get(i, 0), w)
    freed = [(i, i + len(p)) for p in exceptions for i in range(len(text)) if shown.startswith(p, i) and begins(i) and not (i + len(p) < len(seen) and seen[i + len(p)].isalpha())]
    hits = toxicity.Lexicon({k: float(v) for k, v in weights.items()}, exceptions).hits(text)
    ends = {h[0]: h[1] for h in hits}
    want = {i: w for i, w in found.items() if i not in ends or not any(a <= i and ends[i] <= b for a, b in freed)}
    got = {h[0]: h[2] for h in hits}
    assert all(got[i] == found[i] for i in got)
    assert all(any(a <= i and b > i for a, b in freed) for i in want if i not in got)


def test_the_same_lexicon_whatever_the_hash_seed():
    code = "from lodestrata.llm import toxicity as t; print(list(t.choose({p: (9, 0) for p in ('abcde', 'abcd ', 'abcdef', 'zzzzz', 'zzzzz ', 'qrst', 'qrstu ')}, 20, 20)))"
    seen = {subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONHASHSEED": str(k)}).stdout.splitlines()[-1] for k in range(4)}
    assert len(seen) == 1


def test_lattice_sums_all_segmentations():
    path = public_tokenizers.path("piece_bpe_32k.model")
    x = lattice.Lattice(path, {}, 3)

    def brute(text):
        if not text:
            return 1.0
        out = 0.0
        for n in range(1, len(text) + 1):
            if text[:n] in x.logs:
                out += math.exp(x.logs[text[:n]]) * brute(text[n:])
            elif n == 1:
                out += math.exp(sum(x.bytes[b] for b in text[:1].encode())) * brute(text[1:])
        return out

    for word in ("the", "thing", "stable", "ß日", "\U0001f600a", ""):
        assert x.log10(word) == pytest.approx(math.log10(brute(lattice._MARK + word)), abs=1e-9)
    assert x.log10("a" * 5000) < -1000


def test_document_scores_against_plain_python(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = corpus.documents()
    docs = corpus.table(spark, rows)
    lower = lambda s: [w.encode().lower() for w in WORD.findall(s or "")]
    learn = [(i, s) for i, s in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for _, s in learn for w in lower(s))
    n, v = sum(c.values()) + len(learn), len(c) + 1
    for most in (300_000, 5):
        found = lattice.document_scores(docs, path, most=most).collect()
        assert len(found) == len(rows) and {r.train_tokens for r in found} == {n}
        want = sorted((str(i), len(lower(s)) + 1, 1 + sum(c[w] > 0 for w in lower(s)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in lower(s)) + math.log10((len(learn) + 1) / (n + v + 1)), 6)) for i, s in rows)
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    assert lattice.document_scores(corpus.empty(spark), path).count() == 0
