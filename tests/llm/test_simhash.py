"""SimHash against a plain computation of fingerprints and all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import simhash

from . import corpus


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """Rows (doc_id, fingerprint) to the smallest doc_id of each one's component."""
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= 3:
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(str(d), f"{f:016x}", str(least.get(top(i)))) for i, (d, f) in enumerate(rows)]


def found(frame):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in frame.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id").collect())


def near_copies(seed, n, length=120):
    rng = random.Random(seed)
    base, out = corpus.sentence(rng, length).split(), []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(length)] = corpus.sentence(rng, 1)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("run,tile", [(256, 4096), (3, 7)])
def test_against_all_pairs(spark, monkeypatch, run, tile):
    monkeypatch.setattr(simhash, "RUN_NODES", run)
    monkeypatch.setattr(simhash, "TILE_NODES", tile)
    rows = corpus.documents() + [(500 + k, t) for k, t in enumerate(near_copies(1, 60))] + [(600, "One  Two\tthree"), (601, "one two three"), (602, "ONE two three four"), (603, "É é"), (604, "a b"), (605, "\x0b \x0c"), (606, "x y z w")]
    assert found(simhash.simhash_components(corpus.table(spark, rows))) == sorted(plain_components([(i, plain_fingerprint(t)) for i, t in rows]))
    assert simhash.simhash_components(corpus.empty(spark)).count() == 0


def ball(rng, n, bits):
    """Numbers about a random middle, each with up to so many bits flipped; and strangers."""
    middle = rng.integers(0, 1 << 63, dtype=np.uint64)
    out = {int(middle)}
    while len(out) < n:
        x = int(middle)
        for b in rng.choice(64, rng.integers(1, bits + 1), replace=False):
            x ^= 1 << int(b)
        out.add(x)
    return out


@pytest.mark.parametrize("run,tile,bits", [(256, 4096, 8), (5, 16, 5), (5, 16, 9), (20, 40, 14), (4, 8, 3)])
def test_links_of_dense_groups(spark, monkeypatch, run, tile, bits):
    monkeypatch.setattr(simhash, "RUN_NODES", run)
    monkeypatch.setattr(simhash, "TILE_NODES", tile)
    rng = np.random.default_rng(bits)
    fps = sorted(ball(rng, 250, bits) | ball(rng, 40, 2) | {int(x) for x in rng.integers(0, 1 << 63, 60, dtype=np.uint64)} | {0, 7, (1 << 64) - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, 1 + k % 5) for k, f in enumerate(signed)], "fp long, weight long")
    links = simhash.links(nodes).collect()
    label = {f: f for f in signed}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in links:
        label[top(r.a)] = top(r.b)
    rows = [(k, f) for k, f in enumerate(fps)]
    want = {}
    for (d, f), (_, _, c) in zip(rows, plain_components(rows)):
        want.setdefault(c, set()).add(f)
    got = {}
    for f, s in zip(fps, signed):
        got.setdefault(top(s), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert len(links) < 12 * len(fps)  # a forest, not all pairs


def test_long_texts_by_blocks(monkeypatch):
    texts = ["", "a", "a b", "a b c", *(corpus.sentence(random.Random(k), 30 * k + 1) for k in range(8)), "word " * 500, " \n x" * 90]
    want = [plain_fingerprint(t) for t in texts]
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(simhash, "TEXT_BLOCK", size)
        assert [simhash.fingerprint(t.encode()) % (1 << 64) for t in texts] == want


@settings(max_examples=200, deadline=None)
@given(st.integers(0, (1 << 64) - 1), st.sets(st.integers(0, 63), max_size=3))
def test_close_pairs_share_a_key(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    assert any((x ^ y) & (m % (1 << 64)) == 0 for m in simhash.masks())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11)), max_size=20))
def test_least_labels(pairs):
    a, b = (np.array([p[k] for p in pairs], np.int64) for k in range(2))
    want = list(range(12))
    for _ in want:
        for i, j in pairs:
            want[i] = want[j] = min(want[i], want[j])
    assert simhash.least_labels(a, b, np.arange(12)).tolist() == want
