"""Vector codes against a plain computation of rounds, and the coarse-to-fine search against all distances."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, v string"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, "c", 5, "v") for r in rows], schema).repartition(3)


def plain(rows, parts=8, entries=16, rounds=6):
    """Rows (vec_id, embedding, label) to (vec_id, code, error, label_error, sha), with Python's integers."""
    sizes = [len(e) for _, e, _ in rows if e is not None and len(e) and len(e) % parts == 0]
    if not sizes:
        return []
    dims = min(set(sizes), key=lambda n: (-sizes.count(n), n))
    kept = [(i, [math.floor(4096 * x) for x in e], l) for i, e, l in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) and abs(x) < 1e24 for x in e)]
    w = dims // parts
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[x[p * w : (p + 1) * w] for _, x, _ in kept[:entries]] for p in range(parts)]

    def near(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        held = [[[] for _ in b] for b in books]
        for _, x, _ in kept:
            for p in range(parts):
                held[p][near(x[p * w : (p + 1) * w], p)[1]].append(x[p * w : (p + 1) * w])
        books = [[[sum(c) // len(m) for c in zip(*m)] if m else b for m, b in zip(held[p], books[p])] for p in range(parts)]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    found = [(i, l, [near(x[p * w : (p + 1) * w], p) for p in range(parts)]) for i, x, l in kept]
    errors = {}
    for _, l, n in found:
        errors[l] = errors.get(l, 0) + sum(d for d, _ in n)
    fits = lambda n: n if n < 1 << 63 else None
    lost = {l for _, l, n in found if fits(sum(d for d, _ in n)) is None}
    return [(i, "".join(f"{e:02x}" for _, e in n), fits(sum(d for d, _ in n)), None if l in lost else fits(errors[l]), sha) for i, l, n in found]


def same(spark, rows):
    found = vectors.vector_codes(table(spark, rows)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, plain(rows)))
    return found


def cases(seed=0, n=90, dims=24):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (n, dims)), 2).astype(np.float32).tolist()
    return [(int(i), e, int(i) % 4 if i % 7 else None) for i, e in enumerate(x)]


def test_against_plain_rounds(spark):
    rows = cases()
    odd = [(200, None, 1), (201, [None] + [0.5] * 23, 1), (202, [math.nan] * 24, 2), (203, [math.inf] + [0.0] * 23, 2), (204, [], 3), (205, [1.0] * 16, 3), (206, [1.0] * 23, 3), (None, [0.25] * 24, 3), (5, rows[6][1], 2), (7, rows[7][1], None), (208, [-0.0001] * 24, 9), (209, [1e30] * 24, 9)]
    found = same(spark, rows + odd)
    assert len(found) == len(rows) + 4 and len({r.codebooks_sha256 for r in found}) == 1


@pytest.mark.parametrize("n", [0, 1, 5, 16, 17])
def test_few_and_equal_vectors(spark, n):
    same(spark, [(i, [0.5, -0.5] * 8, 1) for i in range(n)])
    same(spark, [(i, [i / 8, -i / 8] * 4, None) for i in range(n)])


def test_large_components(spark):
    rows = [(i, [float(np.float32(x * 10.0 ** (3 * (i % 7)))) for x in e], l) for i, e, l in cases(3, 40, 16)]
    found = same(spark, rows)
    assert any(r.error is None for r in found)


def test_no_usable_vectors(spark):
    assert vectors.vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vectors.vector_codes(table(spark, [(1, None, 1), (2, [1.0] * 5, 1), (3, [], 1)])).count() == 0
    assert vectors.vector_codes(table(spark, [(1, [math.nan] * 8, 1)])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 11), st.integers(1, 20), st.integers(0, 1 << 30), st.sampled_from([1, 3, 40, 5000, 1 << 26, 1 << 40]))
def test_nearest_against_all_distances(width, entries, seed, spread):
    rng = np.random.default_rng(seed)
    books, x = rng.integers(-spread, spread + 1, (entries, width)), rng.integers(-spread, spread + 1, (37, width))
    x[:5], x[5:9] = books[rng.integers(0, entries, 5)], x[9]
    code, error = vectors.nearest(x, books)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, c)), e) for e, c in enumerate(books)) for r in x]
    assert [(int(d), int(e)) for d, e in zip(error, code)] == want


def test_coarse_bounds_rule_entries_out(monkeypatch):
    rng = np.random.default_rng(1)
    books = rng.integers(-900, 900, (16, 8))
    x = books[rng.integers(0, 16, 5000)] + rng.integers(-60, 60, (5000, 8))
    rows, plain_distances = [], vectors.distances
    monkeypatch.setattr(vectors, "distances", lambda a, b: (rows.append(len(a)), plain_distances(a, b))[1])
    vectors.nearest(x, books)
    assert sum(rows) < 5000 * 5  # of 16 entries each


def test_codes_decode_to_entries(spark):
    rows = cases(5, 60, 16)
    held = table(spark, rows)
    books = vectors.learnt_books(held)
    by_id = {i: e for i, e, _ in rows}
    for r in vectors.encoded(held, books).collect():
        x = [math.floor(4096 * v) for v in by_id[r.vec_id]]
        assert sum((a - int(b)) ** 2 for a, b in zip(x, vectors.decoded(r.code, books))) == r.error
