"""Operators that compare documents with one another, against brute force."""

import hashlib
import random
import resource
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import chat, decontaminate, order_minhash, passages, suffixes
from lodestrata.llm import words as W
from lodestrata.llm.common import text_chunks

from . import corpus


def removed(rows, length=50):
    first, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    rank = lambda i: (i is None, i or 0)
    for i, s in order:
        b = (s or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w not in first or rank(i) < first[w]:
                first[w] = rank(i)
    for i, s in rows:
        b = (s or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < rank(i):
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("many", [4096, 3, 0])
def test_exact_strings(spark, monkeypatch, many):
    monkeypatch.setattr(suffixes, "MANY_BLOCKS", many)
    rng = random.Random(4)
    rows = corpus.documents()
    line = "a line that very many documents hold, word for word, to the end."
    rows += [(100 + k, corpus.sentence(rng, 12) + "\n" + line + "\n" + corpus.sentence(rng, 12)) for k in range(60)]
    rows += [(200, rows[1][1][10:75]), (201, rows[1][1][5:54]), (202, "ab" * 200), (203, "ba" * 300), (199, "z" * 49), (198, "z" * 50), (197, "z" * 90)]
    found = suffixes.remove_repeats(corpus.table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == removed(rows)
    assert suffixes.remove_repeats(corpus.empty(spark)).count() == 0


def test_an_anchor_in_many_contexts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "MANY_BLOCKS", 200)
    rng = random.Random(11)
    lines = [f"=footer-{k:07d}=" for k in range(20_000)]  # as long as an anchor; the one of least hash is chosen wherever it stands
    held = W.Texts.joined([x.encode() for x in lines])
    line = lines[int(W.span_hashes(held.prefix_hashes(), held.at[:-1], held.at[1:]).argmin())]
    near = [(corpus.sentence(rng, 6), corpus.sentence(rng, 6)) for _ in range(40)]
    rows = []
    for k in range(3000):
        a, b = rng.choice(near) if rng.random() < 0.2 else (corpus.sentence(rng, 6), corpus.sentence(rng, 6))
        cut = rng.randrange(1, 30)
        rows.append((k, (a[-cut:] if rng.random() < 0.5 else a) + line + b))
    found = suffixes.remove_repeats(corpus.table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == removed(rows)
    texts = suffixes.chunk_table(corpus.table(spark, rows)).drop("rest")
    codes = suffixes._entries(texts, 4, 50, 16).groupBy("bucket").applyInArrow(suffixes._settle(200), "chunk long, bucket long, codes binary")
    answers = codes.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "codes")).alias("answers"))
    sent = suffixes._answers(texts.join(answers, "chunk"), 4, 50, 16).collect()
    keys = np.concatenate([np.frombuffer(r["heads"], suffixes._SENT)["key"] for r in sent if r["kind"] == suffixes.BLOCKS] or [np.zeros(0, np.uint64)])
    assert not len(keys) or np.unique(keys, return_counts=True)[1].max() <= 200  # no task has more of a key
    assert sum(r["n"] for r in sent if r["kind"] == suffixes.WINDOWS) > 20_000


def test_different_bytes_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(suffixes.Extensions, "same", lambda self, i, j, n: np.ones(len(i), bool))
    texts = W.Texts.joined([b"abcdef", b"abcxyz", b"zzabcz"])
    block, low, high = suffixes.equal_windows(texts, np.array([1, 2, 3]), np.zeros(3, np.uint64), np.array([0, 0, 2]), 3, 1)
    assert list(zip(block.tolist(), low.tolist(), high.tolist())) == [(1, 0, 0), (2, 2, 2)]


@pytest.mark.parametrize("limit", [1, 5, 40, 10_000])
def test_pieces_keep_keys_together(monkeypatch, limit):
    monkeypatch.setattr(suffixes, "PIECE_BYTES", limit)
    rng = np.random.default_rng(3)
    key, size = rng.integers(0, 30, 200), rng.integers(1, 9, 200)
    got = [p.tolist() for p in suffixes.pieces(key, size)]
    assert sorted(sum(got, [])) == list(range(200)) and sum(len(set(key[p])) for p in got) == len(set(key.tolist()))
    assert all(size[p].sum() <= limit or len(set(key[p])) == 1 for p in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text("ab", max_size=12)), max_size=40), st.integers(1, 12), st.booleans())
def test_merge_sort_of_suffixes(rows, limit, back):
    texts = W.Texts.joined([t.encode() for _, t in rows])
    start = texts.at[1:] if back else texts.at[:-1]
    held = suffixes.Extensions(texts, texts.prefix_hashes(), start, np.minimum(np.diff(texts.at), limit), back)
    group = np.array([g for g, _ in rows], np.int64)
    word = [(t[::-1] if back else t)[:limit] for _, t in rows]
    assert held.merge_sorted(group).tolist() == sorted(range(len(rows)), key=lambda k: (rows[k][0], word[k], k))
    common = lambda a, b: next((n for n in range(min(len(a), len(b))) if a[n] != b[n]), min(len(a), len(b)))
    want = [max([common(word[i], word[j]) for j in range(len(rows)) if j != i and rows[i][0] == rows[j][0]], default=0) for i in range(len(rows))]
    assert suffixes.longest(*held.neighbours(group)).tolist() == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=6))
def test_word_hashes_agree_with_words(texts):
    found = W.Texts.joined(texts)
    starts, ends, at = found.words()
    want = [w for t in texts for w in t.split()]
    assert [found.data[i:j].tobytes() for i, j in zip(starts, ends)] == want
    assert np.diff(at).tolist() == [len(t.split()) for t in texts]
    hashes = W.span_hashes(found.prefix_hashes(), starts, ends)
    assert len(set(hashes.tolist())) == len(set(want))


def test_compact_windows_against_the_definition():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 62, 60, dtype=np.uint64) << np.uint64(1)
    at = np.array([0, 25, 25, 60])
    middle, left, right = passages.compact_windows(hashes, at, 5)
    got = sorted(zip(left.tolist(), middle.tolist(), right.tolist()))
    want = []
    for a, b in zip(at, at[1:]):
        for c in range(a, b):
            i, j = c, c
            while i > a and hashes[i - 1] > hashes[c]:
                i -= 1
            while j + 1 < b and hashes[j + 1] >= hashes[c]:
                j += 1
            if j - i + 1 >= 5:
                want.append((i, c, j))
    assert got == sorted(want)


def test_passages(spark):
    rows = corpus.documents()
    docs = corpus.table(spark, rows)
    found = passages.repeated_passages(docs).collect()
    pairs = {(r.doc_id, r.source_id) for r in found}
    assert (12, 10) in pairs and (3, 2) in pairs and (6, 5) in pairs
    assert all(r.similarity >= 0.8 and r.n_words >= 50 for r in found) and all(a in (3, 6, 12) for a, _ in pairs)
    got = next(r for r in found if (r.doc_id, r.source_id) == (12, 10))
    assert got.start == 0 and got.n_words == 70
    left = passages.without_repeats(docs)
    assert left.schema == docs.schema
    texts = {r.doc_id: r for r in left.collect()}
    assert 3 not in texts and 40 in texts and texts[12].text.split() == rows[12][1].split()[70:] and texts[12].n_chars == len(texts[12].text)
    assert texts[10].text == rows[10][1] and left.count() >= len(rows) - 2
    assert passages.repeated_passages(corpus.empty(spark)).count() == 0 and passages.without_repeats(corpus.empty(spark)).count() == 0


@pytest.mark.parametrize("step", [8, 12, 20, 40])
def test_exact_repeats_behind_an_earlier_edited_copy(spark, step):
    rng = random.Random(21)
    rows, wanted = [], set()
    for k in range(100):
        passage = corpus.sentence(rng, 60).split()
        edited = [f"e{k}x{j}" if j % step == step // 2 else x for j, x in enumerate(passage)]
        rows += [(k, corpus.sentence(rng, 40) + " " + " ".join(edited) + " " + corpus.sentence(rng, 40))]
        rows += [(1000 * n + k, corpus.sentence(rng, 40) + " " + " ".join(passage) + " " + corpus.sentence(rng, 40)) for n in (1, 2)]
        wanted.add(2000 + k)
    found = {}
    for r in passages.repeated_passages(corpus.table(spark, rows)).collect():
        found.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    assert {i for i in wanted if len(found.get(i, set()) & set(range(40, 100))) >= 50} == wanted


def test_passages_near_each_other_against_brute_force(spark):
    rng = random.Random(22)
    rows, near = [], []
    for k in range(120):
        passage = corpus.sentence(rng, 80).split()
        edited = list(passage)
        for j in rng.sample(range(80), rng.randint(0, 2)):
            edited[j] = f"e{k}x{j}"
        for n, words in enumerate((passage, edited)):
            rows.append((1000 * n + k, corpus.sentence(rng, 40) + " " + " ".join(words) + " " + corpus.sentence(rng, 40)))
        if jaccard(" ".join(passage), " ".join(edited)) >= 0.8:
            near.append(1000 + k)
    found = {r.doc_id for r in passages.repeated_passages(corpus.table(spark, rows)).collect()}
    assert len(set(near) & found) >= 0.98 * len(near) and all(i >= 1000 for i in found)


def behind_edited_holders(n, holders, seed=23):
    """Rows, and the ids of near copies of a passage whose keys up to `holders` edited copies under the threshold hold too."""
    rng = random.Random(seed)
    rows, near = [], []
    for k in range(n):
        words = corpus.sentence(rng, rng.randint(80, 120)).split()

        def edited(step, mark):
            first = rng.randrange(step)
            return " ".join(f"{mark}{k}x{j}" if j % step == first else x for j, x in enumerate(words))

        copies = [(0, " ".join(words))] + [(rng.choice([-1, 1]) * (h + 1), edited(rng.randint(12, 24), f"h{h}")) for h in range(holders)]
        copy = edited(rng.randint(60, 100), "e")
        if jaccard(" ".join(words), copy) >= 0.8:
            near.append(1000 * (k + 1) + 500)
        rows += [(1000 * (k + 1) + place, corpus.sentence(rng, 30) + " " + text + " " + corpus.sentence(rng, 30)) for place, text in copies]
        rows.append((1000 * (k + 1) + 500, corpus.sentence(rng, 30) + " " + copy + " " + corpus.sentence(rng, 30)))
    return rows, near


@pytest.mark.parametrize("holders", [2, 30])
def test_near_copies_behind_many_edited_holders(spark, holders):
    rows, near = behind_edited_holders(150, holders)
    found = {(r.doc_id, r.source_id) for r in passages.repeated_passages(corpus.table(spark, rows)).collect()}
    assert len(near) > 100 and [i for i in near if i not in {a for a, _ in found}] == []
    assert all(a // 1000 * 1000 - 500 <= b < a for a, b in found)


def test_holders_in_blocks_give_the_same_passages(spark):
    docs = corpus.table(spark, behind_edited_holders(12, 30)[0])
    whole, blocks = ({(r.doc_id, r.start, r.n_words) for r in passages.repeated_passages(docs, tile).collect()} for tile in (passages.TILE, 5))
    covered = [{(i, k) for i, start, n in found for k in range(start, start + n)} for found in (whole, blocks)]
    assert covered[0] and {i for i, _ in covered[0]} == {i for i, _ in covered[1]} and len(covered[0] ^ covered[1]) <= 0.02 * len(covered[0])


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 1 << 30))
def test_windows_alike_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 14))
    size = rng.integers(46, 80, n)
    base = rng.integers(0, 60, 80)  # tokens repeat, and all windows share some
    texts = [np.where(rng.random(k) < rng.choice([0.5, 0.9, 1]), base[:k], rng.integers(0, 400, k)) for k in size]
    group, doc, side = np.sort(rng.integers(0, 2, n)), rng.integers(0, 9, n), rng.integers(0, 3, n)
    asks, answers, middle = rng.random(n) < 0.8, rng.random(n) < 0.8, rng.integers(0, size)
    pairs = passages.alike(group, doc, side, middle, asks, answers, np.concatenate(texts).astype("<u4"), np.concatenate([[0], np.cumsum(size)]))
    got = [p for mine, theirs in pairs for p in zip(mine.tolist(), theirs.tolist(), strict=True)]

    def passage(a, b):
        hit = np.isin(texts[a], texts[b])
        return any(9 * hit[i:j].sum() >= 8 * (j - i) for i in range(middle[a] + 1) for j in range(max(middle[a] + 1, i + 46), size[a] + 1))

    want = [(a, b) for a in range(n) for b in range(n) if group[a] == group[b] and doc[b] < doc[a] and asks[a] and answers[b] and (side[a] != side[b] or not side[a]) and passage(a, b)]
    assert sorted(got) == want


def crowd(n, size, seed=31):
    """Holders of one key, each near the others, with their tokens: as `_matches` takes them."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 30, size)
    tokens = np.where(rng.random((n, size)) < 0.97, base, rng.integers(0, 1 << 30, (n, size))).astype("<u4").ravel()
    w = np.zeros(n, passages._HOLDER)
    w["doc"], w["row"], w["middle"], w["open"] = rng.permutation(n), np.arange(n), size // 2, True
    w["left"], w["right"] = size // 2, size - size // 2 - 1
    return w, np.zeros(n, np.int64), tokens, np.arange(n + 1) * size


def test_a_window_stops_at_its_first_holder_however_few_pairs_are_held_at_once(monkeypatch):
    whole = sorted(passages._matches(*crowd(150, 60)))
    assert len({r[2] for r in whole}) == len(whole) > 100
    monkeypatch.setattr(passages, "_EXPANDED", 1 << 11)
    assert sorted(passages._matches(*crowd(150, 60))) == whole


def test_memory_of_a_crowded_key():
    held = crowd(900, 60)
    tracemalloc.start()
    try:
        assert sum(1 for _ in passages._matches(*held)) > 800
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()


def test_steps_work_in_memory_that_the_worker_has():
    rng = random.Random(32)
    texts, faults = [corpus.sentence(rng, 40000).encode()], []

    def step(table):
        for _ in range(4):
            before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
            passages.Chunk(W.Texts.joined(texts), np.zeros(1, np.int64)).windows()
            faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
        return table

    passages._reusing(step)(None)
    assert faults[-1] < 1000, faults


def test_only_shared_keys_are_sorted_by_their_ties(monkeypatch):
    rng, sizes, lexsort = np.random.default_rng(33), [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sizes.append(len(keys[0])) or lexsort(keys))
    c = passages.Chunk(W.Texts.joined([corpus.sentence(random.Random(k % 9), 400).encode() for k in range(10)]), np.arange(10)[::-1])
    c.windows()
    assert c.docs.max() == 2 and 0 < sum(sizes) < 0.5 * len(c.entry)
    head = np.zeros(3000, passages._HEAD)
    head["doc"], head["function"], head["docs"] = rng.integers(0, 50, 3000), rng.integers(0, 5, 3000), 1
    key = np.where(rng.random(3000) < 0.9, rng.permutation(3000) + 100, rng.integers(0, 100, 3000)).astype("<u4")
    sizes.clear()
    passages._pairs(pa.table({"bucket": [0], "chunk": [5], "n": [3000], "keys": [key.tobytes()], "heads": [passages.packed(head)]}))
    assert 0 < sum(sizes) < 1000
    order, shared = passages.ordered(key, head["doc"], head["function"])
    assert order.tolist() == lexsort((head["doc"], head["function"], key)).tolist()
    assert shared.tolist() == (np.unique(key, return_counts=True)[1][np.unique(key, return_inverse=True)[1]] > 1)[order].tolist()


def test_texts_that_none_asks_for_are_not_hashed(monkeypatch):
    rng, hashed, prefix_hashes = random.Random(34), [], W.Texts.prefix_hashes
    texts = [corpus.sentence(rng, 80).encode() for _ in range(40)]
    c = passages.Chunk(W.Texts.joined(texts), np.arange(40))
    tokens = c.shingles[c.at[7] : c.at[8]].astype("<u4")
    ask = np.array([(3, 90, 2, 0, len(tokens), 7, 0, len(tokens))], passages._ASK)
    monkeypatch.setattr(W.Texts, "prefix_hashes", lambda self: hashed.append(len(self.data)) or prefix_hashes(self))
    row = {"ids": list(range(40)), "sizes": [len(t) for t in texts], "body": zstandard.ZstdCompressor().compress(b"".join(texts)), "asks": [{"ask": ask.tobytes(), "tokens": tokens.tobytes()}]}
    (found,) = passages._verified(pa.Table.from_pylist([row])).to_pylist()
    assert (found["doc_id"], found["start"], found["n_words"], found["source_id"]) == (90, 0, len(tokens) + 4, 7)
    assert hashed == [len(texts[7])]


def test_rows_of_many_parts_are_joined():
    rows = np.zeros(7, passages._HOLDER)
    rows["key"], rows["doc"], rows["side"] = np.arange(7) << 40, -np.arange(7), np.arange(7) % 3
    got = passages._unpacked([passages.packed(rows[i:j]) for i, j in ((0, 3), (3, 3), (3, 7))], passages._HOLDER)
    assert got.dtype == rows.dtype and got.tolist() == rows.tolist()
    assert passages._unpacked([], passages._HOLDER).tolist() == []


def test_chunks_stay_the_same_when_plans_change(spark):
    docs = corpus.table(spark, corpus.documents(n=120))
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts, found, left = suffixes.remove_repeats(docs), passages.repeated_passages(docs), passages.without_repeats(docs)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == held
    want = [sorted(map(str, df.drop("kept").collect())) for df in (texts, found, left)]
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        texts, found, left = (df.select("*") for df in (texts, found, left))
        assert [sorted(map(str, df.drop("kept").collect())) for df in (texts, found, left)] == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_null_texts_stay_null(spark):
    docs = corpus.table(spark, corpus.documents())
    left = {(r.doc_id, r.n_chars): r.text for r in passages.without_repeats(docs).collect()}
    assert left[(40, 1)] is None and left[(41, 1)] == ""


def test_a_passage_in_many_documents_makes_one_pair_each(spark):
    rng = random.Random(7)
    passage = corpus.sentence(rng, 80)
    rows = [(k, corpus.sentence(rng, 30) + " " + passage + " " + corpus.sentence(rng, 30)) for k in range(150)]
    found = passages.repeated_passages(corpus.table(spark, rows)).collect()
    assert {r.doc_id for r in found} == set(range(1, 150)) and len(found) <= passages.FUNCTIONS * 149 and all(r.source_id < r.doc_id for r in found)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j - 1] + (x != y), row[j] + 1, out[-1] + 1))
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25), st.integers(0, 20))
def test_banded_edit_distance(a, b, limit):
    x, y = (W.mix(np.array(v, np.uint64) + np.uint64(1)) for v in (a, b))
    want = edits(a, b)
    assert order_minhash.edit_distance(x, y, limit) == (want if want <= limit else limit + 1)


def test_near_duplicates(spark):
    rng = random.Random(2)
    rows = corpus.documents()
    base = corpus.sentence(rng, 150).split()
    for k in range(60):  # a large group of near copies
        w = list(base)
        w[rng.randrange(150)] = f"edit{k}"
        rows.append((1000 + k, " ".join(w)))
    docs = corpus.table(spark, rows)
    found = order_minhash.near_duplicates(docs).collect()
    classes = {}
    for r in found:
        classes.setdefault(r.doc_id, r.class_id)
    assert len(found) == len(rows) and {classes[1000 + k] for k in range(60)} == {1000}
    assert classes[3] == 2 and classes[6] == 5 and classes[41] == classes[40] == 40 and classes[42] == 42
    assert all(classes[i] == i for i in range(40) if i not in (3, 6))
    kept = order_minhash.one_of_each(docs)
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert kept.schema == docs.schema and len(ids) == len(set(ids)) and "1000" in ids and "1001" not in ids and "0" in ids
    assert order_minhash.near_duplicates(corpus.empty(spark)).count() == 0


def test_chunks_are_cut_by_bytes():
    texts = [None, "", "a" * 5, "é" * 4, "b" * 30, "c", "d" * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(texts[::-1])], ["text", "other"])
    for columns in (("text",), ("text", "other")):
        parts = [p.to_pylist() for p in text_chunks(batch, 12, columns)]
        assert sum(parts, []) == batch.to_pylist()
        size = lambda r: sum(len((r[c] or "").encode()) for c in columns)
        assert all(len(p) == 1 or sum(map(size, p)) <= 12 for p in parts) and max(map(len, parts)) > 1


def test_copies_of_one_text_that_are_unlike_each_other(spark):
    rng = random.Random(11)
    base = corpus.sentence(rng, 300).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 151):
        w = list(base)
        for j in rng.sample(range(2, 298, 6), 6):
            w[j] = f"edit{k}x{j}"
        rows.append((k, " ".join(w)))
    found = order_minhash.near_duplicates(corpus.table(spark, rows)).collect()
    assert len(found) == 151 and sum(r.class_id == 0 for r in found) >= 150  # a copy shares no key with the text in 1 of 10,000 cases


def by_class(rows):
    held = {}
    for r in rows:
        held.setdefault(r.class_id, set()).add(r.doc_id)
    return {frozenset(x) for x in held.values() if len(x) > 1}


def test_every_pair_of_a_key_is_met(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for k in range(40):  # unlike texts in one key, each with one copy
        w = corpus.sentence(rng, 60)
        rows += [(2 * k, w), (2 * k + 1, w + " more")]
    docs = corpus.table(spark, rows)
    held = order_minhash.sketches
    monkeypatch.setattr(order_minhash, "sketches", lambda d: held(d).withColumn("keys", F.array(F.lit(1).cast("long"))))
    assert by_class(order_minhash.near_duplicates(docs).collect()) == {frozenset((2 * k, 2 * k + 1)) for k in range(40)}


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_pairs_within_a_template_against_brute_force(spark):
    rng = random.Random(14)
    template, rows = corpus.sentence(rng, 400).split(), []
    for k in range(60):  # all share the template, each has one near copy
        own = corpus.sentence(rng, 75).split()
        words = template + own
        for j in range(0, 400, 50):
            words[j + rng.randrange(40)] = f"t{k}x{j}"
        copy = list(words)
        for j in rng.sample(range(475), 4):
            copy[j] = f"c{k}x{j}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    linked = {frozenset((a[0], b[0])) for n, a in enumerate(rows) for b in rows[n + 1 :] if jaccard(a[1], b[1]) >= 0.8}
    assert linked == {frozenset((2 * k, 2 * k + 1)) for k in range(60)}
    assert by_class(order_minhash.near_duplicates(corpus.table(spark, rows)).collect()) == linked


def test_rare_shingle_keys_miss_no_similar_pair(spark):
    rng = random.Random(16)
    texts = []
    for _ in range(25):
        base = [rng.choice("abcdefgh") + rng.choice("xy") for _ in range(rng.randint(5, 200))]
        for _ in range(6):
            w = list(base[: rng.randint(len(base) * 7 // 8, len(base))])
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
            texts.append(" ".join(w))
    digest = {t: hashlib.md5(t.encode()).digest() for t in texts}
    held = {}
    for r in order_minhash.rare_shingle_keys(spark.createDataFrame([(d, t) for t, d in digest.items()], "digest binary, text string")).collect():
        held.setdefault(r.key, {}).setdefault(bytes(r.digest), set()).add(r.side)
    together = {frozenset((a, b)) for m in held.values() for a in m for b in m if a != b and any(x == 0 or x != y for x in m[a] for y in m[b])}
    wanted = {frozenset((digest[a], digest[b])) for a in digest for b in digest if a < b and jaccard(a, b) >= 0.8}
    assert len(wanted) > 40 and wanted <= together


def test_reordered_texts_are_no_copies():
    rng = random.Random(3)
    a = corpus.sentence(rng, 300).split()
    h = lambda w: np.array([hash(x) % (1 << 62) for x in w], np.uint64)
    assert order_minhash.similar(h(a), h(a[:149] + ["new"] + a[150:])) and not order_minhash.similar(h(a), h(a[150:] + a[:150]))


def test_benchmark_leaks(spark):
    rng = random.Random(5)
    items = [(k, corpus.sentence(rng, 30).capitalize() + ".") for k in range(20)] + [(20, None), (21, ""), (22, "two words"), (3, "twice numbered item " + corpus.sentence(rng, 12))]
    rows = corpus.documents()
    leak = items[4][1].split()
    edited = [w if j % 6 else "changed" for j, w in enumerate(leak)]
    rows += [(300, corpus.sentence(rng, 50) + " " + items[3][1] + " " + corpus.sentence(rng, 50)), (301, corpus.sentence(rng, 40) + " " + " ".join(edited)), (302, items[5][1].upper()), (303, corpus.sentence(rng, 200))]
    rows += [(400 + k, corpus.sentence(rng, 20) + " " + items[7][1]) for k in range(80)]  # leaked everywhere
    bench = spark.createDataFrame([(*r, "x", "y") for r in items], "item_id long, text string, doc_id string, score string")
    docs = corpus.table(spark, rows)
    for block in (1 << 23, 700):
        got = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_leaks(docs, bench, block).collect()}
        assert got == {(300, 3), (301, 4), (302, 5)} | {(400 + k, 7) for k in range(80)}
    left = decontaminate.without_leaks(docs, bench)
    assert left.schema == docs.schema and left.count() == len(rows) - 83
    assert decontaminate.benchmark_leaks(corpus.empty(spark), bench).count() == 0
    assert decontaminate.benchmark_leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_edited_and_partial_copies_in_hundreds_of_documents(spark):
    rng = random.Random(15)
    items = [corpus.sentence(rng, 20) for _ in range(4)]
    w = [x.split() for x in items]
    edited = " ".join("changed" if j in (6, 13) else x for j, x in enumerate(w[0]))
    third = " ".join("changed" if j % 3 == 2 else x for j, x in enumerate(w[2]))  # no three words in a row
    spread = " ".join(f"{x} put" for x in w[3])  # no two
    rows = [(k, corpus.sentence(rng, 25) + " " + copy + " " + corpus.sentence(rng, 25)) for k, copy in enumerate([edited] * 200 + [" ".join(w[1][:11])] * 200 + [third] * 60 + [spread] * 60)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.benchmark_leaks(corpus.table(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(k, 0 if k < 200 else 1 if k < 400 else 2 if k < 460 else 3) for k in range(520)}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), min_size=1, max_size=16))
def test_alignment_against_the_recurrence(item, passage):
    best = 0
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item, 1):
        for j, y in enumerate(passage, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    assert decontaminate.align(np.array(item), np.array(passage))[0] == best


def test_snapshots_collapse(spark):
    talk = [(t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(150)]
    rows = [(c, *r) for c, n in ((1, 2), (2, 4), (3, 150), (4, 4), (5, 3)) for r in talk[:n]]
    rows += [(6, 0, "user", "turn 0"), (6, 1, "assistant", "else"), (6, 1, "assistant", "else"), (7, 5, None, None), (None, 0, "user", "lone"), (8, None, "user", "turn 0"), (9, 0, "user", "tie b"), (9, 0, "user", "tie a")]
    c = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, pos long, conv long")
    found = chat.collapse(c).orderBy("conv_id", "chunk").collect()
    assert [(r.conv_id, r.chunk, r.n_turns) for r in found] == [(None, 0, 1), (3, 0, 150), (3, 1, 150), (3, 2, 150), (6, 0, 2), (7, 0, 1), (9, 0, 2)]
    whole = "".join(r.rendered for r in found if r.conv_id == 3)
    assert whole == "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for _, r, x in talk)
    assert "tie a" in found[-1].rendered.split("<|im_end|>")[0]
    same = spark.createDataFrame([(k, *r) for k in (7, 3, 9) for r in talk[:3]], "conv_id long, turn long, role string, text string")
    assert [(r.conv_id, r.n_copies) for r in chat.collapse(same).collect()] == [(3, 3)]
    assert chat.collapse(c.limit(0)).count() == 0


def test_chat_is_native(spark, folder):
    c = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.collapse(c)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50])
def test_sketches_of_short_texts(n):
    words = W.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    got = order_minhash.sketch(order_minhash.shingles(words))
    assert len(got) == (0 if n == 0 else order_minhash.FUNCTIONS) and len(set(got.tolist())) == len(got)
