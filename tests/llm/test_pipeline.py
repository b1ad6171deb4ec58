"""The pipeline's stages one after the other on a small table, each against a plain look at what it leaves."""

import corpus_pipeline
import numpy as np
from lodestrata.llm import decontaminate, order_minhash, quality
from lodestrata.llm import words as W
from lodestrata.sources.tables import stow, table

from . import corpus

DATA = "/root/testdata/sf0.001"


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    left, names = {}, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stow(stage(spark, docs, DATA))
        assert docs.columns == before.columns
        left[name] = {r.doc_id: r.text for r in docs.collect()}
        names.append(name)
    whole = {r.doc_id: r.text for r in table(spark, DATA, "documents").collect()}
    verdicts = quality.quality_verdicts(table(spark, DATA, "documents"), table(spark, DATA, "labels"))
    assert set(left["quality_rules"]) == {r.doc_id for r in verdicts.where("kept").collect()}

    kept, sets = left["near_dedup"], {i: shingles(t) for i, t in left["quality_rules"].items()}
    assert all(kept[i] == whole[i] for i in kept)
    hashes = lambda t: (lambda x: W.span_hashes(x.prefix_hashes(), *x.words()[:2]))(W.Texts.joined([t.encode()]))
    held = {}
    for i, s in sets.items():
        for x in s:
            held.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in held.values() for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    linked = [(a, b) for a, b in pairs if order_minhash.similar(hashes(whole[a]), hashes(whole[b]))]
    assert not [(a, b) for a, b in linked if a in kept and b in kept]
    assert all(any(i in p for p in linked) for i in set(sets) - set(kept))

    seen = {}
    for i in sorted(left["substring_dedup"]):
        w = left["substring_dedup"][i].split()
        for k in range(len(w) - 49):
            assert seen.setdefault(" ".join(w[k : k + 50]), i) == i

    items = [r.text for r in table(spark, DATA, "benchmark").collect() if r.text]
    word = lambda t: decontaminate.word_hashes(decontaminate.lowered(decontaminate.pa.array([t])))[0]
    benchmark = [word(t) for t in items]
    gone = set(left["substring_dedup"]) - set(left["decontaminate"])
    for i, t in left["substring_dedup"].items():
        w = word(t)
        near = [b for b in benchmark if len(b) and np.isin(w, b).sum() >= len(b) / 2]
        assert (i in gone) == any(decontaminate.align(b, w)[0] >= len(b) for b in near)

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in packed} == set(left["decontaminate"])
    rows = {}
    for r in packed:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in rows.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 1024


def test_stages_stand_odd_tables(spark):
    rows = corpus.documents()
    docs = corpus.table(spark, rows)
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, DATA)
        left[name] = found.collect()
        none = stage(spark, corpus.empty(spark), DATA)
        assert none.columns == found.columns and none.count() == 0, name
        if name != "packing":
            assert found.schema == docs.schema and {(r.lang, r.row, r.digest, r.gone_digest) for r in left[name]} <= {("x", "r", "d", "g")}, name
    texts = lambda name: [(r.doc_id, r.text) for r in left[name]]
    assert not [t for _, t in texts("quality_rules") if not (t or "").strip()]
    near = texts("near_dedup")
    assert sum(not (t or "").split() for _, t in near) == 2 and sum(i == 0 for i, _ in near) == 1  # one empty or null text, and one of other spaces
    assert not {3, 6} & {i for i, _ in near} and {2, 5} <= {i for i, _ in near}
    cut = dict(texts("substring_dedup"))
    assert cut[40] is None and cut[41] == "" and len(cut[12].split()) < len(dict(rows)[12].split()) and cut[10] == dict(rows)[10]
    assert sorted(map(str, texts("decontaminate"))) == sorted(map(str, rows))  # no copy of an item is here
    assert sorted({str(r.doc_id) for r in left["packing"]}) == sorted({str(i) for i, _ in rows})


def test_all_queries_are_registered():
    import __spark_entry__

    names = {"op1_quality_rules", "op2_toxicity", "op3_lattice_scores", "op4_compact_windows", "op5_benchmark_leaks", "op6_suffix_dedup", "op7_token_counts", "op8_chat_collapse", "op9_order_minhash", "op10_best_fit_packing", "op11_vector_codes", "op12_fill_in_middle", "op13_simhash", "pipeline"}
    assert {n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"} == names
    assert {"op8_chat_collapse", "op11_vector_codes", "op12_fill_in_middle"} <= set(__spark_entry__.oracle_sql())
