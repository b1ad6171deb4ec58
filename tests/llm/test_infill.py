"""Fill-in-the-middle: against a plain reading of the rules, and an exact round trip."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import infill
from lodestrata.llm.infill import Infill

from . import corpus

ODD = ["a\nb\n\nc", "\n", "\n\n", "no line feed", "ends\n", "\r\nx\r\n", "é\n日本\n\U0001f600x\n" * 5, "holds <P> already\nb", "<S>\n", "a <M>", "<P\n>", "<\nS\n<M", "\x0b\x0c x\u0085\n"]


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert "".join(units) == text
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, text, sha(text)
    spm = h4 % 100 < 50
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), out, sha(out)


def test_against_the_rules(spark):
    rows = corpus.documents() + [(1000 + k, t) for k, t in enumerate(ODD)] + [(2000 + k, "x\n" * 300_000) for k in range(2)]
    found = infill.fill_in_middle(corpus.table(spark, rows))
    back = found.select("*", infill.restored("output", "form").alias("text"), infill.restored_sha256("output", "form").alias("sha")).collect()
    assert sorted(map(str, (tuple(r)[:7] for r in back))) == sorted(str(plain(i, t)) for i, t in rows)
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert all(r.sha == hashlib.sha256(r.text.encode()).hexdigest() for r in back)
    assert {r.form for r in back} == {"plain", "spm", "psm"}
    assert infill.fill_in_middle(corpus.empty(spark)).count() == 0


def test_rates_and_other_units(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one two three. four five. six").alias("text"))
    share = {r.form: r["count"] for r in infill.fill_in_middle(docs, Infill(unit=r"\s*\S+", rate=50, spm=100)).groupBy("form").count().collect()}
    assert set(share) == {"plain", "spm"} and 140 < share["plain"] < 260
    assert {r.form for r in infill.fill_in_middle(docs, Infill(rate=0)).collect()} == {"plain"}


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("<PSM>\naé\U0001f600 "), max_size=30), st.one_of(st.none(), st.integers()))
def test_round_trip(text, doc_id):
    key = None if doc_id is None else str(doc_id)
    n, form, prefix, middle, out = Infill().rewrite(key, text)
    assert infill.restore(out, form) == text
    assert (doc_id, n, form, prefix, middle, out, infill.sha256(out)) == plain(doc_id, text)
