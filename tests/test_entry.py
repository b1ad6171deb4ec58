"""The driver's entry works with the corpus operators and without them."""

import os
import shutil
import subprocess
import sys

from .conftest import ROOT

ASK = "import __spark_entry__ as e; print(sorted(e.queries())); print(sorted(e.oracle_sql()))"


def asked(root):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", ASK], cwd=root, env=env, capture_output=True, text=True, check=True, timeout=120).stdout
    return [eval(line) for line in out.strip().splitlines()[-2:]]


def test_entry_without_the_corpus_operators(folder):
    kept = f"{folder}/repo"
    shutil.copytree(ROOT, kept, ignore=lambda d, names: [n for n in names if n in ("llm", ".git", "__pycache__")])
    for gone in ([], ["corpus_pipeline.py"]):
        for name in gone:
            os.remove(f"{kept}/{name}")
        queries, sql = asked(kept)
        assert len(queries) >= 58 and queries == sql and "pipeline" not in queries


def test_every_sql_has_its_query():
    queries, sql = asked(ROOT)
    assert set(sql) <= set(queries)
