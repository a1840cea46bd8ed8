"""The driver's contract: the flagship query, and the registry with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_flagship_query(spark):
    assert entry.entry(spark).count() == 200


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "doc_stats" in entry.queries()


def test_the_rest_works_without_the_corpus_subpackage(tmp_path):
    left_out = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=left_out)
    code = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n[:2] == 'op' or n == 'pipeline'), len(e.queries()) > 50, len(e.oracle_sql()) > 50)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=120)
    assert said.stdout.split("\n")[0] == "[] True True", said.stderr[-2000:]
