"""What the rest is without the corpus operators, and what the entry point offers."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_rest_works_without_the_corpus_operators(tmp_path):
    """Both folders and the pipeline are left out of a copy: it imports, lists the core's queries and its tests can be collected."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if n in ("llm", ".git", "__pycache__", "corpus_pipeline.py", ".pytest_cache")])
    run = lambda *args: subprocess.run([sys.executable, *args], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    listed = run("-c", "import __spark_entry__ as e; assert 'ordina/llm' not in str(e.__dict__); print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))")
    from ordina import queries as core

    assert listed.stdout.split() == [str(len(core.QUERIES)), str(len(core.ORACLE_SQL)), "False"], listed.stderr
    collected = run("-m", "pytest", "--collect-only", "-q", "tests")
    assert collected.returncode == 0, collected.stdout
    tried = run("-m", "pytest", "-q", "-x", "tests/test_splitter.py", "tests/test_streaming.py")
    assert tried.returncode == 0, tried.stdout


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
