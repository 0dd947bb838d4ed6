"""The core works without the corpus subpackage, and without what only that needs."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), any(n.startswith('op') or n == 'pipeline' for n in {**q, **s}))"


def answer(folder, *hidden):
    blocked = "import sys; " + "".join(f"sys.modules[{name!r}] = None; " for name in hidden)
    env = os.environ | {"PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", blocked + ASK], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.split()[-3:]


@pytest.fixture
def copy(tmp_path):
    """The repository without the two folders; the pipeline's file stays."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse"))
    return tmp_path / "repo"


def test_without_the_subpackage(copy):
    import __spark_entry__ as entry

    assert (copy / "corpus_pipeline.py").exists() and not (copy / "tidepool/llm").exists()
    assert answer(copy) == [str(len(entry.registry.QUERIES)), str(len(entry.registry.ORACLE_SQL)), "False"]
    left = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, capture_output=True, text=True, timeout=300)
    assert left.returncode == 0, left.stdout[-2000:]


@pytest.mark.parametrize("name", ["public_tokenizers", "xxhash"])
def test_without_a_library(name):
    import __spark_entry__ as entry

    assert answer(ROOT, name) == [str(len(entry.registry.QUERIES)), str(len(entry.registry.ORACLE_SQL)), "False"]
