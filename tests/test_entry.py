"""The entry point with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_entry_without_the_corpus_operators(tmp_path, pipeline_too):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *(["corpus_pipeline.py"] if pipeline_too else [])))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and len(o) > 100 and set(o) <= set(q); assert not {k for k in q if k.startswith('op') or k == 'pipeline'}"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_entry_with_a_corpus_part_that_cannot_be_imported(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    (copy / "courtline" / "llm").mkdir()
    (copy / "courtline" / "llm" / "__init__.py").touch()
    (copy / "courtline" / "llm" / "queries.py").write_text("import a_module_that_is_nowhere\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and "a_module_that_is_nowhere" in done.stderr, done.stderr
