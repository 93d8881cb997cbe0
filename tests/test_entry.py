"""The entry module without the corpus operators: the folders are deleted from a copy."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), set(s) <= set(q))"


def _told(folder):
    got = subprocess.run([sys.executable, "-c", SCRIPT], cwd=folder, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr[-2000:]
    return got.stdout.split()


def _copy(tmp_path):
    return shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json"))


def test_without_the_subpackage(tmp_path):
    copy = _copy(tmp_path)
    shutil.rmtree(copy / "junctura" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    assert int(_told(copy)[0]) > 90 and _told(copy)[1:] == ["0", "True"]


def test_without_the_pipeline(tmp_path):
    copy = _copy(tmp_path)
    shutil.rmtree(copy / "junctura" / "llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert _told(copy)[2] == "True"
