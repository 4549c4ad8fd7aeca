"""The entry file with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and callable(e.entry); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"


@pytest.mark.parametrize("gone", [["auditloom/llm", "tests/llm"], ["auditloom/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *(Path(g).name for g in gone)))
    out = subprocess.run([sys.executable, "-c", ASK], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    count, ops, pipeline = out.stdout.split()
    assert int(count) > 90 and ops == "0" and pipeline == "False"


def test_entry_runs_without_the_subpackage(tmp_path, spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
