"""The engine without the folders of the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q); print(sum(n.startswith('op') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("gone", [["colsync/llm", "tests/llm"], ["colsync/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_loads_without(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path, ignore_errors=True) if path.suffix != ".py" else path.unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", ASK], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) == 0 or gone == ["corpus_pipeline.py"]
