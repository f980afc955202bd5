"""The driver's entry points, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("gone", [(), ("corpusloom/llm",), ("corpus_pipeline.py", "corpusloom/llm"), ("corpus_pipeline.py",)])
def test_entry_imports_without(tmp_path, gone):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists() and name not in gone:
            shutil.copy(ROOT / name, tmp_path)
    for name in ("checks", "corpusloom"):
        left_out = [Path(g).name for g in gone if g.startswith(f"{name}/")]
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", *left_out))
    run = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    names = run.stdout.split()
    there = (tmp_path / "corpusloom/llm").is_dir()
    assert any(n.startswith("op1_") for n in names) == there
    assert ("pipeline" in names) == (there and (tmp_path / "corpus_pipeline.py").exists())
    assert "lex_search" in names
