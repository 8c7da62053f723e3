"""The library without its training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import __spark_entry__ as e
names = set(e.queries())
assert names and all(n.startswith("q_") for n in names), names
assert set(e.oracle_sql()) <= names
import pkgutil, importlib, quiremill
for m in pkgutil.walk_packages(quiremill.__path__, "quiremill."):
    if not m.name.endswith("__main__"):
        importlib.import_module(m.name)
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_survives_without_the_training_data_operators(tmp_path, pipeline):
    shutil.copytree(ROOT / "quiremill", tmp_path / "quiremill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr[-2000:]
