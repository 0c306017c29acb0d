"""The entry file without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "lodestar", tmp_path / "lodestar", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    told = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e, bench; assert len(e.queries()) > 50 and 'pipeline' not in e.queries() and not [q for q in e.queries() if q.startswith('op1')]"],
        cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True,
    )
    assert told.returncode == 0, told.stderr
