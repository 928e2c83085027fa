"""The entry point without the training-text operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_text_operators(tmp_path):
    skip = lambda folder, names: [n for n in names if n in ("llm", "corpus_pipeline.py", ".git", "__pycache__")]
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 180 and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "copy")})
    assert done.returncode == 0, done.stderr
