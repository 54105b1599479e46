"""The rest of the library lives without the text operators, with or without the pipeline file."""
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TRY = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); print(len(q), len(set(s) - set(q)), [n for n in q if n.startswith('op') or n == 'pipeline'])"


@pytest.mark.parametrize("gone", [(), ("corpus_pipeline.py",)])
def test_entry_of_a_copy(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(ROOT, "ledgerwell"), copy / "ledgerwell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in gone and os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), copy / name)
    got = subprocess.run([sys.executable, "-c", TRY], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
    assert got.returncode == 0, got.stderr
    count, stray, text = got.stdout.strip().split(" ", 2)
    assert int(count) >= 212 and stray == "0" and text == "[]"
