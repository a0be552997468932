"""The driver's entry points work without the subpackage for training data and the pipeline."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [(), ("siftspark/llm",), ("siftspark/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without(tmp_path, gone):
    root = tmp_path / "repo"
    shutil.copytree(HERE, root, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__"))
    for name in gone:
        path = root / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert o.keys() <= q.keys(); print(len(q), 'pipeline' in q)"
    # the copy is meant, not what a caller's path has
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env=env, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, pipeline = out.stdout.split()
    assert int(n) > 100 and (pipeline == "True") <= (not gone)
