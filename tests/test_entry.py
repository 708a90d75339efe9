"""The library without its training-data subpackage."""

import os
import shutil
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CHECK = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert "flagship" in q and "pipeline" not in q and not [n for n in [*q, *o] if n.startswith("op")], sorted(q)
assert set(o) <= set(q)
"""


def copied(tmp_path, *without):
    to = tmp_path / "copy"
    shutil.copytree(TOP, to, ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__") or os.path.relpath(os.path.join(folder, n), TOP) in without])
    return to


def test_rest_imports_without_the_training_data_folders(tmp_path):
    for k, extra in enumerate(((), ("corpus_pipeline.py",))):
        top = copied(tmp_path / str(k), "grainwise/llm", "tests/llm", *extra)
        subprocess.run([sys.executable, "-c", CHECK], cwd=top, check=True, timeout=120)


def test_rest_collects_without_the_training_data_folders(tmp_path):
    top = copied(tmp_path, "grainwise/llm", "tests/llm")
    subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=top, check=True, timeout=120, capture_output=True)
