"""The engine without the subpackage for training data, and the entry."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entries

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_training_data_subpackage():
    for p in (ROOT / "quern").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "quern.llm" not in p.read_text(), p


def test_entry_without_the_subpackage():
    """Hidden from the import system, the rest still registers its queries."""
    code = """
import sys, importlib.abc
class Hide(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith("quern.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
assert "p6_found" in e.queries() and "p1_found" not in e.queries() and "p1_found" not in e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=60)


def test_entry(spark):
    df = entries.entry(spark)
    assert df.count() > 0 and df.columns


def test_names():
    assert all(callable(f) for f in entries.queries().values()) and entries.oracle_sql().keys() <= entries.queries().keys()
