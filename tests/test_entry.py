"""The driver's registry."""

import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_registry(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
    assert entry.entry(spark).count() == 3


def test_nothing_else_imports_the_llm_subpackage():
    for p in (ROOT / "gridloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M), p
