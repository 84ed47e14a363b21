import importlib
import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_sql_has_queries():
    e = importlib.import_module("__spark_entry__")
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark, small):
    e = importlib.import_module("__spark_entry__")
    df = e.entry(spark)
    assert df.columns == ["query_id", "chunk_id", "score", "rank"] and df.count() > 0


def test_core_runs_without_the_subpackage():
    code = "import sys; sys.modules['orrery.llm'] = None; import __spark_entry__ as e; n = list(e.queries()); assert 'search' in n and not any(x.startswith('p1_') for x in n)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "orrery").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
