import os
import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_corpus_subpackage():
    for path in (ROOT / "sparkbars").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.M), path


def test_entry_without_the_corpus_subpackage():
    code = "import sys; sys.modules['sparkbars.llm'] = None; import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 120 and set(o) <= set(q) and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)})


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "profit_factor" in df.columns
