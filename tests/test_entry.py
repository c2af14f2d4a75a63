"""The driver's entry: names, flagship, and independence from the llm subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) >= 78


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver's tables are not here")
def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_rest_imports_without_llm(tmp_path):
    for name in ("__spark_entry__.py", "sheafworks"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["mv", str(tmp_path / "sheafworks" / "llm"), str(tmp_path / "gone")], check=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 78 and not [n for n in e.queries() if n.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_llm():
    for path in (ROOT / "sheafworks").rglob("*.py"):
        if "llm" not in path.parts:
            assert "sheafworks.llm" not in path.read_text(), path
