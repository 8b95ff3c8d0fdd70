"""The registered queries against their SQL, and the entry module without this subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from compare import compare, connect

from kinloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    same, _, why = compare(spark, connect(SF), registry.queries()[name], registry.oracle_sql()[name], SF)
    assert same, why


def test_entry_without_llm(tmp_path):
    root = Path(__file__).parents[2]
    shutil.copytree(root / "kinloom", tmp_path / "kinloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 100
