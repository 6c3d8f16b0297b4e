import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "/root/testdata/sf0.001"


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["src", "dst", "referral_count", "last_referral_date"] and df.count() >= 0


def test_core_stands_alone():
    """Nothing outside the subpackage llm imports it."""
    code = "import sys; sys.modules['linkwright.llm'] = None\nimport __spark_entry__ as e, pkgutil, importlib, linkwright\nfor m in pkgutil.walk_packages(linkwright.__path__, 'linkwright.'):\n    if not m.name.startswith('linkwright.llm') and not m.name.endswith('__main__'):\n        importlib.import_module(m.name)\nassert not [k for k in e.queries() if k[0] == 'p' and k[1:2].isdigit() and k[:2] != 'p5']"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
