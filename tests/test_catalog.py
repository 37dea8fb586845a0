import os

import pytest

import __spark_entry__
from ipquarry.plans import catalog
from tests.compare import check

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_oracle(spark, name):
    n = check(spark, SMALL, catalog.QUERIES[name], catalog.ORACLE_SQL[name])
    assert n or name == "search_none" or name.startswith("store_") and name.endswith("_none")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_entry_works_without_the_optional_parts(tmp_path):
    """In a process of its own, without the subpackage and the pipeline."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/ipquarry", tmp_path / "ipquarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; from ipquarry.plans import catalog; assert set(e.queries()) == set(catalog.QUERIES); assert set(e.oracle_sql()) == set(catalog.ORACLE_SQL)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
