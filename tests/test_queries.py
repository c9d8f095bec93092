"""Every registered query gives its SQL's rows."""

import pytest
from conftest import DATA, same_rows

from mailquarry.plans import catalog


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLE_SQL])
def test_query_gives_its_sql(spark, duck, name):
    same_rows(catalog.QUERIES[name](spark, DATA), duck.sql(catalog.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL])
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["qid", "doc", "score", "rank"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_stands_without_the_corpus_operators(tmp_path):
    """The package, its entry points and its queries import where those folders are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "mailquarry", tmp_path / "mailquarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op1_') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
