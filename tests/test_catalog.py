"""Every query against its SQL in DuckDB, over the smallest tables."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from skeinlog.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REPO = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_parity(spark, small, db, name):
    got = catalog.queries()[name](spark, small)
    cols = sorted(got.columns)
    want = db.sql(f"select {', '.join(cols)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert Counter(tuple(map(plain, r)) for r in got.select(*cols).collect()) == Counter(tuple(map(plain, r)) for r in want)


def test_each_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["repo", "kind", "magnitude", "evidence_id"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_training_operators(tmp_path):
    """The entry point must import where the folders of the training-data operators are gone."""
    import shutil

    shutil.copytree(REPO / "skeinlog", tmp_path / "skeinlog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert not [n for n in q if n.startswith('op') or n == 'pipeline'] and 'friction_evidence' in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
