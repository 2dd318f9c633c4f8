"""Every registered query with SQL gives the SQL's rows; the entry works without the subpackage llm."""

import glob
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return c


def plain(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith("op")))
def test_query(spark, duck, name):
    assert plain(entry.queries()[name](spark, DATA).toPandas()) == plain(duck.sql(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if k not in entry.oracle_sql() and not k.startswith("op") and k != "pipeline"))
def test_query_without_sql(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["product_id"]


def test_without_llm(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = (
        "import importlib.util as u; real = u.find_spec\n"
        "u.find_spec = lambda name, *a: None if name in ('factloom.llm', 'corpus_pipeline') else real(name, *a)\n"
        "import __spark_entry__ as e, sys; assert len(e.queries()) > 40 and not any(k.startswith('op') for k in e.queries()) and not any('llm' in k for k in sys.modules if k.startswith('factloom'))"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
