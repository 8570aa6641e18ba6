"""Every contract query against its SQL."""

import os
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from triagelake.plans.contract import TABLES
from triagelake.plans.view_contract import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    names = sorted(df.columns)
    return names, sorted(repr(r) for r in df[names].astype(object).where(df[names].notna(), None).values.tolist())


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(db.execute(SQL[name]).df())


def test_entry_without_training_data_operators(tmp_path):
    root = pathlib.Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "triagelake", tmp_path / "triagelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(root / name, tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    assert said.returncode == 0 and set(said.stdout.split()) == set(QUERIES), said.stderr


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["view_ranked_all", "view_recent_all"])
def test_whole_table_is_ranked(spark, db, name):
    n = db.execute("SELECT count(*) FROM orders").fetchone()[0]
    assert sorted(r["place"] for r in QUERIES[name](spark, SF).select("place").collect()) == list(range(1, n + 1))


@pytest.mark.parametrize("name", ["date_list_all", "range_text_all"])
def test_dates_before_2000_are_there(spark, db, name):
    table, key = ("orders", "o_orderkey") if name == "date_list_all" else ("lineitem", "l_orderkey")
    assert QUERIES[name](spark, SF).count() == db.execute(f"SELECT count(DISTINCT {key}) FROM {table}").fetchone()[0]
