import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as e
from marlstone import queries as engine

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def plain(row, order):
    return tuple(round(v, 6) if isinstance(v := row[i], float) and not math.isnan(v) else v for i in order)


@pytest.mark.parametrize("name", list(engine.queries()))
def test_against_oracle(spark, sf, name):
    df = e.queries()[name](spark, sf)
    rows = df.collect()
    if name not in e.oracle_sql():
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(e.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = lambda names: sorted(range(len(names)), key=lambda i: names[i])
    assert sorted((plain(r, order(df.columns)) for r in rows), key=repr) == sorted((plain(r, order(columns)) for r in cur.fetchall()), key=repr)


def test_entry(spark):
    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_optional_folder(tmp_path):
    root = os.path.dirname(os.path.abspath(e.__file__))
    shutil.copytree(f"{root}/marlstone", tmp_path / "marlstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) == len(engine.queries()), done.stderr
