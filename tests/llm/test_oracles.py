import duckdb
import pytest

from marlstone.llm import entry


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_against_sql(spark, name, folder):
    path = f"/root/testdata/{folder}"
    df = entry.queries()[name](spark, path)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    cur = con.execute(entry.oracle_sql()[name])
    assert [d[0] for d in cur.description] == df.columns
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(cur.fetchall(), key=repr)


def test_queries_cover_the_operators():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries())
    assert numbers == list(range(1, 11))
