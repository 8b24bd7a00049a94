import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from marlstone.llm import sharding
from marlstone.llm.entry import op3_minimax_shards


def checked(docs, rows, shards):
    out = sharding.assign(docs, shards).collect()
    assert len(out) == len(rows)
    keys = {r.text: r.k for r in docs.select("text", sharding.group_of().alias("k")).distinct().collect()}
    sizes = Counter()
    for _, t in rows:
        sizes[t] += len((t or "").encode()) + 8
    order = sorted(sizes, key=keys.get)
    want = dict(zip(order, sharding.brute_force([sizes[t] for t in order], shards), strict=True))
    assert {r.text: r.shard for r in out} == want
    slots = defaultdict(list)
    for r in out:
        assert r["size"] == len((r.text or "").encode()) + 8
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize(("shards", "first_bits", "bucket_rows"), [(24, 16, 16_384), (5, 2, 7), (3, 0, 50), (1, 16, 1)])
def test_against_brute_force(spark, table, monkeypatch, shards, first_bits, bucket_rows):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(sharding, "FIRST_BITS", first_bits or 1)
    monkeypatch.setattr(sharding, "MORE_BITS", 3)
    rng = random.Random(shards)
    rows = [(i, "é" * rng.randrange(60) + str(i % 150)) for i in range(300)] + [(i, "hot text") for i in range(300, 420)]
    rows += [(500, None), (501, None), (502, ""), (None, "null id"), (3, "hot text"), (3, "hot text"), (600, "x" * 3000)]
    checked(table(rows), rows, shards)


def test_fewer_groups_than_shards_and_empty(spark, table):
    rows = [(1, "a"), (2, "b"), (3, "a")]
    checked(table(rows), rows, 24)
    assert sharding.assign(table([])).count() == 0


def test_query(spark, sf):
    rows = op3_minimax_shards(spark, sf).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.grown_shard is None for r in rows) and len(rows) == len(text)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 7, "x", 99), (2, "b", 8, "y", 98)], "doc_id long, text string, group long, bucket string, shard long")
    out = sharding.assign(docs)
    assert out.columns == ["doc_id", "text", "group", "bucket", "_shard", "size", "shard", "slot"]
    assert sorted((r.group, r._shard) for r in out.collect()) == [(7, 99), (8, 98)] and all(r.shard < 24 for r in out.collect())


def test_beside_a_hot_group_shards_stay_even(spark, table):
    """A third of all bytes in one text: one shard for it, and none of the others empty or much above the mean."""
    rows = [(i, f"text {i} " + "x" * (i % 40)) for i in range(900)] + [(i, "hot " * 8) for i in range(1000, 1450)]
    checked(table(rows), rows, 24)
    sizes = Counter()
    for r in sharding.assign(table(rows)).collect():
        sizes[r.shard] += r["size"]
    hot = 450 * 40
    rest = sorted(n for n in sizes.values() if n != hot)
    assert len(sizes) == 24 and max(sizes.values()) == hot and rest[-1] < 1.3 * sum(rest) / 23 and rest[0] > 0.5 * sum(rest) / 23


@pytest.mark.parametrize("hot", [0, 60, 2000])
def test_sql_beside_hot_groups(spark, table, tmp_path, hot):
    rng = random.Random(hot)
    rows = [(i, "é" * rng.randrange(200) + f" {i % 180}") for i in range(200)] + [(500 + i, "hot text") for i in range(hot)]
    rows += [(5000 + i, "w " * (50 * i)) for i in range(hot // 10 % 40)] + [(None, None), (7, None), (8, ""), (9, "x" * 9000)]
    path = f"{tmp_path}/documents.parquet"
    table(rows).coalesce(1).write.parquet(f"file://{path}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = op3_minimax_shards(spark, f"file://{tmp_path}")
    cur = con.execute(sharding.SQL)
    assert [d[0] for d in cur.description] == got.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(cur.fetchall(), key=repr)


def test_one_hot_row(spark, table, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    rows = [(1, "same")] * 300 + [(i, f"t{i}") for i in range(100)]
    checked(table(rows), rows, 4)
