import hashlib
import math
import re

import pytest

from marlstone.llm import mixing


def slow_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_ = 1.5 * sum(sizes.values()), set(sizes)
    target = {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def slow_mix(rows):
    size = lambda t: len(re.findall(mixing.WORD, t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target, out = slow_targets(sizes), []
    for source in sizes:
        shift = int(hashlib.md5(f"7:{'n' if source is None else 's' + source}".encode()).hexdigest()[:5], 16) / (1 << 20)
        own = [(size(t), "" if d is None else str(d), d) for d, t, s in rows if s == source]
        own.sort(key=lambda x: (len(str(x[0])) * 100 + int(str(x[0])[:2]), int(hashlib.md5(f"{x[1]}:{x[0]}".encode()).hexdigest()[:15], 16), x[2] is not None, x[2] or 0, x[0]))
        each = target[source] / sizes[source] if sizes[source] else 0.0
        for i, (n, _, d) in enumerate(own):
            copies = min(math.floor((i + 1) * each + shift) - math.floor(i * each + shift), math.ceil(each))
            out.append((d, n, sizes[source], pytest.approx(target[source]), copies * n))
    return out


def rows_of(n=400):
    return [(i, "w " * (i * i % 97), f"s{i % 7 if i % 3 else 0}") for i in range(n)] + [(1000, None, "s1"), (1001, "", None), (1002, "a b", None), (None, "c", "s2"), (5, "c d", "s2"), (5, "c d", "s2"), (1003, "x " * 30_000, "é")]


def result(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", mixing.word_count())
    out = mixing.mix(docs).collect()
    return [(r.doc_id, r["size"], r.source_size, r.target, r.copies * r["size"]) for r in out]


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[4])


@pytest.mark.parametrize("range_rows", [mixing.RANGE_ROWS, 3])
def test_mix(spark, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    got = result(spark, rows_of())
    assert sorted(got, key=key) == sorted(slow_mix(rows_of()), key=key)
    assert all(t <= 2 * n for _, n, _, _, t in got)
    assert sorted(result(spark, rows_of()), key=key) == sorted(got, key=key)


def test_many_rows_without_doc_id(spark, monkeypatch):
    """Of one doc_id and size they are one hash, and are still dealt out: no window sees more than a few."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    monkeypatch.setattr(mixing, "RANGES", 100)
    rows = [(None, "w " * 10, "a") for _ in range(400)] + [(None, "w " * (10 + i % 2), "b") for i in range(300)] + [(i, "w " * 10, "b") for i in range(100)]
    rows += [(7, "w " * 10, "a")] * 90
    assert sorted(result(spark, rows), key=key) == sorted(slow_mix(rows), key=key)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", mixing.word_count())
    keyed = docs.selectExpr("source as __key", "1 as __class", "0 as __range", "xxhash64(doc_id, size) as __hash", "monotonically_increasing_id() as __row")
    cut, ends = mixing.parted(keyed, 20)
    parts = [r["count"] for r in cut.groupBy("__key", "__part", "__sub").count().collect()]
    assert sorted(parts) == sorted(r["__many"] for r in ends.collect()) and sum(parts) == len(rows) and max(parts) <= 120  # 100 ids of one size stay together


def test_targets_and_empty_tables(spark):
    assert result(spark, []) == []
    got = result(spark, [(1, None, "a"), (2, "", None)])
    assert sorted(r[4] for r in got) == [0, 0]
    even = result(spark, [(i, "w " * 10, "ab"[i % 2]) for i in range(2000)])
    taken = {}
    for _, _, _, target, t in even:
        taken[target] = taken.get(target, 0) + t
    assert all(abs(t - target) <= 20 for target, t in taken.items()) and sum(taken) == pytest.approx(30_000)


def test_mixed_documents(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2], i, 1) for i in range(100)], "doc_id long, text string, source string, size long, __rank int")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    rows = [tuple(r) for r in out.collect()]
    assert abs(len(rows) - 150) <= 2 and set(rows) <= {tuple(r) for r in docs.collect()} and max(map(rows.count, rows)) <= 2
