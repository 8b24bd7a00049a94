import re

import pytest

from marlstone.llm import quality_rules as q
from marlstone.llm.entry import op5_quality_ratio


def slow_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)} if len(set(grams)) < len(grams) else set()
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(inside)


def test_base_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect() if len(r.text) < 20_000}
    rows = [r for r in op5_quality_ratio(spark, sf).collect() if r.doc_id in text]
    assert len(rows) == len(text)
    for r in rows:
        n, *_, repeats = want = slow_base(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n) and not (r.kept and r.base_failed)
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    clean = [r for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean)


def test_edge_cases(spark, table):
    line = "a b c d e f g h"
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, f"{line}\n{line}\n{line} x"), (4, f"{line}\n{line}\n{line} x"), (None, "é ü # * |\nq\n\nq"), (5, "w " * 20_000), (6, " ".join(f"{i}" for i in range(3000)))]
    out = q.judge(table(rows), spark.createDataFrame([(6, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == sorted((d or 0, *(slow_base(t) if d != 5 else (20_000, 20_000, 0, 0, 20_000))) for d, t in rows)


def test_empty_tables(spark, table):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.judge(table([]), labels).count() == 0
    out = q.judge(table([(1, "w " * 10), (2, " ".join(map(str, range(50))))]), labels).collect()
    assert {r.doc_id: (r.kept, r.score) for r in out} == {1: (False, 0.0), 2: (True, 0.0)}


def test_ratio(spark, table):
    docs = [(i, " ".join(f"good{(i * 7 + k) % 50}" for k in range(45))) for i in range(60)] + [(100 + i, " ".join(f"bad{(i * 5 + k) % 50}" for k in range(45))) for i in range(30)]
    out = q.judge(table(docs), spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int"), z=4.0, buckets=1 << 10).collect()
    assert {r.doc_id for r in out if r.kept} == set(range(60))
    assert [tuple(r) for r in q.trusted_ids(spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int"), 5).orderBy("doc_id").collect()] == [tuple(r) for r in q.trusted_ids(spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int").repartition(7), 5).orderBy("doc_id").collect()]


@pytest.mark.parametrize("bound", [3, 20])
def test_trusted_bound(spark, bound):
    assert q.trusted_ids(spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int"), bound).count() == bound
