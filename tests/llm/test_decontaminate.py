import random

import pytest

from marlstone.llm import decontaminate as dc


def digest(spark, docs, bench, **more):
    from pyspark.sql import functions as F

    out = dc.contamination(docs, bench, **more)
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_hit, len(r["items"]), r.sha) for r in out.withColumn("sha", dc.items_digest()).withColumn("k", F.lit(1)).collect())


@pytest.mark.parametrize("block_words", [dc.BLOCK_WORDS, 30])
def test_against_brute_force(spark, monkeypatch, block_words):
    rng = random.Random(1)
    words = ["the", "of", "Ünd", "x9"] * 4 + [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(25)] + [(90, None), (91, ""), (92, "w1"), (3, "w2, w3!"), (3, "w2, w3!")]
    rows = []
    for d in range(120):
        text = rng.choices(words, k=rng.randint(0, 80))
        if d % 3 == 0:
            source = items[rng.randrange(25)][1].split()
            text += [w.upper() for w in source[rng.randrange(len(source)) :]]
        rows.append((d, "; ".join(text)))
    rows += [(500, None), (501, ""), (None, items[0][1]), (502, items[1][1] + " tail"), (502, items[1][1] + " tail"), (503, "w1 " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = digest(spark, docs, bench, block_words=block_words)
    found = {}
    for row in rows:
        found[row] = dc.brute_force([row], items)[row[0]]
    assert got == sorted((d is not None, d or 0, *found[d, t]) for d, t in rows)


def test_proximity(spark):
    item = "a b c d e f g h i j"
    docs = [(1, item), (2, "a b c d e x f g h i j"), (3, "a b c d e x x x f g h i j"), (4, "j i h g f e d c b a"), (5, "a b c d e")]
    out = dc.contamination(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame([("q", item)], "item_id string, text string"), slop=2)
    got = {r.doc_id: (r.n_hit, r["items"], r.near_items) for r in out.collect()}
    assert got == {1: (10, ["q"], ["q"]), 2: (0, [], ["q"]), 3: (0, [], []), 4: (0, [], []), 5: (0, [], [])}


def segments(spark, rows, **bounds):
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    return [dc.Segment(bytes(r.data)) for r in dc.build_index(df, **bounds).collect()]


def test_segments_are_bounded(spark):
    rows = [(i, f"w{i} b c") for i in range(10)]
    assert [len(s.keys) for s in segments(spark, rows, segment_words=9)] == [3, 3, 3, 1]
    assert [len(s.keys) for s in segments(spark, [(i, "" if i % 2 else None) for i in range(10)], segment_docs=4)] == [4, 4, 2]  # a flood of empty texts
    long_words = segments(spark, [(i, "x" * 1000) for i in range(10)], segment_bytes=3000)
    assert [len(s.keys) for s in long_words] == [3, 3, 3, 1] and all(s.terms == [b"x" * 1000] for s in long_words)
    one = segments(spark, [(None, "b a " * 5), (7, ""), (8, "a")])[0]
    assert one.keys.to_pylist() == [None, 7, 8] and one.lengths.tolist() == [10, 0, 1] and one.terms == [b"b", b"a"]
    assert [one.postings[one.bounds[t] : one.bounds[t + 1]].tolist() for t in (0, 1)] == [[0, 2, 4, 6, 8], [1, 3, 5, 7, 9, 10 + 2 * dc.GAP]]


def test_memory_of_phrases():
    rng = random.Random(2)
    phrases = dc.Phrases([(str(i), " ".join(f"t{rng.randrange(50_000)}" for _ in range(500)).encode()) for i in range(400)])
    size = phrases.grid.nbytes + phrases.items.nbytes + phrases.bounds.nbytes + phrases.widths.nbytes
    assert len(phrases.grid) == 400 * 491 and size < 80 * len(phrases.grid)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination(none, bench).count() == 0
    assert [tuple(r) for r in dc.contamination(one, bench).collect()] == [(1, 2, 0, [], [])]


@pytest.mark.parametrize("parts", [1, 2, 3, 7])
def test_clean_documents(spark, parts):
    rows = [(1, "a b c", 4), (2, "x", 5), (2, "a b c", 6), (None, "y", 7), (None, "A b, c", 8), (None, None, 9), (3, "x", 5), (3, "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __hit int").repartition(parts)
    out = dc.clean_documents(docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    kept = [r for r in rows if dc.brute_force([r[:2]], [(1, "a b c")])[r[0]][1] == 0]
    assert out.columns == docs.columns and sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, kept)) and len(kept) == 5
