import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_mixing import slow_targets
from test_near_copies import slow_set

import corpus_pipeline
from marlstone.llm import common, decontaminate, langid, mixing


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).cache()
    assert out.columns == [*docs.columns, "size", "shard", "slot"]
    ids = {r.doc_id for r in out.collect()}
    near = classes(docs)
    accepted = {r.doc_id for r in langid.accepted(docs).collect()}
    dirty = {r.doc_id for r in decontaminate.contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("n_hit > 0").collect()}
    assert not ids & dirty and ids <= accepted and len({near[i] for i in ids}) == len(ids)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(text[r.doc_id] == r.text for r in out.collect())
    slots = out.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("each")).collect()
    assert all(r.low == 0 and r.high == r.n - 1 == r.each - 1 for r in slots)


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "contamination", "mixture", "shards"]


def classes(docs):
    """doc_id to the class of its text: equal sets of five-word shingles, or at 0.8, by comparing all."""
    rows = [(r.doc_id, slow_set(r.text)) for r in docs.collect()]
    posted = {}
    label = list(range(len(rows)))
    for i, (_, own) in enumerate(rows):
        shared = Counter(j for x in own for j in posted.get(x, ()))
        for j in [j for j, n in shared.items() if 5 * n >= 4 * (len(own) + len(rows[j][1]) - n)]:
            label = [label[j] if x == label[i] else x for x in label] if label[i] != label[j] else label
        for x in own:
            posted.setdefault(x, []).append(i)
    return {d: x for (d, _), x in zip(rows, label, strict=True)}


def odd_rows():
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "and", "of", "a", "house", "river", "winter", "light", "stone", "bread", "night", "garden", "paper", "morning", "window"])
    rows = [(i, " ".join(word() for _ in range(rng.randint(30, 60))), "en", f"s{i % 3}", i) for i in range(60)]
    copy = lambda t: " ".join([*t.split()[:-1], "changed"])
    rows += [(100 + i, copy(rows[i][1]), "en", None, None) for i in range(10)]  # near copies
    rows += [(None, rows[i][1], "en", "s0", 1) for i in range(5)]  # copies without id
    rows += [(None, " ".join(word() for _ in range(40)), None, "s1", 2) for _ in range(20)]  # different texts without id
    rows += [(7, " ".join(word() for _ in range(40)), "en", "s2", 3) for _ in range(6)]  # different texts of one id
    rows += [rows[3]] * 4 + [(200, None, "en", "s0", 0), (201, "", None, None, 0), (202, "日本語の文章です", None, "s1", 8)]
    bench = [(1, " ".join(rows[20][1].split()[3:20])), (2, " ".join(rows[77][1].split()[5:16])), (3, None)]
    return rows, bench


@pytest.mark.parametrize("parts", [1, 5])
def test_stages_by_brute_force(spark, tmp_path, parts):
    """Row for row, over nulls, repeated rows and ids, and rows without id."""
    rows, bench = odd_rows()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs, stages = spark.createDataFrame(rows, schema).repartition(parts), dict(corpus_pipeline.STAGES)
    same = lambda df, want: sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
    after = lambda name, df: common.written(stages[name](spark, df, f"file://{tmp_path}"), name)

    model = langid.fit(docs.where(F.coalesce(~langid.held_out(), F.lit(True))))
    left = [r for r in rows if not model.predict(r[1].encode() if r[1] is not None else None)[2]]
    docs = after("language", docs)
    assert same(docs, left) and not {200, 201, 202} & {r[0] for r in left} and len(left) >= 95

    order = sorted(range(len(left)), key=lambda i: (left[i][0] is None, left[i][0] or 0))
    docs = after("near_duplicates", docs)
    got, label = [tuple(r) for r in docs.collect()], list(range(len(left)))
    sets = [slow_set(r[1]) for r in left]
    for i in range(len(left)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    first = {}
    for i in order:
        first.setdefault(label[i], left[i][0])
    assert len(got) == len(first) and sorted(map(str, (r[0] for r in got))) == sorted(map(str, first.values()))
    assert {r[1] for r in got} <= {r[1] for r in left} and len({label[left.index(r)] for r in got}) == len(first)

    clean = [r for r in got if decontaminate.brute_force([r[:2]], bench)[r[0]][1] == 0]
    docs = after("contamination", docs)
    assert same(docs, clean) and len(clean) < len(got)

    mixed = after("mixture", docs)
    copies = Counter(map(tuple, mixed.collect()))
    size = {s: sum(len(r[1].split()) for r in clean if r[3] == s) for s in {r[3] for r in clean}}
    target = slow_targets(size)
    assert set(copies) <= set(clean) and max(copies.values()) <= 2
    for source in size:
        taken = sum(n * len(r[1].split()) for r, n in copies.items() if r[3] == source)
        assert abs(taken - target[source]) <= 2 * max(len(r[1].split()) for r in clean if r[3] == source)

    out = after("shards", mixed)
    assert same(out.select(*mixed.columns), copies.elements())
    shard = {}
    for r in out.collect():
        assert shard.setdefault(r.text, r.shard) == r.shard and r["size"] == len(r.text.encode()) + 8
    slots = out.groupBy("shard").agg(F.collect_list("slot").alias("slots")).collect()
    assert all(sorted(r.slots) == list(range(len(r.slots))) for r in slots)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "", "en", None, 0), (2, "Some words here", "en", "a", 3)]])
def test_stages_on_odd_tables(spark, sf, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf), "odd")
    assert docs.count() <= 2 * len(rows)


def test_brute_force_mixture_of_a_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sized = docs.select("doc_id", "source", mixing.word_count().alias("size"))
    copies = {r.doc_id: r.copies for r in mixing.mix(sized).collect()}
    got = {r.doc_id: r["count"] for r in mixing.mixed_documents(docs).groupBy("doc_id").count().collect()}
    assert got == {d: n for d, n in copies.items() if n}
