import hashlib
import math
import os
import random
import time
from collections import Counter

import pytest

from marlstone.llm import kneser_ney as kn
from marlstone.llm import ngram_shards
from marlstone.scratch import scratch_root


def slow_model(texts):
    """Interpolated modified Kneser-Ney as it is defined, over dictionaries."""
    lines = [["<s>", "<s>", *t.lower().split(), "</s>"] for t in texts]
    three = Counter(tuple(x[i - 2 : i + 1]) for x in lines for i in range(2, len(x)))
    two = Counter((b, c) for _, b, c in three)
    one = Counter(c for _, c in two)
    known = {w for x in lines for w in x}

    def cuts(counts):
        n = Counter(counts.values())
        if not n[1] or not n[2]:
            return [0, 0.5, 0.75, 0.9]
        y = n[1] / (n[1] + 2 * n[2])
        return [0] + [min(max(i - (i + 1) * y * n[i + 1] / max(n[i], 1), 0.05), i - 0.05) for i in (1, 2, 3)]

    d3, d2, d1 = cuts(three), cuts(two), cuts(one)

    def p1(c):
        total = sum(one.values())
        left = sum(d1[min(n, 3)] for n in one.values()) / total
        return (one[c] - d1[min(one[c], 3)]) / total + left / len((known | {"<other>"}) - {"<s>"})

    def step(counts, d, context, c, low):
        own = {k: n for k, n in counts.items() if k[:-1] == context}
        total = sum(own.values())
        if not total:
            return low
        n = own.get((*context, c), 0)
        return (n - d[min(n, 3)]) / total + sum(d[min(n, 3)] for n in own.values()) / total * low

    def perplexity(text, each=False):
        words = ["<s>", "<s>", *(w if w in known else "<other>" for w in text.lower().split()), "</s>"]
        logs = [math.log(step(three, d3, (a, b), c, step(two, d2, (b,), c, p1(c)))) for a, b, c in zip(words, words[1:], words[2:], strict=False)]
        return logs if each else math.exp(-sum(logs) / len(logs))

    return perplexity


def docs_of():
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(4000)]
    return [(i, " ".join(rng.choices(words, k=rng.randint(1, 40))), "en" if i % 3 else "de") for i in range(60)]


def test_definition_sums_to_one():
    """Of the definition that the operator is held against: after any context, the words' probabilities."""
    texts = [t for _, t, _ in docs_of()[:30]]
    slow = slow_model(texts)
    known = sorted({w for t in texts for w in t.split()})
    for context in ("", "w1 w2", "w3 nothing"):
        before = slow(context, True)[:-1]
        total = sum(math.exp(slow(f"{context} {w}", True)[len(before)]) for w in [*known, "<other>"]) + math.exp(slow(context, True)[-1])
        assert total == pytest.approx(1, abs=1e-9)


def test_thresholds_by_brute_force(spark, table):
    """A language's threshold is the quantile of its trusted documents' own perplexities, in order."""
    docs = docs_of()
    rows = [*docs, (200, "w1 w2", "xx"), (201, "w1 w2 w3", None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    own = {r.doc_id: (r.lang, r.own) for r in ngram_shards.perplexities(table(rows), labels.select("doc_id")).collect() if r.own is not None and r.n_words}
    for quantile in (0.5, 0.9, 0.995):
        rank = lambda values, q=quantile: sorted(values)[max(0, math.ceil(q * len(values)) - 1)]
        want = {lang: rank([p for x, p in own.values() if x == lang]) for lang in ("en", "de")}
        every = rank([p for _, p in own.values()])
        for r in kn.classify(table(rows), labels, quantile).collect():
            assert r.threshold == pytest.approx(want.get(r.lang, every)) and r.kept == (r.n_words > 0 and r.perplexity <= r.threshold)


def test_classify(spark, table):
    good = [(i, " ".join(f"w{(i * k) % 9}" for k in range(1, 30)), "en") for i in range(80)]
    rows = [*good, (200, " ".join(f"z{k}" for k in range(30)), "en"), (201, None, "en"), (202, "", None), (203, good[0][1], None), (203, good[0][1], None), (204, "q " * 30_000, "xx")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)] + [(200, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = kn.classify(table(rows), labels).collect()
    assert len(out) == len(rows)
    kept = [r.doc_id for r in out if r.kept]
    assert set(range(80)) <= set(kept) and kept.count(203) == 2 and not {200, 201, 202, 204} & set(kept)


def test_empty_tables(spark, table):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert kn.classify(table([]), none).count() == 0
    assert {r.doc_id: r.kept for r in kn.classify(table([(1, "a b"), (2, None)]), none).collect()} == {1: True, 2: False}


def test_counts_cover_all_trusted_documents(spark, table):
    """Over many chunks and shards, as the definition has it over every trusted document."""
    docs = docs_of()
    rows = [*docs, (100, "unseen words here", "en"), (101, "", "fr"), (102, None, None), docs[3], (103, "W1 w2", None)]
    trusted = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    slow = slow_model([t for d, t, _ in rows if d < 50])
    text = {d: t for d, t, _ in rows}
    out = ngram_shards.perplexities(table(rows), trusted, shard_bytes=1000).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    for r in out:
        assert r.perplexity == pytest.approx(slow(text[r.doc_id] or ""), rel=1e-4)
        assert (r.own is not None) == (r.doc_id < 50) and (r.own is None or r.own > r.perplexity)


def test_own_counts_are_left_out(spark, table, monkeypatch):
    """own is what the counts of the other documents give, with the discounts and the number of words of all."""
    docs, told, seen = docs_of(), {}, []
    real, cuts = ngram_shards.settings, ngram_shards.discounts
    ids = lambda some: spark.createDataFrame([(i,) for i in some], "doc_id long")
    monkeypatch.setattr(ngram_shards, "discounts", lambda n: seen.append(cuts(n)) or seen[-1])
    monkeypatch.setattr(ngram_shards, "settings", lambda made: told.update(real(made)) or dict(told))
    own = {r.doc_id: r.own for r in ngram_shards.perplexities(table(docs), ids(range(12))).collect()}
    all_cuts, size = list(seen), told["size"]
    for i in (0, 5, 11):
        again = iter(all_cuts)
        monkeypatch.setattr(ngram_shards, "discounts", lambda n, again=again: next(again))
        monkeypatch.setattr(ngram_shards, "settings", lambda made: {**real(made), "size": size})
        found = {r.doc_id: r.perplexity for r in ngram_shards.perplexities(table(docs), ids(j for j in range(12) if j != i)).collect()}
        assert own[i] == pytest.approx(found[i], rel=1e-6)


def test_a_long_trusted_text_ends_nothing(spark, table):
    """A text of over a million words that comes first in the order of hashes leaves all other texts in the counts."""
    first = min(range(1, 30), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    rows = [(i, f"a b c{i} d e f" if i != first else "very " * 1_000_001, "en") for i in range(1, 30)]
    rows.append((40, " ".join(f"z{i}" for i in range(9)), "en"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 30)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in kn.classify(table(rows), labels).collect()}
    assert all(r.perplexity is not None and r.threshold is not None for r in out.values())
    assert all(out[i].kept and out[i].perplexity < out[40].perplexity / 2 for i in range(1, 30))


def test_disk_is_freed_as_it_goes(spark, table, monkeypatch):
    """What a step shuffles is gone when its table is written, and of the tables only the result stays."""
    local = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffles = lambda: {f for top in local for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    tables = lambda: set(os.listdir(scratch_root(spark).removeprefix("file://")))
    docs, before, held, real = table(docs_of()), shuffles(), tables(), ngram_shards.written
    steps = []

    def left(df, name, *more, **kept):
        out = real(df, name, *more, **kept)
        until = time.time() + 10  # they are deleted in the background
        while shuffles() - before and time.time() < until:
            time.sleep(0.05)
        steps.append((name, len(shuffles() - before)))
        return out

    monkeypatch.setattr(ngram_shards, "written", left)
    out = ngram_shards.perplexities(docs, spark.createDataFrame([(i,) for i in range(50)], "doc_id long"), shard_bytes=3000)
    assert out.count() == len(docs_of())
    assert len(steps) > 5 and not any(n for _, n in steps), steps
    assert all(x.startswith("perplexity") for x in tables() - held)


def test_many_trusted_documents(spark, table, monkeypatch):
    """Too many to broadcast: texts are shuffled a part at a time, and the result is the same, row for row."""
    rows = [*docs_of(), (None, "w1 w2", "en"), (3, "w1 w3", None), (102, None, None)]
    trusted = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    found = lambda: sorted((r.doc_id or -1, r.lang or "", r.n_words, round(r.perplexity, 9), round(r.own or 0, 9)) for r in ngram_shards.perplexities(table(rows), trusted).collect())
    few = found()
    monkeypatch.setattr(ngram_shards, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ngram_shards, "ROUNDS", 3)
    assert found() == few and len(few) == len(rows)
