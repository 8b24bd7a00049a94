import random

import pytest

from marlstone.llm import near_copies
from marlstone.llm.common import space_words


def slow_set(text):
    words = space_words((text or "").encode())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def slow_kept(rows):
    """The smallest doc_id of each component over pairs of at least 0.8."""
    sets, label = [slow_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return sorted(min(d for (d, _), x in zip(rows, label, strict=True) if x == a) for a in set(label))


@pytest.mark.parametrize("bounds", [{}, {"tree_rows": 4, "cell_shingles": 600}])
def test_finds_every_pair_of_similarity(spark, table, bounds):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(40):
        text = rng.choices(words, k=rng.choice((60, 200, 400)))
        for _ in range(4):
            copy = list(text)
            for _ in range(rng.randint(0, len(text) // 25)):  # similarities around 0.8
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "a c"), (905, "z " * 9000), (906, "z " * 20)]
    got = sorted(r.doc_id for r in near_copies.representatives(table(rows), **bounds).collect())
    assert got == slow_kept(rows) and len(got) < len(rows) - 40


@pytest.mark.parametrize("parts", [1, 2, 3, 7])
def test_rows_of_one_id_are_told_apart(spark, table, parts):
    a, b, c, d = "one two three four five six", "other words that have nothing in common", "some text of its own here", "and still another one of these"
    rows = [(None, a), (None, b), (7, c), (7, d), (7, c), (8, a), (3, a), (5, a), (5, b), (None, None), (None, "")]
    out = [(r.doc_id, r.text or "") for r in near_copies.representatives(table(rows).repartition(parts)).collect()]
    assert sorted(out, key=str) == sorted([(3, a), (5, b), (7, c), (7, d), (None, "")], key=str)


def test_empty_and_clashing(spark, table):
    assert near_copies.representatives(table([])).count() == 0
    docs = spark.createDataFrame([(1, "a b c d", 5, 6, 7), (2, "a b c d", 8, 9, 1)], "doc_id long, text string, fp int, row int, set int")
    assert [tuple(r) for r in near_copies.representatives(docs).collect()] == [(1, "a b c d", 5, 6, 7)]


def test_large_group_of_near_copies(spark, table):
    rng = random.Random(1)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = []
    for i in range(1500):
        copy = list(base)
        copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"  # a similarity of 0.87
        rows.append((i, " ".join(copy)))
    rows += [(5000 + i, " ".join(f"w{rng.randrange(3000)}" for _ in range(80))) for i in range(200)]
    got = sorted(r.doc_id for r in near_copies.representatives(table(rows), tree_rows=100, cell_shingles=1 << 15).collect())
    assert got == [0, *range(5000, 5200)]
