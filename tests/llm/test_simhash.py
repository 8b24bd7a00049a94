import random
import re

import numpy as np
import pytest
import xxhash

from marlstone.llm import simhash


def slow_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(ids, fps, radius=3):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                label[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return {(d, f): least.get(find(i)) for i, (d, f) in enumerate(zip(ids, fps, strict=True))}


@pytest.mark.parametrize("text", [None, "", " \t\n", "a", "A b", "Éa b É b c\x0bd\x1ce", "one two three", "x y z " * 40])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == slow_fingerprint(text)


def test_forest_finds_every_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    points = np.unique(np.r_[[b ^ np.uint64(sum(1 << int(k) for k in rng.integers(0, 64, n))) for b in base for n in range(6) for _ in range(8)]])
    group = np.sort(rng.integers(0, 4, len(points)))
    forest = simhash.Forest(group, points)
    got = {(int(a), int(b)) for x, y in forest.within(np.arange(len(points)), 3) for a, b in zip(x, y, strict=True)}
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    want = {(i, j) for i in range(len(points)) for j in range(len(points)) if i != j and group[i] == group[j] and near[i, j]}
    assert got == want


def test_masks_meet_every_pair():
    for n in (10, 1 << 30, 1 << 40):
        keys = simhash.masks(n)
        rng = random.Random(n)
        for _ in range(300):
            flips = sum(1 << k for k in rng.sample(range(64), 3))
            assert any(flips & m == 0 for m in keys)


@pytest.mark.parametrize("tree_rows", [4096, 5])
def test_near_duplicates(spark, table, tree_rows):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, d = [], 0
    for _ in range(12):
        text = rng.choices(words, k=120)
        for _ in range(9):
            copy = list(text)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(120)] = rng.choice(words)
            rows.append((d := d + 7, " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " "), (None, "alone here now"), (3, rows[-1][1]), rows[0], (950, "z" * 100_000)]
    out = simhash.near_duplicates(table(rows), tree_rows=tree_rows).collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    want = components([d for d, _ in rows], fps)
    assert len(out) == len(rows)
    assert {(r.doc_id, r.fp % (1 << 64)): r.component_id for r in out} == want


def test_chain_of_links(spark):
    fps = [0]
    for i in range(20):
        fps.append(fps[-1] ^ (7 << 3 * i))  # each is linked to the next only
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {r.v: r.root for r in simhash.star_components(simhash.links(df)).collect()}
    assert found == {f: min(fps) for f in fps if f != min(fps)}


def test_empty(spark, table):
    assert simhash.near_duplicates(table([])).count() == 0


def test_points_of_one_fingerprint_and_hot_keys(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), 100 * int(k) + i, int(f)) for k in range(4) for i, f in enumerate(rng.integers(0, 4, 30) * 0x0F0F0F)]
    rows += [(9, 5000 + i, f) for i, f in enumerate([0, 1, 1 << 62, (1 << 62) - 1])]
    df = spark.createDataFrame(rows, "key long, id long, fp long")
    for tree_rows in (4096, 7):
        found = {r.v: r.root for r in simhash.star_components(simhash.star_links(df, len(rows), 3, tree_rows)).collect()}
        want = {}
        for k in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == k]
            label = {r[1]: r[1] for r in own}
            for a in own:
                for b in own:
                    if bin(a[2] ^ b[2]).count("1") <= 3:
                        x, y = sorted((label[a[1]], label[b[1]]))
                        label = {i: x if r == y else r for i, r in label.items()}
            want |= {i: r for i, r in label.items() if i != r}
        assert found == want
