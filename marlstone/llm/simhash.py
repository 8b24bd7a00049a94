"""SimHash near-duplicates: 64-bit fingerprints, BK-trees for the links, components over the links.

Two fingerprints that differ in at most ``radius`` bits agree in all but ``radius`` of any ``blocks`` disjoint bit
blocks, so every such pair meets under one of the C(blocks, radius) keys made of ``blocks - radius`` whole blocks. A
key's fingerprints are one shard; each shard gets a BK-tree whose children hang on edges labelled with their Hamming
distance to the parent, and a search at distance d from a node follows the edges d - radius to d + radius only. The
trees of a task stand in flat arrays, so that many shards are built and searched together. A tree travels to its
queries in the shuffle by key: as a broadcast it would have no size bound. Shards above ``tree_rows`` are cut into
blocks of which each two meet in one cell, so no tree outgrows a task, no pair is missed and none is emitted: a cell
returns a star for each of its components.

Nulls and empty texts have no words and fingerprint zero. Rows that repeat a text share its fingerprint. A null doc_id
never becomes a component's id unless all its members' are null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import lean, space_words, text_bytes, written

SEED, WIDTH, RADIUS, TREE_ROWS, HOT_KEYS = 42, 3, 3, 4096, 100_000


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; none without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(data: bytes | None, width: int = WIDTH) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    words = space_words(data)
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(words) - width + 1))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x, width) for x in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(lean(rows), "doc_id long, fp long")


def masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of the keys for n distinct fingerprints: more and longer keys as n grows, so that a key's share of
    them stays small: 16 bits up to 2**26, then 25, then 32."""
    blocks = radius + (1 if n <= 1 << 26 else 2 if n <= 1 << 34 else 3)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


class Forest:
    """BK-trees over points; the points of one group stand together and make one tree."""

    def __init__(self, group: np.ndarray, points: np.ndarray) -> None:
        self.x, keys, nodes = points, [], []
        pending, key = np.arange(len(points)), group
        while len(pending):
            first = np.r_[True, key[1:] != key[:-1]]
            node, run = pending[first], np.cumsum(first) - 1
            if keys:
                keys.append(key[first])
                nodes.append(node)
            else:
                self.root = node[run]
                keys.append(np.empty(0, np.int64))
                nodes.append(np.empty(0, np.int64))
            rest = pending[~first]
            parent = node[run[~first]]
            label = parent * 65 + np.bitwise_count(points[rest] ^ points[parent])
            order = np.argsort(label, kind="stable")
            pending, key = rest[order], label[order]
        edge, child = np.concatenate(keys), np.concatenate(nodes)
        order = np.argsort(edge)
        self.edge, self.child = edge[order], child[order]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a query and another point of its tree at a distance of at most radius, level by level."""
        q, node = queries, self.root[queries]
        while len(q):
            d = np.bitwise_count(self.x[q] ^ self.x[node]).astype(np.int64)
            hit = (d <= radius) & (node != q)
            yield q[hit], node[hit]
            low = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0))
            many = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), "right") - low
            q = np.repeat(q, many)
            node = self.child[np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(q))]


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the classes of a[i] and b[i], in place; a class's label is its smallest member."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def stars(group: np.ndarray, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The indexes of the points that are linked within their group, and of their component's first point."""
    counts = np.unique(group, return_counts=True)[1]
    shared = np.flatnonzero(np.repeat(counts, counts) > 1)
    group, points = group[shared], points[shared]
    if not len(points):
        return shared, shared
    forest, label = Forest(group, points), np.arange(len(points))
    step = max(64, 2_000_000 // int(counts.max()))
    for at in range(0, len(points), step):
        for a, b in forest.within(np.arange(at, min(at + step, len(points))), radius):
            join_labels(label, a, b)
    linked = np.flatnonzero(label != np.arange(len(points)))
    return shared[linked], shared[label[linked]]


def celled(df: DataFrame, cut: Column, by: str) -> DataFrame:
    """Adds cell: rows of a group with a cut go to blocks by a hash, and to each cell in which their block meets another."""
    block = F.pmod(F.xxhash64(by), cut).cast("int")
    others = F.filter(F.sequence(F.lit(0), cut - 1), lambda i: i != block)
    cells = F.transform(others, lambda i: F.least(i, block) * cut + F.greatest(i, block))
    return df.withColumn("cell", F.explode(F.when(cut > 1, cells).otherwise(F.array(F.lit(0)))))


def runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """The rows in tables that hold whole groups: rows that agree in the first ``width`` columns, longs, stand together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(width)], axis=1)
        new = np.flatnonzero((keys != keys[-1]).any(axis=1))  # all but the last group are complete
        if len(new):
            yield pa.Table.from_batches([*held, b.slice(0, int(new[-1]) + 1)])
            held, b = [], b.slice(int(new[-1]) + 1)
        elif held and any(held[-1].column(i)[0].as_py() != keys[0, i] for i in range(width)):
            yield pa.Table.from_batches(held)
            held = []
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first does."""
    return np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)][: len(columns[0])]


def star_links(keyed: DataFrame, keys: int, radius: int, tree_rows: int = TREE_ROWS) -> DataFrame:
    """keyed: key (long), id (long) and fp of each point, under at most ``keys`` keys in all. Returns u and v, links of
    ids whose components are those of all links within radius under a common key."""
    limit = max(tree_rows, keys // HOT_KEYS)  # at most HOT_KEYS keys have more, which bounds the broadcast
    hot = keyed.groupBy("key").count().where(F.col("count") > limit).select("key", F.ceil(F.col("count") / limit).cast("int").alias("cut"))
    cells = celled(keyed.join(F.broadcast(hot), "key", "left").withColumn("cut", F.coalesce("cut", F.lit(1))), F.col("cut"), "id")
    cells = cells.select("key", F.col("cell").cast("long"), "id", "fp").repartition("key", "cell").sortWithinPartitions("key", "cell", "fp")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 2):
            key, cell, ids, fp = (c.to_numpy() for c in table.columns)
            first = np.flatnonzero(changes(key, cell, fp))  # points of equal fingerprints are one in the tree
            group = np.cumsum(changes(key[first], cell[first])) - 1
            linked, root = stars(group, fp[first].view(np.uint64), radius)
            own = ids[first][np.cumsum(changes(key, cell, fp)) - 1]
            u, v = np.r_[ids[own != ids], ids[first[linked]]], np.r_[own[own != ids], ids[first[root]]]
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return cells.mapInArrow(lean(rows), "u long, v long")


def links(fps: DataFrame, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """fps: distinct longs in column fp. Returns u and v, links whose components are those of all links within radius."""
    n = fps.count()
    bands = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(masks(n, radius))]
    keyed = fps.select(F.explode(F.array(*bands)).alias("key"), F.col("fp").alias("id"), "fp")
    return star_links(keyed, n * len(bands), radius, tree_rows)


def star_components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """Connected components by alternating large and small stars: v and root, for every vertex but the roots. It ends when
    the links are disjoint stars: no vertex has two centres, and no centre has one."""

    def done(now: DataFrame) -> bool:
        centres = now.select(F.col("v").alias("u")).distinct()
        return now.groupBy("u").count().where("count > 1").isEmpty() and now.join(centres, "u", "left_semi").isEmpty()

    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    while not done(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), name)
    return now.select(F.col("u").alias("v"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH, tree_rows: int = TREE_ROWS) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest doc_id reachable over links, of every row of docs."""
    marked = written(fingerprints(docs, width), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    found = star_components(links(classes.select("fp"), radius, tree_rows)).withColumnRenamed("v", "fp")
    rooted = classes.join(found, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labelled = rooted.join(lowest, "root").select("fp", "component_id")
    return marked.join(labelled, "fp").select("doc_id", "fp", "component_id")
