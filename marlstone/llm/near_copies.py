"""SimHash near-duplicates at a Jaccard similarity: documents whose sets of five-word shingles have one of 0.8 or more.

Documents with equal sets are one class with one fingerprint, the SimHash of the set. Two sets of that similarity differ in
10 of 64 bits in the mean, too many for keys of whole bit blocks, so the shards of the BK-trees have other keys: ``BANDS`` of
``ROWS`` min-hashes of the set each. A pair at 0.8 shares no key with a probability of (1 - 0.8 ** 4) ** 20, below 3e-5, and
is farther apart than ``RADIUS`` bits with one of about 1e-4. The trees give loose components, within which every pair's
similarity is computed exactly from the whole sets; a loose component above ``CELL_SHINGLES`` is cut into blocks that meet
pairwise, so it never stands in one task, and each cell returns a star for each exact component. The result is the components
over the exact links. A shard or component of a great many distinct sets costs the square of their number.

Words are as in ``simhash``; a text of one to four words is one shingle. Null texts and those without words have the empty set
and are copies of each other. Rows are told apart by doc_id and text: of a component the row with the smallest doc_id stays,
nulls last, and rows that share both are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import broadcast_keys, free_name, lean, scratch_tables, space_words, text_bytes, written
from marlstone.llm.ngram_shards import mix
from marlstone.llm.simhash import TREE_ROWS, celled, changes, majority, runs, star_components, star_links

SEED, WIDTH, BANDS, ROWS, RADIUS, CELL_SHINGLES = 42, 5, 20, 4, 22, 1 << 18
PARTS = 5  # a similarity of 4 / 5
_random = np.random.default_rng(SEED)
FLIPS, FACTORS = (_random.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) for _ in range(2))
FACTORS |= np.uint64(1)


def shingles(data: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = space_words(data)
    if len(words) < WIDTH:
        words = [b" ".join(words)] if words else []
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    if len(h) < WIDTH:
        return h
    made = h[: len(h) - WIDTH + 1]
    for i in range(1, WIDTH):
        made = mix(made, h[i : len(h) - WIDTH + 1 + i])
    return np.unique(made)


def bands(found: np.ndarray) -> np.ndarray:
    """The keys of a set; none for the empty one."""
    if not len(found):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 1024):
        least = np.minimum(least, ((found[at : at + 1024] ^ FLIPS) * FACTORS).min(axis=1))
    least = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key, least[:, i])
    return key


def row_of(docs: DataFrame):
    """A hash of doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.col("text"))


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, row, set (a hash of the shingles), n (their number), fp (the set's fingerprint) and keys of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, keys, n = np.empty((2, b.num_rows), np.uint64), [], np.empty(b.num_rows, np.int64)
            for i, text in enumerate(b.column(2)):
                found = shingles(text.as_py())
                made[:, i], n[i] = (xxhash.xxh64_intdigest(found.tobytes(), SEED), majority(found)), len(found)
                keys.append(bands(found).view(np.int64))
            sets, fps = made.view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets), pa.array(n), pa.array(fps), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "row", "set", "n", "fp", "keys"])

    plain = docs.select(F.col("doc_id").cast("long"), row_of(docs).alias("row"), text_bytes())
    return plain.mapInArrow(lean(rows), "doc_id long, row long, set long, n long, fp long, keys array<long>")


def exact_stars(ids: np.ndarray, sizes: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids of sets, their sizes, and their hashes one after the other. Returns the sets that are linked, and the first set of
    each one's component; every pair that shares a hash is compared."""
    owner = np.repeat(np.arange(len(ids)), sizes)
    code = np.unique(found, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    posted, bounds = owner[order], np.searchsorted(code[order], np.arange(len(found) + 1))
    label, ends = np.arange(len(ids)), np.cumsum(sizes)
    for x in range(len(ids)):
        own = code[ends[x] - sizes[x] : ends[x]]
        n = bounds[own + 1] - bounds[own]
        shared = np.bincount(posted[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[own], n)], minlength=len(ids))
        near = np.unique(label[PARTS * shared >= (PARTS - 1) * (sizes + sizes[x] - shared)])
        if len(near) > 1:
            label[np.isin(label, near)] = near[0]
    linked = np.flatnonzero(label != np.arange(len(ids)))
    return ids[linked], ids[label[linked]]


def links(docs: DataFrame, classes: DataFrame, tree_rows: int = TREE_ROWS, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """classes: set, row, n, fp and keys. Returns u and v, links of sets whose components are those of all pairs of at
    least 0.8."""
    keyed = classes.select(F.explode("keys").alias("key"), F.col("set").alias("id"), "fp")
    loose = star_components(star_links(keyed, classes.count() * BANDS, RADIUS, tree_rows), "loose")
    loose = written(loose.select(F.col("v").alias("set"), "root").union(loose.select("root", "root")).distinct().join(classes.select("set", "row", "n"), "set"), "members")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                few = b.slice(at, 256)
                made = [shingles(text.as_py()).view(np.int64) for text in few.column(1)]
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(made, pa.list_(pa.int64()))], ["row", "all"])

    texts = docs.select(row_of(docs).alias("row"), text_bytes().alias("data")).join(broadcast_keys(loose.select("row")), "row", "left_semi")
    sets = texts.mapInArrow(lean(rows), "row long, all array<long>").dropDuplicates(["row"])
    weight = loose.groupBy("root").agg(F.ceil(F.sum(F.col("n") + 64) / cell_shingles).cast("int").alias("cut"))
    placed = celled(loose.join(weight, "root"), F.col("cut"), "set").select("root", F.col("cell").cast("long"), "set", "row")
    cells = placed.join(written(sets, "sets"), "row").select("root", "cell", "set", "all").repartition("root", "cell").sortWithinPartitions("root", "cell", "set")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 2):
            root, cell, ids = (table.column(i).to_numpy() for i in range(3))
            all_ = table.column(3).combine_chunks()
            sizes, found = np.diff(all_.offsets.to_numpy()), all_.flatten().to_numpy()
            at, cuts = np.r_[0, np.cumsum(sizes)], [*np.flatnonzero(changes(root, cell)).tolist(), len(ids)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                u, v = exact_stars(ids[a:b], sizes[a:b], found[at[a] : at[b]])
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return cells.mapInArrow(lean(compared), "u long, v long")


def representatives(docs: DataFrame, tree_rows: int = TREE_ROWS, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """The rows of docs with one document of each component, all columns as they are."""
    name = free_name(docs)
    with scratch_tables(docs.sparkSession):
        marked = written(marks(docs), "marks")
        classes = written(marked.groupBy("set").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "classes")
        found = star_components(links(docs, classes, tree_rows, cell_shingles)).withColumnRenamed("v", "set")
        rooted = marked.select("doc_id", "row", "set").join(found, "set", "left").withColumn("root", F.coalesce("root", "set"))
        first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
        kept = written(first.select(F.col("first.row").alias(name)), "kept", keep=True)
    return docs.withColumn(name, row_of(docs)).join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
