"""Benchmark decontamination over a positional inverted index of the training text.

The index is a table of segments in the shared folder. A segment holds some documents, their words' positions in one
line with a gap after each document, and for each term its postings: the ascending positions where it stands. Every word
of every document is indexed. A segment ends with the document that fills it: it has at most ``SEGMENT_WORDS`` words,
``SEGMENT_BYTES`` bytes of text and ``SEGMENT_DOCS`` documents besides that one, so neither empty texts nor long words make
a large one. Postings are packed as differences. Segments are made where the documents are read and probed where they
lie, so no posting is shuffled and a frequent word's postings never meet in one task. All phrases of a block are looked
up together by intersecting the offset-adjusted postings of their terms, the rarest first; a proximity match, on request,
lets each term stand up to ``slop`` words away from its place.

The benchmark is read in blocks of at most ``block_words`` words, which bounds what is broadcast: a word is a row of
``width`` numbers. With more than one block the matches of a document are merged by its place in the index.

A null or empty text has no words: such a document is never contaminated, such an item never occurs. Repeated rows are
looked up one by one, repeated items count once. Empty tables give no rows or no matches.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import alnum_pieces, alnum_words, broadcast_keys, free_name, lean, scratch_tables, text_bytes, written

WIDTH, SLOP, BLOCK_WORDS = 10, 2, 500_000
SEGMENT_WORDS, SEGMENT_BYTES, SEGMENT_DOCS = 1 << 18, 1 << 22, 1 << 12
GAP = 64  # between documents; windows reach less far
CANDIDATES = 1 << 19  # places looked up at once

INDEX = "segment string, data binary"
MATCHES = "segment string, place int, key bigint, n_words bigint, spans array<struct<begin:int,end:int>>, items array<string>, near_items array<string>"


def packed(*parts: bytes | np.ndarray) -> bytes:
    """Arrays of 32 bits go as differences, their first bytes together, then the second ones and so on."""
    raw = [p if isinstance(p, bytes) else np.diff(p.astype(np.uint32), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes() for p in parts]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(raw), *map(len, raw)], np.int64).tobytes() + b"".join(raw))


def unpacked(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = np.cumsum(np.r_[8 * (n + 1), np.frombuffer(raw, np.int64, n, 8)])
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def numbers(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32).astype(np.int64)


class Segment:
    """keys: a long of each document, None for a missing one; starts and lengths: its place in the line; terms: the words;
    postings[bounds[t]:bounds[t + 1]]: where term t stands."""

    def __init__(self, data: bytes) -> None:
        keys, missing, starts, lengths, terms, bounds, postings = unpacked(data)
        self.keys = pa.array(np.frombuffer(keys, np.int64), mask=np.frombuffer(missing, bool))
        self.starts, self.lengths, self.bounds, self.postings = map(numbers, (starts, lengths, bounds, postings))
        self.terms = terms.split(b" ") if terms else []
        self.size = int(self.starts[-1] + self.lengths[-1])

    @staticmethod
    def of(docs: list[tuple[int | None, int]], ids: np.ndarray, terms: list[bytes]) -> bytes:
        """docs: key and number of words; ids: the term of each word, documents one after the other."""
        lengths = np.fromiter((n for _, n in docs), np.int64, len(docs))
        starts = np.r_[0, np.cumsum(lengths + GAP)[:-1]]
        at = np.arange(len(ids)) + np.repeat(np.arange(len(docs)) * GAP, lengths)
        bounds = np.r_[0, np.cumsum(np.bincount(ids, minlength=len(terms)))]
        keys = np.array([k or 0 for k, _ in docs], np.int64).tobytes()
        return packed(keys, np.array([k is None for k, _ in docs]).tobytes(), starts, lengths, b" ".join(terms), bounds, at[np.argsort(ids, kind="stable")])


def build_index(docs: DataFrame, key: str = "doc_id", segment_words: int = SEGMENT_WORDS, segment_bytes: int = SEGMENT_BYTES, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """A row for each segment; documents' key (a long) and text are read once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, int]] = []
        size, ids, vocabulary = 0, array("i"), defaultdict()
        vocabulary.default_factory = vocabulary.__len__

        def ready() -> pa.RecordBatch:
            nonlocal made, size, ids, vocabulary
            data = Segment.of(held, np.frombuffer(ids, np.int32), list(vocabulary))
            made += 1
            size, ids, vocabulary = 0, array("i"), defaultdict()
            vocabulary.default_factory = vocabulary.__len__
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([f"{task}-{made}"]), pa.array([data], pa.binary())], ["segment", "data"])

        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                before, data = len(ids), text.as_py()
                for words in alnum_pieces(data):
                    ids.extend(map(vocabulary.__getitem__, words))
                held.append((k, len(ids) - before))
                size += len(data or b"")
                if len(ids) >= segment_words or size >= segment_bytes or len(held) >= segment_docs:
                    yield ready()
        if held:
            yield ready()

    return docs.select(F.col(key).cast("long"), text_bytes()).mapInArrow(lean(rows), INDEX)


class Phrases:
    """Windows of benchmark items over a vocabulary of their own: a row of numbers each, -1 after a short one's end."""

    def __init__(self, items: list[tuple[str, bytes | None]], width: int = WIDTH) -> None:
        vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        grids, owners = [np.empty((0, width), np.int32)], [np.empty(0, np.int64)]
        for name, text in items:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in alnum_words(text)], np.int32)
            if 0 < len(ids) < width:
                ids = np.r_[ids, np.full(width - len(ids), -1, np.int32)]
            if len(ids):
                grids.append(np.lib.stride_tricks.sliding_window_view(ids, width))
                owners.append(np.full(len(ids) - width + 1, place[name]))
        self.terms = list(vocabulary)
        self.grid, back = np.unique(np.concatenate(grids), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([back.ravel(), np.concatenate(owners)]), axis=1)
        self.items, self.bounds = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.grid) + 1))
        self.widths = (self.grid >= 0).sum(axis=1)

    def places(self, s: Segment, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows, where each starts, and a place inside its document, of all matches; with slop, of those in which each
        term stands at most so far from its place."""
        if not len(self.grid) or not len(s.terms):
            return
        number = {t: i for i, t in enumerate(s.terms)}
        here = np.array([*(number.get(t, -1) for t in self.terms), len(s.terms)], np.int64)  # the padding's own number is last
        many = np.r_[np.diff(s.bounds), np.iinfo(np.int64).max]
        span = s.size + 4 * GAP  # positions of one term stay apart from those of the next, whatever is added to them
        keys = np.repeat(np.arange(len(s.terms)) * span, many[:-1]) + s.postings + 2 * GAP
        for at in range(0, len(self.grid), 1 << 16):
            ids = here[self.grid[at : at + (1 << 16)]]
            window = np.flatnonzero((ids >= 0).all(axis=1))
            ids = ids[window]
            order = np.argsort(many[ids], axis=1, kind="stable")  # the rarest first
            ids = np.take_along_axis(ids, order, axis=1)
            total = np.cumsum(many[ids[:, 0]]) if len(ids) else []
            begin = 0
            while begin < len(ids):
                end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + CANDIDATES, "right")))
                n = many[ids[begin:end, 0]]
                w = np.repeat(np.arange(begin, end), n)
                inside = s.postings[np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s.bounds[ids[begin:end, 0]], n)]
                start = inside - order[w, 0]
                for r in range(1, ids.shape[1]):
                    t = ids[w, r]
                    want = t * span + start + order[w, r] + 2 * GAP
                    near = np.searchsorted(keys, want - slop)
                    hit = (t == len(s.terms)) | (keys[np.minimum(near, len(keys) - 1)] <= want + slop) & (near < len(keys))
                    w, start, inside = w[hit], start[hit], inside[hit]
                if len(w):
                    yield at + window[w], start, inside
                begin = end

    def owners(self, windows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of a document and an item of one of its windows, by document and item."""
        n = self.bounds[windows + 1] - self.bounds[windows]
        item = self.items[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.bounds[windows], n)]
        pair = np.unique(np.repeat(docs, n) * len(self.names) + item)
        return pair // len(self.names), pair % len(self.names)


def grouped(docs: np.ndarray, values: list, n: int, kind: pa.DataType) -> pa.Array:
    """The values of each of n documents; docs is ascending."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(docs, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def probe(index: DataFrame, phrases: Phrases, slop: int | None = None) -> DataFrame:
    """A row for each document: the disjoint spans of words that windows cover exactly, the items they are from and, if
    slop is given, the items of which a window occurs at least by proximity."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)
    span = pa.struct([("begin", pa.int32()), ("end", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Segment(data.as_py())
                n, found = len(s.starts), []
                for reach in (0, slop):
                    steps = np.zeros(s.size + 1, np.int32)
                    docs, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                    for window, start, inside in phrases.places(s, reach) if reach is not None else ():
                        if not reach:
                            np.add.at(steps, start, 1)
                            np.add.at(steps, start + phrases.widths[window], -1)
                        d, i = phrases.owners(window, np.searchsorted(s.starts, inside, "right") - 1)
                        docs.append(d)
                        items.append(i)
                    pair = np.unique(np.concatenate(docs) * max(1, len(phrases.names)) + np.concatenate(items))
                    found.append((pair // max(1, len(phrases.names)), [phrases.names[i] for i in (pair % max(1, len(phrases.names))).tolist()], steps))
                covered = np.diff(np.r_[0, np.cumsum(found[0][2]) > 0, 0])
                begin, end = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)
                doc = np.searchsorted(s.starts, begin, "right") - 1
                runs = pa.StructArray.from_arrays([pa.array(x - s.starts[doc], pa.int32()) for x in (begin, end)], fields=list(span))
                columns = [pa.array([name] * n), pa.array(range(n), pa.int32()), s.keys, pa.array(s.lengths)]
                columns += [pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), runs)]
                columns += [grouped(d, names, n, pa.string()) for d, names, _ in found]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "place", "key", "n_words", "spans", "items", "near_items"])

    return index.mapInArrow(lean(rows), MATCHES)


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, bytes | None]]]:
    """The items in blocks of about block_words words at most; an item is never cut, and longer ones make a block."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_bytes().alias("text"), F.xxhash64("item_id", "text").alias("h"))
    words = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(1, -(-words // (2 * block_words)))  # a word and what follows it take two bytes at least
    for k in range(many):
        yield [(r[0] or "", r[1]) for r in items.where(F.pmod("h", F.lit(many)) == k).select("item_id", "text").toLocalIterator()]


def n_covered(spans: Column) -> Column:
    """How many words the spans cover together."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(a["end"], x["begin"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["end"]).alias("end"))
    return F.aggregate(F.sort_array(spans), start, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int | None = None, block_words: int = BLOCK_WORDS, key: str = "doc_id") -> DataFrame:
    """For each document: its key (a long), n_words, n_hit (words inside an exact match), items and near_items (sorted
    arrays; near_items are empty unless slop is given)."""
    if width + (slop or 0) >= GAP:
        raise ValueError(f"width + slop must be below {GAP}")
    index = written(build_index(docs, key), "index")
    found = None
    for items in blocks(benchmark, block_words):
        part = probe(index, Phrases(items, width), slop)
        found = part if found is None else found.union(part.where("size(spans) > 0 or size(near_items) > 0"))
        more = found is not part
    if more:
        joined = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near_items")]
        found = found.groupBy("segment", "place").agg(F.first("key").alias("key"), F.first("n_words").alias("n_words"), *joined)
    once = [F.array_sort(F.array_distinct(c)).alias(c) for c in ("items", "near_items")]
    return found.select(F.col("key").alias(key), "n_words", n_covered(F.col("spans")).alias("n_hit"), *once)


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs without an exact match, all columns as they are. A row goes for its own text alone, whatever
    doc_id it has."""
    name = free_name(docs)
    with scratch_tables(docs.sparkSession):
        found = contamination(docs.select(F.xxhash64("text").alias(name), "text"), benchmark, width, key=name)
        hit = written(found.where("n_hit > 0").select(name).distinct(), "hit", keep=True)
    return docs.withColumn(name, F.xxhash64("text")).join(broadcast_keys(hit), name, "left_anti").drop(name)


def items_digest(column: str = "items"):
    """SHA-256 of the sorted item ids, comma-joined, in lower-case hex."""
    return F.sha2(F.concat_ws(",", column), 256)


def brute_force(docs: list[tuple], benchmark: list[tuple], width: int = WIDTH) -> dict:
    """What contamination() returns for exact matches, by scanning; for tests."""
    windows: dict[tuple, set[str]] = {}
    for item, text in benchmark:
        w = alnum_words(text.encode() if text else None)
        for i in range(max(len(w) - width, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    sizes, out = {len(w) for w in windows}, {}
    for doc_id, text in docs:
        w, covered, items = alnum_words(text.encode() if text else None), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if found := windows.get(tuple(w[i : i + size])):
                    covered.update(range(i, i + size))
                    items |= found
        out[doc_id] = (len(w), len(covered), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
    return out


#: The columns of the digest query in DuckDB, for tables documents and benchmark.
SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(words[i:i + 9], ' ') AS phrase, least(len(words), 10) AS n
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM items WHERE len(words) > 0)),
places AS (
  SELECT r, i, n, array_to_string(words[i:i + n - 1], ' ') AS phrase
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows))),
matches AS (SELECT r, i, n, item_id FROM places JOIN windows USING (phrase, n)),
hits AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM matches) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS line FROM (SELECT DISTINCT r, item_id FROM matches) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(line, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN found USING (r)
"""
