"""Kneser-Ney counts of all trusted text in hash shards, and the perplexity of every document by them.

Words and pairs are 64-bit hashes. Documents are read in chunks of about ``CHUNK`` bytes, which are written as numbers of
words. The work goes in at most ``ROUNDS`` rounds, one for each range of hashes of the middle word of a triple, and what a
round shuffles is deleted when it ends, so the disk never holds more than a round's share of the questions. In a round a
chunk sends its distinct triples to the shards of their first pairs, and its distinct last pairs, with the words that
trusted text has before them, to the shards of those. A shard adds up what is trusted and answers every chunk in the order of
its question, so no table of the n-grams is kept. The words' own counts are asked for when all rounds are over, in ``TURNS``
parts of them. Then chunks meet their answers, again a part at a time. The number of shards grows with the text, so that a shard fits a task; the
driver gets nothing but counts of counts.

A trusted document is in the counts it is scored by, so it has a second perplexity, ``own``: the same with its own
occurrences taken out of all counts (the discounts and the number of words stay), which is what the thresholds need.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import BROADCAST_ROWS, freed_shuffles, lean, scratch_tables, space_words, text_bytes, trim, written

CHUNK, SHARD = 8 << 20, 8 << 20  # bytes of text
ROUNDS, TURNS, PARTS = 16, 4, 8  # of n-grams, of words, of chunks
START, END = 0, 1
SCORED = "doc_id long, lang string, n_words long, perplexity double, own double"
FOUND = "kind string, chunk long, shard int, data binary, n long"


def pack(*arrays: Any) -> bytes:
    """Arrays of 32 bits go as the first bytes of all numbers, the second ones and so on, of which the upper are mostly zero."""
    plain = [(x.shape, x.ravel().view(np.uint8).reshape(-1, 4).T.tobytes()) if isinstance(x, np.ndarray) and x.dtype == np.int32 else x for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(plain, 5))


def unpack(data: bytes) -> Any:
    plain = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    whole = lambda shape, raw: np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.int32).reshape(shape)
    return [whole(*x) if isinstance(x, tuple) else x for x in plain]


def packed_keys(keys: np.ndarray) -> bytes:
    """Keys, of which most are in order: the first bytes of all differences, the second ones and so on, of which the upper are
    mostly zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of the ordered pair x, y."""
    z = x * np.uint64(0x9E3779B97F4A7C15) + (y ^ y >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def round_of(hashes: np.ndarray, rounds: int) -> np.ndarray:
    return ((hashes & np.uint64(0xFFFFFFFF)) * np.uint64(rounds) >> np.uint64(32)).astype(np.int64)


def predicted(hashes: np.ndarray, line: np.ndarray, lengths: np.ndarray, rounds: int, k: int) -> np.ndarray:
    """The places of the words to predict that follow a word of round k."""
    here = np.zeros(len(line), bool)
    here[1:] = (round_of(hashes, rounds) == k)[line[:-1]]
    first = np.cumsum(lengths) - lengths
    here[first] = here[first + 1] = False
    return np.flatnonzero(here)


def pairs_of(hashes: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of pairs of words, sorted, and the number of each place's."""
    return np.unique(mix(hashes[x], hashes[y]), return_inverse=True)


def joint(pair: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Numbers of pairs and words in one number, in the order of the pairs."""
    return pair.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)


def parted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x >> np.uint64(32)).astype(np.int64), (x & np.uint64(0xFFFFFFFF)).astype(np.int64)


def by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """The slices of sorted keys that belong to each shard."""
    cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
    for i in range(shards):
        if cuts[i] < cuts[i + 1]:
            yield i, slice(int(cuts[i]), int(cuts[i + 1]))


class Numbers(dict):
    """Numbers words as they come, after START and END."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 2
        return n


def chunks(docs: DataFrame, part: int = 0) -> DataFrame:
    """docs: doc_id, lang, bytes of text, trusted. Returns a row for each chunk: its documents, their texts as numbers of words
    (the more frequent, the smaller), the bytes of text and the number of trusted texts."""

    def made(chunk: int, rows: list[tuple], size: int) -> pa.RecordBatch:
        vocabulary = Numbers()
        flat: list[int] = []
        lengths = []
        for r in rows:
            before = len(flat)
            flat += (START, START)
            flat.extend(map(vocabulary.__getitem__, space_words(r[2])))
            flat.append(END)
            lengths.append(len(flat) - before)
        hashes = np.array([11, 13, *(xxhash.xxh64_intdigest(w, 42) for w in vocabulary)], np.uint64)
        line = np.array(flat, np.int32)
        order = np.lexsort((hashes, -np.bincount(line, minlength=len(hashes))))  # words that are as frequent: by hash, for packed_keys
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        trusted = np.array([bool(r[3]) and r[2] is not None for r in rows])
        columns = [chunk], [pack([r[0] for r in rows], [r[1] for r in rows])], [pack(packed_keys(hashes[order]), rank[line], np.array(lengths, np.int32), trusted)], [size], [int(trusted.sum())]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["chunk", "rows", "data", "size", "taught"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = (part << 24 | TaskContext.get().partitionId()) << 32, [], 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(r)
                size += len(r[2] or b"") + 1
                if size >= CHUNK:
                    yield made(chunk, held, size)
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield made(chunk, held, size)

    return docs.mapInArrow(lean(rows), "chunk long, rows binary, data binary, size long, taught long")


def chunk_words(data: bytes) -> tuple[np.ndarray, ...]:
    """The hashes of a chunk's words, their numbers as they stand, the lengths of the texts and which are trusted."""
    hashes, *rest = unpack(data)
    return unpacked_keys(hashes), *rest


def sent(cut: DataFrame, shards: int, rounds: int, k: int) -> DataFrame:
    """What chunks send in round k, by cell: 2 * shard for the first pairs of triples and the words after them, with how often
    trusted text has them, and 2 * shard + 1 for the last pairs and the words before them in trusted text. Words are numbers
    in the message's own list of hashes."""

    def firsts(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, trusted: np.ndarray) -> Iterator[tuple]:
        keys, of = pairs_of(hashes, a, b)
        triples, back = np.unique(joint(of, c), return_inverse=True)
        n = np.bincount(back, trusted).astype(np.int32)
        pair, word = parted(triples)
        many = np.bincount(pair, minlength=len(keys))
        ends = np.r_[0, np.cumsum(many)]
        for s, p in by_shard(keys, shards):
            own = slice(int(ends[p.start]), int(ends[p.stop]))
            words, after = np.unique(word[own], return_inverse=True)
            yield 2 * s, pack(packed_keys(keys[p]), hashes[words], many[p].astype(np.int32), after.astype(np.int32), n[own])

    def lasts(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, trusted: np.ndarray) -> Iterator[tuple]:
        keys, of = pairs_of(hashes, b, c)
        at = np.flatnonzero(trusted)
        triples, one = np.unique(joint(of[at], a[at]), return_index=True)
        one = at[one]
        many = np.bincount(parted(triples)[0], minlength=len(keys))
        ends = np.r_[0, np.cumsum(many)]
        for s, p in by_shard(keys, shards):
            own = one[ends[p.start] : ends[p.stop]]
            pair = one[ends[:-1][p][many[p] > 0]]
            words, numbers = np.unique(np.concatenate([a[own], b[pair], c[pair]]), return_inverse=True)
            before, middle, last = np.split(numbers.astype(np.int32), [len(own), len(own) + len(pair)])
            yield 2 * s + 1, pack(packed_keys(keys[p]), hashes[words], many[p].astype(np.int32), before, middle, last)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes, line, lengths, trusted = chunk_words(data)
                at = predicted(hashes, line, lengths, rounds, k)
                if not len(at):
                    continue
                told = np.repeat(trusted, lengths)[at]
                for side in firsts, lasts:
                    out = list(side(hashes, line[at - 2], line[at - 1], line[at], told))
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([chunk] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())], ["cell", "chunk", "data"])

    return cut.select("chunk", "data").mapInArrow(lean(rows), "cell int, chunk long, data binary")


def context(n: np.ndarray) -> np.ndarray:
    """Fields of a context for a follower of count n: the sum, and the followers of count 1, 2 and above."""
    return np.stack([n, n == 1, n == 2, n > 2]).astype(np.int64)


def summed(group: np.ndarray, fields: np.ndarray, groups: int) -> np.ndarray:
    return np.stack([np.bincount(group, x, groups) for x in fields]).astype(np.int64)


def found_at(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key stands, and whether it does."""
    place = np.minimum(np.searchsorted(sorted_keys, wanted), max(len(sorted_keys) - 1, 0))
    return place, sorted_keys[place] == wanted if len(sorted_keys) else np.zeros(len(wanted), bool)


def answered(messages: DataFrame, word_shards: int) -> DataFrame:
    """Rows of kind ab and bc (what a chunk asked a shard: the contexts of first pairs with the counts of triples, and the
    counts of last pairs) and w (records of words, by shard of the word: count, then the context's fields). Kinds 3 and 2 give
    the number n of triples and pairs whose count is shard."""

    def rows(table: pa.Table) -> pa.Table:
        shard, last = divmod(table.column("cell")[0].as_py(), 2)
        parts = [unpack(x) for x in table.column("data").to_pylist()]
        words = np.unique(np.concatenate([p[1] for p in parts]))
        asked = [unpacked_keys(p[0]) for p in parts]
        numbers = [np.searchsorted(words, p[1]) for p in parts]  # of the message's words among all
        third = [x[p[3]] for x, p in zip(numbers, parts, strict=True)]
        n = np.concatenate([np.ones(len(p[3]), np.int32) if last else p[4] for p in parts])
        told = np.flatnonzero(n)
        pairs, of = np.unique(np.concatenate([np.repeat(k, p[2]) for k, p in zip(asked, parts, strict=True)])[told], return_inverse=True)
        triples, back = np.unique(joint(of, np.concatenate(third)[told]), return_inverse=True)
        n = np.bincount(back, n[told], len(triples)).astype(np.int64)
        pair = parted(triples)[0]
        out: list[tuple] = []
        if last:
            n = np.bincount(pair, minlength=len(pairs))
            fields = n[None]
            named = np.concatenate([k[p[2] > 0] for k, p in zip(asked, parts, strict=True)])
            one = np.unique(named, return_index=True)[1]
            middle, end = (np.concatenate([x[p[i]] for x, p in zip(numbers, parts, strict=True)])[one] for i in (4, 5))
            f = np.concatenate([np.bincount(end, minlength=len(words))[None], summed(middle, context(n), len(words))])
            seen = f.any(axis=0)
            known, f = words[seen], f[:, seen]
            out += [("w", None, s, pack(packed_keys(known[p]), f[:, p].astype(np.int32)), None) for s, p in by_shard(known, word_shards)]
        else:
            fields = summed(pair, context(n), len(pairs))
        out += [("2" if last else "3", None, i, None, int((n == i).sum())) for i in (1, 2, 3, 4)]
        for chunk, k, p, word in zip(table.column("chunk").to_pylist(), asked, parts, third, strict=True):
            place, hit = found_at(pairs, k)
            data = [np.packbits(hit), len(hit), fields[:, place[hit]].astype(np.int32)]
            if not last:
                follow = np.repeat(hit, p[2])
                at, has = found_at(triples, joint(np.repeat(place, p[2])[follow], word[follow]))
                data.append(np.where(has, n[at], 0).astype(np.int32) if len(n) else np.zeros(len(at), np.int32))
            out.append(("bc" if last else "ab", chunk, shard, pack(*data), None))
        trim()
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64()), strict=True)], ["kind", "chunk", "shard", "data", "n"])

    return messages.groupBy("cell").applyInArrow(rows, FOUND)


def added(keys: np.ndarray, fields: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their fields (one row of fields for each)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(fields[:, order], first, axis=1) if len(keys) else fields


def shard_records(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack(x) for x in table.column("data").to_pylist()]
    if not parts:
        return np.empty(0, np.uint64), np.empty((5, 0), np.int64)
    return added(np.concatenate([unpacked_keys(k) for k, _ in parts]), np.concatenate([f for _, f in parts], axis=1).astype(np.int64))


def discounts(n: dict[int, int]) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and above, from the counts of counts."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    return np.array([0, *(min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / max(n3, 1))))])


def settings(made: DataFrame) -> dict[str, Any]:
    """Discounts of the three orders, the number of words and what the unigram counts sum up to."""

    def told(table: pa.Table) -> pa.Table:
        n = shard_records(table)[1][0]
        n = n[n > 0]
        low = np.minimum(n, 5)
        trim()
        return pa.table([pa.array(range(1, 6), pa.int32()), pa.array([int((low == i).sum()) for i in range(1, 6)], pa.int64()), pa.array([int(n[low == i].sum()) for i in range(1, 6)], pa.int64())], ["i", "n", "total"])

    of: dict[str, dict[int, int]] = {k: {} for k in "32"}
    for r in made.where("kind in ('3', '2')").groupBy("kind", "shard").agg(F.sum("n").alias("n")).collect():
        of[r["kind"]][r["shard"]] = r["n"]
    words = made.where("kind = 'w'").select("shard", "data").groupBy("shard").applyInArrow(told, "i int, n long, total long")
    one = {r["i"]: (r["n"], r["total"]) for r in words.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    d1 = discounts({i: n for i, (n, _) in one.items()})
    return {
        "d3": discounts(of["3"]),
        "d2": discounts(of["2"]),
        "d1": d1,
        "size": sum(n for n, _ in one.values()) + 1,  # and the unknown word
        "total": sum(t for _, t in one.values()),
        "left": float(sum(n * d1[min(i, 3)] for i, (n, _) in one.items())),
    }


def answers(cut: DataFrame, made: DataFrame, shards: int, some: range) -> DataFrame:
    """Rows of kind w by chunk: the fields of its words in some of the shards, in the order of their hashes."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = np.unique(chunk_words(data)[0])
                out = [(s, chunk, packed_keys(words[p])) for s, p in by_shard(words, shards) if s in some]
                if not out:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["shard", "chunk", "data"])

    def found(asked: pa.Table, own: pa.Table) -> pa.Table:
        keys, fields = shard_records(own)
        data = []
        for q in asked.column("data").to_pylist():
            place, hit = found_at(keys, unpacked_keys(q))
            data.append(pack(np.packbits(hit), len(hit), fields[:, place[hit]].astype(np.int32)))
        rows = len(data)
        trim()
        return pa.table([pa.array(["w"] * rows, pa.string()), asked.column("chunk"), asked.column("shard"), pa.array(data, pa.binary()), pa.nulls(rows, pa.int64())], ["kind", "chunk", "shard", "data", "n"])

    questions = cut.select("chunk", "data").mapInArrow(lean(asked), "shard int, chunk long, data binary")
    model = made.where((F.col("kind") == "w") & F.col("shard").between(some.start, some.stop - 1)).select("shard", "data")
    return questions.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(found, FOUND)


def step(n: np.ndarray, around: np.ndarray, d: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Interpolates the order below with the counts n in the contexts."""
    total = np.maximum(around[0], 1)
    return np.where(around[0] > 0, (n - d[np.minimum(n, 3)]) / total + d[1:] @ around[1:] / total * low, low)


def logs(n3, ab, n2, b, n1, total, left, told: dict[str, Any]) -> np.ndarray:  # noqa: ANN001
    one = np.where(total > 0, (n1 - told["d1"][np.minimum(n1, 3)] + left / told["size"]) / np.maximum(total, 1), 1 / told["size"])
    return np.log(step(n3, ab, told["d3"], step(n2, b, told["d2"], one)))


def without_own(doc: np.ndarray, places: np.ndarray, counts: tuple, told: dict[str, Any], docs: int) -> tuple:
    """counts (n3, ab, n2, b, n1) of each place, less what the place's own document adds to them, then the unigrams' sum
    and what they leave. places: numbers of the triple, first pair, last pair, middle and last word."""
    n3, ab, n2, b, n1 = counts
    width = int(places.max()) + 1 if places.size else 1

    def groups(which: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.unique(doc[rows] * width + places[which][rows], return_index=True, return_inverse=True)[1:] + (rows,)

    def spread(which: int, rows: np.ndarray, add: np.ndarray) -> np.ndarray:
        """For every place, the sum of add over the rows with the same document and number."""
        _, back = np.unique(doc * width + places[which], return_inverse=True)
        return np.stack([np.bincount(back[rows], x, back.max() + 1)[back] for x in add]).astype(np.int64)

    every = np.arange(len(doc))
    first, back, _ = groups(0, every)
    own = np.bincount(back)
    less = n3[first] - own
    ab = ab + spread(1, first, context(less) - context(n3[first]))
    gone = first[less == 0]
    two = n2 - spread(2, gone, np.ones((1, len(gone))))[0]
    pair, _, _ = groups(2, every)
    b = b + spread(3, pair, context(two[pair]) - context(n2[pair]))
    lost = pair[(two[pair] == 0) & (n2[pair] > 0)]
    one = n1 - spread(4, lost, np.ones((1, len(lost))))[0]
    word, _, _ = groups(4, every)
    cut = told["d1"][np.minimum(one[word], 3)] - told["d1"][np.minimum(n1[word], 3)]
    total = told["total"] - np.bincount(doc[lost], minlength=docs)
    left = told["left"] + np.bincount(doc[word], cut, docs)
    return n3 - own[back], ab, two, b, one, total[doc], left[doc]


def joined(parts: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the things asked for were found, and the fields of all, from the answers in order."""
    hit = np.concatenate([np.unpackbits(p[0], count=p[1]).astype(bool) for p in parts])
    fields = np.zeros((width, len(hit)), np.int64)
    fields[:, hit] = np.concatenate([p[2] for p in parts], axis=1)
    return hit, fields


def scored(documents: DataFrame, found: DataFrame, told: dict[str, Any], rounds: int) -> DataFrame:
    """doc_id, lang, n_words, perplexity and, for trusted documents, own of every row."""

    def rows(documents: pa.Table, found: pa.Table) -> pa.Table:
        ids, langs = unpack(documents.column("rows")[0].as_py())
        hashes, line, lengths, trusted = chunk_words(documents.column("data")[0].as_py())
        answers: dict[tuple, list] = {}
        for *what, _, data in sorted(zip(*(found.column(x).to_pylist() for x in ("kind", "round", "shard", "data")), strict=True)):
            answers.setdefault(tuple(what), []).append(unpack(data))
        word, back = np.unique(hashes, return_inverse=True)
        words = joined(answers["w", -1], 5)[1]
        assert words.shape[1] == len(word)
        words = words[:, back]
        docs, trusting = np.repeat(np.arange(len(lengths)), lengths), np.repeat(trusted, lengths)
        sums, kept, first = np.zeros(len(lengths)), [], np.zeros(3, np.int64)
        for k in range(rounds):
            at = predicted(hashes, line, lengths, rounds, k)
            if not len(at):
                continue
            a, b, c = line[at - 2], line[at - 1], line[at]
            pairs, ab = pairs_of(hashes, a, b)
            triples, abc = np.unique(joint(ab, c), return_inverse=True)
            hit, around = joined(answers["ab", k], 4)
            n3 = np.zeros(len(triples), np.int64)
            n3[hit[parted(triples)[0]]] = np.concatenate([p[3] for p in answers["ab", k]])
            lasts, bc = pairs_of(hashes, b, c)
            n2 = joined(answers["bc", k], 1)[1][0]
            assert len(hit) == len(pairs) and len(n2) == len(lasts)
            counts = n3[abc], around[:, ab], n2[bc], words[1:, b], words[0, c]
            sums += np.bincount(docs[at], logs(*counts, told["total"], told["left"], told), len(sums))
            some = np.flatnonzero(trusting[at])
            kept.append((docs[at[some]], np.stack([first[0] + abc[some], first[1] + ab[some], first[2] + bc[some], b[some], c[some]]), [x[..., some] for x in counts]))
            first += len(triples), len(pairs), len(lasts)
        n = lengths.astype(np.int64) - 2
        mean = lambda x: np.exp(-x / n)
        plain, own = mean(sums), np.full(len(n), np.nan)
        if trusted.any():
            doc, places = (np.concatenate([x[i] for x in kept], axis=-1) for i in (0, 1))
            counts = tuple(np.concatenate(x, axis=-1) for x in zip(*(x[2] for x in kept), strict=True))
            del kept
            made = without_own(doc, places, counts, told, len(n))
            own = np.where(trusted, mean(np.bincount(doc, logs(*made, told), len(n))), np.nan)
        trim()
        return pa.table([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(n - 1, pa.int64()), pa.array(plain), pa.array(own, mask=~trusted)], ["doc_id", "lang", "n_words", "perplexity", "own"])

    return documents.select("chunk", "rows", "data").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(rows, SCORED)


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def cut_up(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The written chunks of docs. Many trusted documents can't be broadcast, and the texts are shuffled a part at a time."""
    told = written(trusted, "trusted").withColumn("trusted", F.lit(True))
    few = told.count() <= BROADCAST_ROWS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_bytes().alias("text"))
    parts = []
    for i in range(1 if few else ROUNDS):
        own = lambda df, i=i: df if few else df.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == i)
        marked = own(rows).join(F.broadcast(told) if few else own(told), "doc_id", "left")
        parts.append(written(chunks(marked.select("doc_id", "lang", "text", "trusted"), i), "chunks"))
    return union(parts)


def perplexities(docs: DataFrame, trusted: DataFrame, shard_bytes: int = SHARD) -> DataFrame | None:
    """SCORED columns of every row of docs by the counts of all its trusted texts; None if there are none."""
    with scratch_tables(docs.sparkSession), freed_shuffles(docs.sparkSession):
        cut = cut_up(docs, trusted)
        size, taught = cut.agg(F.sum("size"), F.sum("taught")).first()
        if not taught:
            return None
        rounds = min(ROUNDS, 1 + size // shard_bytes)
        shards = 1 + size // (shard_bytes * rounds)
        word_shards = 2 * shards + TURNS
        cuts = [i * word_shards // TURNS for i in range(TURNS + 1)]
        made = [written(answered(sent(cut, shards, rounds, k), word_shards), "round") for k in range(rounds)]
        told = settings(union(made))
        words = [written(answers(cut, union(made), word_shards, range(*x)), "words").withColumn("round", F.lit(-1)) for x in zip(cuts, cuts[1:], strict=False)]
        found = union([t.where("kind in ('ab', 'bc')").withColumn("round", F.lit(k)) for k, t in enumerate(made)] + words)
        parts = min(rounds, PARTS)
        part = lambda df, i: df.where(F.pmod(F.xxhash64("chunk"), F.lit(parts)) == i)
        return union([written(scored(part(cut, i), part(found, i), told, rounds), "perplexity", keep=True) for i in range(parts)])
