"""Sharding by a minimax contiguous partition: law ``bytes``, sizes near equal.

Atomic groups are the documents of equal texts (of one 60-bit hash of the text), in the order of that hash. The smallest
capacity with which a greedy pass cuts the ordered group sizes into at most ``shards`` runs is found by binary search, and
the runs of that pass are the shards. So no other contiguous cut has a smaller largest shard. If one group alone sets the
capacity, because it is larger than a fair share, the runs before and after it are cut anew in the same way into the shards
that are left over, so the others stay near equal.

The driver never holds the groups. It holds sums over ranges of the hash, 2**16 at first; the binary search over them
bounds the capacity and shows through which ranges each cut can run; only those are split, by 8 more bits, until they hold
single groups. The collected rows are bounded by the number of shards and the number of ranges, not by the data.

A document's slot is its rank within its shard in the order of buckets by a hash of its row, doc_id and text, so copies of
one text or id spread over the buckets however many there are.

A null text has no bytes and checksum 0 and is a group of its own with size 8 for each row. Repeated rows go to one shard and take a slot each.
With fewer groups than shards, the last shards stay empty. Extra columns pass through. An empty table gives no rows.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import free_name, numbered, written
from marlstone.llm.mixing import hash60

SHARDS, ROW_BYTES, FIRST_BITS, MORE_BITS = 24, 8, 16, 8
BUCKET_ROWS, BUCKETS = 16_384, 65_536
TOP = 1 << 63


def size_of(column: str = "text") -> Column:
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + ROW_BYTES


def group_of(column: str = "text") -> Column:
    """The group's key, 60 bits of the text's MD5 in the upper bits; keys are ordered as signed longs. No text has the null's."""
    return F.when(F.col(column).isNull(), F.lit(1 - TOP)).otherwise(F.shiftleft(hash60(F.col(column)), 4))


def greedy(sums: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Ends of at most ``shards`` runs of at most ``capacity`` over units with these prefix sums, or None."""
    ends, done = [], 0
    for _ in range(shards):
        end = int(np.searchsorted(sums, done + capacity, "right"))
        ends.append(end)
        if end == len(sums):
            return ends
        if end == (ends[-2] if len(ends) > 1 else 0):
            return None
        done = int(sums[end - 1])
    return None


def smallest_capacity(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The least capacity that greedy() accepts, and its ends."""
    sums = np.cumsum(np.array(sizes, np.int64))
    low, high = max(max(sizes), -(-int(sums[-1]) // shards)), int(sums[-1])
    while low < high:
        middle = (low + high) // 2
        if greedy(sums, middle, shards):
            high = middle
        else:
            low = middle + 1
    return low, greedy(sums, low, shards)


def open_ranges(sizes: list[int], largest: int, capacity: int, shards: int) -> set[int]:
    """Indexes of the ranges through which a cut can run: the true capacity lies between a lower bound and ``capacity``,
    and the k-th cut between where a pass at the one, rounded down, and a pass at the other, rounded up, make it."""
    sums = np.cumsum(np.array(sizes, np.int64))
    least = max(largest, -(-int(sums[-1]) // shards))
    found: set[int] = set()
    early = late = 0
    for _ in range(shards):
        # the sums at which the k-th run can end, at the least and at the most
        a = int(np.searchsorted(sums, early + least, "right"))
        b = int(np.searchsorted(sums, late + capacity, "right"))
        found.update(range(a, min(b + 1, len(sizes))))
        early = max(early, int(sums[a - 1]) if a else 0)
        late = late + capacity
        if a >= len(sizes):
            break
    return found


def cuts(groups: DataFrame, shards: int = SHARDS) -> tuple[list[int], int]:
    """groups: key (long) and bytes of each atomic group. Returns the first key of each shard but the first, and the
    capacity."""

    def summed(df: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
        first = F.shiftleft(F.shiftright("key", 64 - bits), 64 - bits) if bits < 64 else F.col("key")
        rows = df.groupBy(first.alias("first")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max("bytes").alias("most"))
        return sorted((r[0], r[1], r[2], r[3]) for r in rows.collect())

    bits = FIRST_BITS
    units = summed(groups, bits)
    if not units:
        return [], 0
    largest = max(u[3] for u in units)
    splits = {u[0]: bits for u in units}
    while True:
        sizes = [u[1] for u in units]
        capacity, ends = smallest_capacity(sizes, shards)
        todo = [i for i in sorted(open_ranges(sizes, largest, capacity, shards)) if units[i][2] > 1 and splits[units[i][0]] < 64]
        if not todo:
            return balanced(groups, units, sizes, ends, shards) if capacity == largest else [units[e][0] for e in ends[:-1]], capacity
        level = min(splits[units[i][0]] for i in todo)
        todo = [i for i in todo if splits[units[i][0]] == level]
        starts = groups.sparkSession.createDataFrame([(units[i][0] >> (64 - level),) for i in todo], "prefix long")
        inside = groups.withColumn("prefix", F.shiftright("key", 64 - level)).join(F.broadcast(starts), "prefix", "left_semi")
        finer = summed(inside, min(64, level + MORE_BITS))
        gone = {units[i][0] for i in todo}
        for first in gone:
            del splits[first]
        splits |= {u[0]: min(64, level + MORE_BITS) for u in finer}
        units = sorted([u for u in units if u[0] not in gone] + finer)


def balanced(groups: DataFrame, units: list[tuple[int, int, int, int]], sizes: list[int], ends: list[int], shards: int) -> list[int]:
    """First keys where one group alone sets the capacity: it has a shard for itself, and the shards that are left over go
    to what is before and after it, by bytes, each of which is cut anew."""
    hot = next(i for i, u in enumerate(units) if u[1] == max(sizes) and u[2] == 1)
    run = bisect.bisect_right(ends, hot)
    sides, many = [sum(sizes[:hot]), sum(sizes[hot + 1 :])], [run, len(ends) - run - 1]
    for _ in range(shards - len(ends)):
        side = max((0, 1), key=lambda i: sides[i] / many[i] if many[i] else 0)
        many[side] += many[side] > 0
    found = cuts(groups.where(F.col("key") < units[hot][0]), many[0])[0] + [units[hot][0]] if hot else []
    if hot + 1 < len(units):
        found += [units[hot + 1][0]] + cuts(groups.where(F.col("key") >= units[hot + 1][0]), many[1])[0]
    return found


def assign_sized(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows with doc_id, size and group, a table that has been written, as it is read more than once; all columns pass
    through. Adds shard and slot."""
    groups = written(rows.groupBy(F.col("group").alias("key")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    firsts, _ = cuts(groups, shards)
    n = groups.agg(F.sum("rows")).first()[0] or 0
    buckets = max(1, min(BUCKETS, -(-n // BUCKET_ROWS)))
    shard = sum((F.when(F.col("group") >= F.lit(f), 1).otherwise(0) for f in firsts), F.lit(0)).cast("int")
    # rows of one doc_id and text are alike, so which of them has which slot is open, and the row's number spreads them
    bucket = F.pmod(F.xxhash64(F.monotonically_increasing_id(), "doc_id", "group"), F.lit(buckets)).cast("int")
    placed = rows.withColumn("__bucket", bucket).withColumn("shard", shard)
    along = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy("shard", "__bucket").agg(F.count("*").alias("many")).withColumn("before", F.coalesce(F.sum("many").over(along), F.lit(0))).drop("many")
    within = Window.partitionBy("shard", "__bucket").orderBy("group", "doc_id")
    ranked = placed.withColumn("rank", F.row_number().over(within)).join(ends, ["shard", "__bucket"])
    return ranked.withColumn("slot", F.col("before") + F.col("rank") - 1).select(*rows.columns, "shard", "slot")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with doc_id and text; all columns pass through. Adds size, shard and slot after them; a column of docs that has
    one of these names gets an underscore in front. Shards and slots are made of a table of sizes; the texts go through one
    shuffle, by row."""
    name = free_name(docs)
    rows = numbered(docs, name)
    sized = written(rows.select(F.col(name).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), size_of().alias("size"), group_of().alias("group")), "sizes", keep=True)
    added = assign_sized(sized, shards).select(F.col("row").alias(name), *(F.col(c).alias(f"{name}{c}") for c in ("size", "shard", "slot")))
    taken, kept = set(docs.columns), []
    for c in docs.columns:
        new = c
        while new in ("size", "shard", "slot") or new != c and new in taken:
            new = "_" + new
        kept.append(F.col(f"`{c}`").alias(new))
        taken.add(new)
    return rows.join(added, name).select(*kept, *(F.col(f"{name}{c}").alias(c) for c in ("size", "shard", "slot")))


def brute_force(sizes: list[int], shards: int) -> list[int]:
    """Shard of each group, by the smallest capacity found by counting up, and again beside a group that alone sets it; for
    tests."""
    for capacity in range(max(sizes), sum(sizes) + 1):
        ends, total = [0], 0
        for s in sizes:
            if total + s > capacity:
                ends.append(ends[-1])
                total = 0
            ends[-1] += 1
            total += s
        if len(ends) > shards:
            continue
        if capacity > max(sizes):
            return [bisect.bisect_right(ends, i) for i in range(len(sizes))]
        at = sizes.index(capacity)
        before, after = sizes[:at], sizes[at + 1 :]
        own = [bisect.bisect_right(ends, at), len(ends) - bisect.bisect_right(ends, at) - 1]
        for _ in range(shards - len(ends)):
            larger = sum(after) * own[0] > sum(before) * own[1] if all(own) else not own[0]
            own[larger] += own[larger] > 0
        left = brute_force(before, own[0]) if before else []
        right = brute_force(after, own[1]) if after else []
        first = max(left, default=-1) + 1
        return [*left, first, *(first + 1 + x for x in right)]
    raise AssertionError


#: The same in DuckDB, for a table documents of at most ``BUCKET_ROWS`` rows; it has no CRC-32 of its own. Segments of the
#: ordered groups are cut by the smallest capacity, or split at the group that alone sets it. Places are sums of the sizes
#: before them.
SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + {ROW_BYTES} AS size,
    CASE WHEN text IS NULL THEN 1 - (1::BIGINT << 60) ELSE 2 * (hash - CASE WHEN hash >= 1::BIGINT << 59 THEN 1::BIGINT << 60 ELSE 0 END) END AS key
  FROM (SELECT doc_id, text, ('0x' || substr(md5(text), 1, 15))::BIGINT AS hash FROM documents)),
sized AS (SELECT key, sum(size)::BIGINT AS bytes FROM docs GROUP BY key),
groups AS (SELECT key, bytes, (sum(bytes) OVER (ORDER BY key) - bytes)::BIGINT AS before FROM sized),
lists AS (
  SELECT list(before ORDER BY key) AS starts, list(bytes ORDER BY key) AS sizes, list_append(list(before ORDER BY key), sum(bytes)::BIGINT) AS sums, sum(bytes)::BIGINT AS total FROM groups),
segments AS (
  SELECT 0::BIGINT AS first, total AS last, {SHARDS}::BIGINT AS k, 0::BIGINT AS start, false AS plain, []::BIGINT[] AS ends FROM lists WHERE total > 0
  UNION ALL
  SELECT * FROM (
    WITH seen AS (
      SELECT first, last, k, starts, sizes, list_filter(sums, lambda s: s >= first AND s <= last) AS inside,
        list_max(list_filter(sizes, lambda x, i: starts[i] >= first AND starts[i] < last)) AS largest
      FROM segments, lists WHERE NOT plain),
    searched AS (
      SELECT *,
        list_reduce(
          list_prepend(0::BIGINT, list_reverse(range(0, 1 + ceil(log2(greatest(1, last - first)))::BIGINT))),
          lambda below, bit: CASE WHEN below + (1::BIGINT << bit) < greatest(largest, (last - first + k - 1) // k)
              OR list_reduce(list_prepend(first, range(1, k + 1)), lambda done, j: list_max(list_filter(inside, lambda s: s <= done + below + (1::BIGINT << bit)))) < last
            THEN below + (1::BIGINT << bit) ELSE below END) + 1 AS capacity
      FROM seen),
    cut AS (
      SELECT *, list_transform(range(1, k + 1), lambda n: list_reduce(list_prepend(first, range(1, n + 1)), lambda done, j: list_max(list_filter(inside, lambda s: s <= done + capacity)))) AS ends
      FROM searched),
    hot AS (
      SELECT *, list_position(ends, last) AS used, list_min(list_filter(starts, lambda s, i: s >= first AND s < last AND sizes[i] = largest)) AS spot FROM cut),
    split AS (SELECT *, len(list_filter(ends, lambda e: e <= spot)) AS run FROM hot),
    shared AS (
      SELECT *, list_reduce(list_prepend(1000 * run + used - run - 1, range(used, k)), lambda m, j: CASE
          WHEN CASE WHEN m // 1000 > 0 THEN (spot - first)::DOUBLE / (m // 1000) ELSE 0 END >= CASE WHEN m % 1000 > 0 THEN (last - spot - largest)::DOUBLE / (m % 1000) ELSE 0 END
          THEN m + CASE WHEN m // 1000 > 0 THEN 1000 ELSE 0 END ELSE m + CASE WHEN m % 1000 > 0 THEN 1 ELSE 0 END END) AS many
      FROM split)
    SELECT first, last, k, first AS start, true AS plain, list_prepend(first, ends[1:used - 1]) AS ends FROM shared WHERE capacity > largest
    UNION ALL SELECT spot, spot + largest, 1, spot, true, [spot] FROM shared WHERE capacity = largest
    UNION ALL SELECT first, spot, many // 1000, first, false, []::BIGINT[] FROM shared WHERE capacity = largest AND spot > first
    UNION ALL SELECT spot + largest, last, many % 1000, spot + largest, false, []::BIGINT[] FROM shared WHERE capacity = largest AND spot + largest < last)),
begins AS (SELECT list(DISTINCT b) AS begins FROM (SELECT unnest(ends) AS b FROM segments WHERE plain)),
sharded AS (SELECT key, len(list_filter(begins, lambda b: b <= before)) - 1 AS shard FROM groups, begins),
crc AS (
  SELECT list(c ORDER BY n) AS crcs FROM (
    SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS n))),
checked AS (
  SELECT r, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, x: xor(c >> 8, crcs[xor(c & 255, x) + 1]))) AS text_crc32 FROM docs, crc)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY key, doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM docs JOIN checked USING (r) JOIN sharded USING (key)
"""
