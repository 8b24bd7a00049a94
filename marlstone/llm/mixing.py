"""Mixing sources to target weights by systematic sampling. DataFrame operations only.

Every document of a source expects target / source size copies. Within the source the documents stand in one order, the
expected copies are summed up along it, one random offset in [0, 1) is added, and a document is emitted once for each
integer that the sum crosses at it. The order goes by size class (the number of digits and the two leading ones) and then
by a hash of doc_id and size, so documents of like sizes stand together and the words taken keep close to the target.

The running sum takes no sort of a whole source: a class of many documents is cut into ranges of the hash, ranks within
a range come from a window over the range alone, and ranges are offset by sums over their counts. A range holds about
``RANGE_ROWS`` rows, or a ``RANGES``-th of all rows if that is more, whatever share of the rows a source has. Rows of one
doc_id and size, or without doc_id, are alike to the mix; where there are many of them, they are dealt out further.

A null or empty text has size 0 and takes no words; a null source is a source of its own, after the others. Rows that
repeat a doc_id are documents of their own, and tied ones are interchangeable. An empty table gives an empty mix. Extra
columns pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import free_name, numbered, written

WEIGHTS, SHARE, REPEATS, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 7
RANGE_ROWS, RANGES = 128, 10_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def hash60(text: Column) -> Column:
    """The first 60 bits of MD5 as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def offset(source: Column, seed: int = SEED) -> Column:
    """A source's random offset: a multiple of 2**-20 in [0, 1), so that sums with it lose no bits."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))), 1, 5)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 20)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """sizes: source and source_size, a row for each source. Adds target: shares of the whole by weight, where a source
    stops at ``repeats`` times its size and the others share what is over by weight.

    In the order of size / weight, the sources that stop come first; the rest share what those leave. A row for each
    source is all that these windows see."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    full = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * repeats)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = F.sum("source_size").over(Window.partitionBy()) * share
    level = (whole - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # the level rises as long as sources stop and falls from the first one on that doesn't
    return full.withColumn("level", level).select("source", "source_size", F.least("most", F.max("level").over(Window.partitionBy()) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS, seed: int = SEED) -> DataFrame:
    """docs with doc_id, source and size (long), a table that has been written, as it is read more than once; other columns
    pass through. Adds source_size, target and copies."""
    sized = F.col("size").cast("string")
    rows = docs.select(
        *(docs[c] for c in docs.columns),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("__key"),
        (F.length(sized) * 100 + F.substring(sized, 1, 2).cast("int")).alias("__class"),
        hash60(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), sized)).alias("__hash"),
        F.monotonically_increasing_id().alias("__row"),
    )
    groups = written(rows.groupBy("__key", "__class").agg(F.count("*").alias("__n"), F.sum("size").alias("__words"), F.first("source").alias("source")), "groups")
    n = groups.agg(F.sum("__n")).first()[0] or 0
    most = max(RANGE_ROWS, n // RANGES)  # fewer than RANGES groups have more rows, which bounds the broadcast
    large = groups.where(F.col("__n") > most).select("__key", "__class", F.ceil(F.col("__n") / most).alias("__cut"))
    cut = F.coalesce(F.shiftright(F.shiftright(F.col("__hash"), 30) * F.col("__cut"), 30), F.lit(0)).alias("__range")
    rows = rows.join(F.broadcast(large), ["__key", "__class"], "left").withColumn("__range", cut).drop("__cut")
    where = ["__key", "__class", "__range", "__part", "__sub"]
    rows, ends = parted(rows, most)
    along = Window.partitionBy("__key").orderBy(*where[1:]).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__before", F.coalesce(F.sum("__many").over(along), F.lit(0))).drop("__many")
    targets = source_targets(groups.groupBy("__key").agg(F.first("source").alias("source"), F.sum("__words").alias("source_size")), weights, share, repeats)
    targets = targets.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("__key"), "source_size", "target", offset(F.col("source"), seed).alias("__offset"))
    ends = ends.join(targets, "__key")
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*where).orderBy("__hash", "doc_id", "size")))
    at = F.col("__before") + F.col("__rank")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(at * F.col("__each") + F.col("__offset")) - F.floor((at - 1) * F.col("__each") + F.col("__offset"))
    placed = ranked.join(ends, where).withColumn("__each", each)
    placed = placed.withColumn("copies", F.least(copies, F.ceil("__each")).cast("int"))  # a sum's last bit may not add a copy
    return placed.select(*docs.columns, "source_size", "target", "copies")


def parted(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Adds __part and __sub, which cut a range further where more than ``most`` rows have one doc_id and size and so one
    hash: those are alike, so any of them can have any of their ranks, and they are dealt out by row. Returns the rows, and
    how many there are in each piece. Such hashes are fewer than ``RANGES``, for so many rows would be more than there are."""
    same = ["__key", "__class", "__range"]
    ranges = written(rows.groupBy(*same).agg(F.count("*").alias("__many")), "ranges")
    whole = {"__part": F.lit(0), "__sub": F.lit(0)}
    full = ranges.where(F.col("__many") > 4 * most)  # a range without such a hash is never so full
    if full.isEmpty():
        return rows.withColumns(whole), ranges.withColumns(whole)
    many = written(rows.join(F.broadcast(full.drop("__many")), same, "left_semi").groupBy(*same, "__hash").agg(F.count("*").alias("__many")).where(F.col("__many") > most), "alike")
    hot = many.groupBy(*same).agg(F.collect_list("__hash").alias("__hot"))
    below = F.size(F.filter(F.coalesce("__hot", F.array().cast("array<bigint>")), lambda h: h < F.col("__hash")))
    own = F.coalesce(F.array_contains("__hot", F.col("__hash")), F.lit(False))
    pieces = -(-(many.agg(F.max("__many")).first()[0] or 1) // most)
    parts = {"__part": 2 * below + own.cast("int"), "__sub": F.when(own, F.pmod("__row", F.lit(pieces))).otherwise(F.lit(0))}
    cut = rows.join(F.broadcast(hot), same, "left").withColumns(parts).drop("__hot")
    return cut, cut.groupBy(*same, "__part", "__sub").agg(F.count("*").alias("__many"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it, all columns as they are. The mix is made of a table
    of sizes; the texts go through one shuffle, by row."""
    name = free_name(docs)
    rows = numbered(docs, name)
    sizes = written(rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), F.col(name).alias("row")), "sizes", keep=True)
    taken = mix(sizes, weights, share, repeats).where(F.col("copies") > 0).select(F.col("row").alias(name), F.array_repeat(F.lit(0), F.col("copies")).alias(name + "_"))
    return rows.join(taken, name).withColumn(name + "_", F.explode(name + "_")).drop(name, name + "_")


#: The same in DuckDB, for a table documents.
SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
    source_size * 2.0::DOUBLE AS most FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT source, source_size, least(most, max(level) OVER () * weight) AS target,
    ('0x' || substr(md5('7:' || coalesce('s' || source, 'n')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS shift FROM levels),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::INT,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 15))::BIGINT, doc_id NULLS FIRST, size) AS rank FROM sized),
placed AS (
  SELECT doc_id, size, source_size, target, rank, shift, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each
  FROM ranked JOIN targets ON ranked.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
  (least(floor(rank * each + shift) - floor((rank - 1) * each + shift), ceil(each)) * size)::BIGINT AS taken FROM placed
"""
