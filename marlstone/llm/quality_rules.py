"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted and raw text. DataFrame
operations only.

Words and pairs of neighbouring words are hashed (CRC-32) into ``BUCKETS`` buckets, half of them for each. Two multinomials
are counted: one over all documents, one over the trusted ones (label quality 1). A document's score is the mean, over its
n-grams, of log(trusted probability / raw probability), in whole ``UNIT``-ths so that sums are exact. The mean of that
logarithm over trusted text is E and its standard deviation S; a document of n n-grams is kept if its score is at least
E - z * S / sqrt(n). So the threshold is fixed by the two multinomials and the document's length alone, and every document
gets its verdict. The buckets are few for the words there are: a bucket holds many words, so a document's own rare ones
weigh little in the raw counts.

The raw multinomial counts every n-gram of every document. The trusted one is fitted on a bounded sample of labelled
documents, at most ``TRUSTED`` (the smallest hashes of doc_id). The logarithms, ``BUCKETS`` whole numbers, are an array in
the plan, in which n-grams are looked up by generated code. The exploded n-grams of a document lie together, so both counts
and scores are combined before their shuffle: a row per bucket and task, and a row per document.

A null text has no words and fails the base rule. Repeated rows are counted and judged one by one. With no trusted
document the ratio is zero everywhere and only the base rule drops documents. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import written

BUCKETS, TRUSTED, Z, WINDOW, UNIT = 1 << 14, 20_000, 10.0, 8, 4096
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"


def words(column: str = "text") -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(column), F.lit("")), SPACE), "")


def bound(value: Column, use) -> Column:
    """use(value), with value worked out once though use names it often, in lambdas too."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)  # a lambda of one argument, whatever use takes


def doubled(a: Column, step: int) -> Column:
    """A hash of each pair of elements that are step apart."""
    n = F.greatest(F.size(a) - step, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, step + 1, n), lambda x, y: F.xxhash64(x, y))


def repeated_words(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """Turns column hashes, of words, into n_repeat_words: how many words lie in windows of ``width``, a power of two, that
    occur twice or more. The windows' hashes are made of those of their halves, each in a column of its own, which is worked
    out once. Windows are sorted by hash, those next to an equal one are taken, and their places, in order, cover the words.
    A text without a half window that repeats has none."""

    def covered(seen: Column) -> Column:
        placed = F.sort_array(F.transform(seen, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s: lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        starts = F.sort_array(F.transform(bound(placed, lambda s: F.filter(s, same(s))), lambda x: x["i"].cast("long")))
        step = lambda a, x: F.struct((a["n"] + x + width - F.greatest(a["end"], x)).alias("n"), (x + width).alias("end"))
        return F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), step, lambda a: a["n"])

    none, step = F.array().cast("array<bigint>"), 1
    repeats = lambda seen: F.size(F.array_distinct(seen)) < F.size(seen)
    while step < width // 2:
        docs = docs.withColumn("hashes", doubled(F.col("hashes"), step))
        step *= 2
    docs = docs.withColumn("hashes", F.when(repeats(F.col("hashes")), doubled(F.col("hashes"), step)).otherwise(none))
    return docs.withColumn("n_repeat_words", F.when(repeats(F.col("hashes")), covered(F.col("hashes"))).otherwise(F.lit(0).cast("long"))).drop("hashes")


def slot(gram: Column, many: int) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(many)).cast("int")


def pair(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(" "), b)


def grams(docs: DataFrame, keep: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The columns to keep and bucket: a row for each word of column words and for each pair of neighbours. The last
    word's pair has a null bucket, and so have both rows of a text without words."""
    n, half = F.size("words"), buckets // 2
    pairs = F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"))
    rows = docs.select(*keep, F.explode_outer(pairs).alias("pair")).select(*keep, "pair.a", "pair.b")
    one = F.when(F.col("a").isNotNull(), slot(F.col("a"), half))
    two = F.when(F.col("b").isNotNull(), slot(pair(F.col("a"), F.col("b")), half) + half)
    return rows.select(*keep, F.explode(F.array(one, two)).alias("bucket"))


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, and words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words().alias("words"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    hashed = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        "words",
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    counted = repeated_words(hashed)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """At most ``most`` doc_ids of label quality 1, those with the smallest hashes."""
    known = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """For each bucket with an n-gram: bucket, own (its trusted n-grams and one), trusted (all of them), and llr, the
    logarithm in ``UNIT``-ths; both multinomials have one added to every bucket."""
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words().alias("words"))
    marked = split.join(F.broadcast(trusted.withColumn("good", F.lit(1))), "doc_id", "left")
    counts = grams(marked, ["good"], buckets).where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias("raw"), F.coalesce(F.sum("good"), F.lit(0)).alias("own"))
    counts = written(counts, "ngrams")
    total = counts.agg(F.sum("raw"), F.sum("own")).first()
    raw, own = (total[0] or 0) + buckets, (total[1] or 0) + buckets
    p, q = (F.col("raw") + 1) / F.lit(float(raw)), (F.col("own") + 1) / F.lit(float(own))
    llr = F.round(F.log(q / p) * UNIT).cast("int") if total[1] else F.lit(0)
    return counts.select("bucket", (F.col("own") + 1).alias("own"), F.lit(own).cast("long").alias("trusted"), llr.alias("llr"))


def judge(docs: DataFrame, labels: DataFrame, z: float = Z, buckets: int = BUCKETS, most_trusted: int = TRUSTED) -> DataFrame:
    """doc_id, the base counts, base_failed, score, threshold and kept of every document."""
    model = written(ratios(docs, trusted_ids(labels, most_trusted), buckets), "ratios")
    exact = F.col("own").cast("decimal(20,0)") * F.col("llr")
    # own over the buckets seen sums to a little under trusted; the rest of both multinomials is the same added mass
    total, square, trusted = model.agg(F.sum(exact), F.sum(exact * F.col("llr")), F.max("trusted")).first()
    mean, square = float(total or 0) / float(trusted or 1) / UNIT, float(square or 0) / float(trusted or 1) / (UNIT * UNIT)
    spread = max(0.0, square - mean * mean) ** 0.5
    known = {r["bucket"]: r["llr"] for r in model.select("bucket", "llr").collect()}  # at most as many as there are buckets
    logs = F.split(F.lit(",".join(str(known.get(i, 0)) for i in range(buckets))), ",").cast("array<int>")
    based = base_rules(docs).withColumn("row", F.monotonically_increasing_id())
    kept = [c for c in based.columns if c != "words"]
    scored = grams(based, kept, buckets).select(*kept, F.get(logs, F.col("bucket")).alias("llr")).groupBy(*kept).agg(F.coalesce(F.sum("llr"), F.lit(0)).alias("total"))
    n = F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    score = F.when(n > 0, F.col("total") / n / F.lit(float(UNIT))).otherwise(F.lit(0.0))
    threshold = F.lit(mean) - F.lit(z * spread) / F.sqrt(F.greatest(n, F.lit(1)))
    judged = scored.withColumn("score", score).withColumn("threshold", threshold).drop("total", "row")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.col("threshold")))


#: The same in DuckDB, for tables documents and labels; it has no CRC-32 of its own.
SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS words FROM documents),
trusted AS (
  SELECT * FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {TRUSTED}),
places AS (
  SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i:i + {WINDOW - 1}] AS run, doc_id IN (SELECT doc_id FROM trusted) AS good
  FROM (SELECT r, doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM docs)),
grams AS (SELECT r, good, a AS gram, 0 AS shift FROM places UNION ALL SELECT r, good, a || ' ' || b, {BUCKETS // 2} FROM places WHERE b IS NOT NULL),
crc AS (
  SELECT list(c ORDER BY n) AS crcs FROM (
    SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS n))),
bytes AS (
  SELECT gram, shift, list_transform(range(0, octet_length(encode(gram))), lambda i: ('0x' || substr(hex(encode(gram)), 2 * i + 1, 2))::BIGINT) AS data
  FROM (SELECT DISTINCT gram, shift FROM grams)),
hashed AS (
  SELECT gram, shift, shift + xor(4294967295, list_reduce(list_prepend(4294967295, data), lambda c, x: xor(c >> 8, crcs[xor(c & 255, x) + 1]))) % {BUCKETS // 2} AS bucket
  FROM bytes, crc),
counts AS (SELECT bucket, count(*) AS raw, count(*) FILTER (good) AS own FROM grams JOIN hashed USING (gram, shift) GROUP BY bucket),
totals AS (SELECT (sum(raw) + {BUCKETS})::DOUBLE AS raws, (sum(own) + {BUCKETS})::DOUBLE AS owns, sum(own) > 0 AS any_own FROM counts),
model AS (
  SELECT bucket, own + 1 AS own, owns, CASE WHEN any_own THEN round(ln(((own + 1) / owns) / ((raw + 1) / raws)) * {UNIT})::BIGINT ELSE 0 END AS llr FROM counts, totals),
moments AS (
  SELECT sum(own * llr)::DOUBLE / max(owns) / {UNIT}.0::DOUBLE AS mean, sum(own * llr * llr)::DOUBLE / max(owns) / {UNIT * UNIT}.0::DOUBLE AS square FROM model),
limits AS (SELECT mean, sqrt(greatest(0.0::DOUBLE, square - mean * mean)) AS spread FROM moments),
scores AS (SELECT r, sum(llr) AS total FROM grams JOIN hashed USING (gram, shift) JOIN model USING (bucket) GROUP BY r),
repeated AS (
  SELECT r, count(DISTINCT i) AS n FROM (
    SELECT r, unnest(range(i, i + {WINDOW})) AS i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS many FROM places WHERE len(run) = {WINDOW}) WHERE many > 1)
  GROUP BY r),
lined AS (
  SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM docs),
base AS (
  SELECT r, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM docs JOIN lined USING (r) LEFT JOIN repeated USING (r)),
judged AS (
  SELECT base.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN total::DOUBLE / (2 * n_words - 1) / {UNIT}.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
    mean - ({Z}::DOUBLE * spread) / sqrt(greatest(2 * n_words - 1, 1)::DOUBLE) AS threshold
  FROM base LEFT JOIN scores USING (r), limits)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, threshold, NOT base_failed AND score >= threshold AS kept FROM judged
"""
