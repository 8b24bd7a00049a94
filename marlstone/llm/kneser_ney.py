"""Quality classifier: interpolated modified Kneser-Ney trigram model of trusted text, perplexity per document, thresholds
by language.

The n-grams of all trusted documents are counted in hash shards, which the documents' n-grams are joined with
(``ngram_shards``). Perplexity is per word, with an end mark after each text; unknown words share what the model leaves to
them. The threshold of a language is the quantile ``QUANTILE`` of the perplexities of its trusted documents, each by the
counts without its own; a language without trusted documents has the threshold of all. A document is kept if its perplexity
is at most the threshold.

Null and empty texts have only the end mark to predict and are not kept. A null language is a language of its own.
Repeated rows are scored one by one. With nothing to learn from, everything with a word is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import ngram_shards

QUANTILE = 0.995


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold and kept of every document."""
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    scored = ngram_shards.perplexities(docs, trusted)
    if scored is None:
        empty = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long").alias("n_words"))
        return empty.select("*", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), (F.col("n_words") > 0).alias("kept"))
    told = scored.where("n_words > 0 and own is not null")
    at = F.percentile_approx("own", F.lit(quantile), F.lit(10_000))
    limits = told.groupBy("lang").agg(at.alias("limit"))
    every = told.agg(at).first()[0]
    key = F.coalesce(F.concat(F.lit("s"), F.col("lang")), F.lit("n"))
    joined = scored.withColumn("key", key).join(limits.select(key.alias("key"), "limit"), "key", "left")
    joined = joined.withColumn("threshold", F.coalesce("limit", F.lit(every)))
    return joined.select("doc_id", "lang", "n_words", "perplexity", "threshold", ((F.col("n_words") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).alias("kept"))
