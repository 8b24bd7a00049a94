"""The queries of this folder's operators, each over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, html_extract, kneser_ney, langid, licenses, mixing, pii, quality_rules, sharding, simhash
from marlstone.llm.common import read, written

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", mixing.word_count().alias("size"))
    return mixing.mix(written(docs, "sizes")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    checksum = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    narrow = written(docs.select("doc_id", checksum, sharding.size_of().alias("size"), sharding.group_of().alias("group")), "sizes")
    law = [F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    return sharding.assign_sized(narrow).select("doc_id", "size", "text_crc32", *law)


def op4_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).drop("matches")


def op5_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontaminate.items_digest().alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.held_out(), F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text"), model, "doc_id", "held_out")


def queries() -> dict[str, Query]:
    found = [
        op1_mix_sources,
        op2_simhash_components,
        op3_minimax_shards,
        op4_license_templates,
        op5_quality_ratio,
        op6_decontaminate,
        op7_personal_data,
        op8_main_text,
        op9_kneser_ney,
        op10_language,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.SQL, "op3_minimax_shards": sharding.SQL, "op4_license_templates": licenses.SQL, "op5_quality_ratio": quality_rules.SQL, "op6_decontaminate": decontaminate.SQL}
