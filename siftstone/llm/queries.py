"""The queries of the training-data operators, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm import compression, gif, html, lexical, mixing, nearest, packing, preference, quality, resampling, sharding, simhash, substrings
from siftstone.llm.common import table


def op1_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_digests(table(spark, sf_dir, "documents"))


def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op3_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.preference_pairs(preference.borrowed_answers(table(spark, sf_dir, "conversations")))
    return pairs.withColumns({c: preference.as_text(F.col(c)) for c in ("chosen_loss", "rejected_loss")})


def op4_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digests(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.judge(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op8_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages")).withColumnRenamed("key", "page_id")


def op10_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_wavelet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_ngram_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_projection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_gif_media, op2_length_buckets, op3_preference_pairs, op4_boosted_quality, op5_suffix_array_dedup, op6_simhash, op7_compression_bands, op8_sampled_splitters, op9_text_density, op10_pivotal_mixing, op11_wavelet_search, op12_ngram_resampling, op13_projection_search)}


def oracle_sql() -> dict[str, str]:
    return {"op2_length_buckets": packing.ORACLE_SQL, "op3_preference_pairs": preference.ORACLE_SQL, "op5_suffix_array_dedup": substrings.ORACLE_SQL, "op8_sampled_splitters": sharding.ORACLE_SQL, "op11_wavelet_search": lexical.ORACLE_SQL, "op12_ngram_resampling": resampling.ORACLE_SQL}
