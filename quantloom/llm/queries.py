"""The thin queries opN_<name>: each applies its operator with production parameters to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, mixing, nearest, ngram_join, packing, quality, sharding, sql, substring_dedup, suffix_dedup, urls
from ._common import id_out, read

# Rules of the URL filter (verdict, host, path) and the listed domains.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LISTED = ("ads-track.example.com", "adult-x.example.com", "casino-win.example.net", "cheap-pills.example.net", "free-bets.example.net", "spam-farm.example.org")
WEIGHTS = [3, 1, 2]
SHARD_BYTES = 1 << 20


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(read(spark, sf_dir, "documents"), mixing.cyclic_weights(WEIGHTS), total_share=1.5, max_epochs=2.0)
    return out.select(id_out(), "size", "source_size", "target", "taken", "source", "copies")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digests(read(spark, sf_dir, "documents"), length=400)


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(read(spark, sf_dir, "documents"), limit=SHARD_BYTES)
    return out.select(id_out(), "n_bytes", "shard", "shard_bytes", "oversize")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(x,) for x in LISTED], "key string")
    return urls.url_filter(read(spark, sf_dir, "pages"), URL_RULES, listed)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), capacity=2048)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(read(spark, sf_dir, "documents"))
    return out.select(id_out(), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(read(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digests(read(spark, sf_dir, "documents"), window=20)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.license_scan(licenses.document_files(read(spark, sf_dir, "documents")))
    return out.select(id_out("file_id").alias("doc_id"), "license", F.round("cosine", 6).alias("cosine"), "origin", "from")


QUERIES = {
    f.__name__: f
    for f in (op1_mix_sources, op2_suffix_dedup, op3_extendible_sharding, op4_url_filter, op5_best_fit_packing, op6_quality_rules, op7_nearest, op8_ngram_join, op9_substring_dedup, op10_license_scan)
}

#: SQL where it expresses the result; the other operators are held against brute force in tests/llm.
ORACLE = {
    "op2_suffix_dedup": sql.suffix_dedup(400),
    "op4_url_filter": sql.url_filter(URL_RULES, LISTED),
    "op8_ngram_join": sql.ngram_components(4, 85, 100),
    "op9_substring_dedup": sql.substring_dedup(20),
}
