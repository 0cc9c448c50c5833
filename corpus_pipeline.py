"""A corpus pipeline: quality rules, near duplicates, substring dedup, source mix, packing. Stages are written and reread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import mixing, ngram_join, packing, quality, substring_dedup
from quantloom.llm._common import Stages, id_in, numbered, read
from quantloom.llm.queries import WEIGHTS


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep. Null and empty texts fail the base rules; null lang or source are
    groups like others; rows that repeat a doc_id are judged each by its own text."""
    bad = quality.quality_rules(docs).filter("not kept").select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash"))
    return docs.join(bad.hint("merge"), (id_in() == F.col("__id")) & (quality.row_hash() == F.col("__hash")), "left_anti")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near duplicates (five-word shingles, similarity 0.8) in order of doc_id; rows without a
    doc_id come last, and those that share one are judged each by its own text. Texts without words, null ones included,
    are near to nothing and stay. An empty table stays empty."""
    rows, _ = numbered(docs, Stages(spark, "near"))
    groups = ngram_join.ngram_groups(rows.select(F.col("__doc").alias("doc_id"), "text"), k=5, num=4, den=5)
    keep = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("__k")).hint("merge")
    return _columns(rows.join(keep, F.col("__doc") == F.col("__k"), "left_semi"), docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of 20 words that an earlier document has; documents of which nothing is left go. Texts of fewer
    words, empty and null ones stay as they are; rows that repeat a doc_id are documents of their own."""
    d = substring_dedup.substring_dedup(docs, window=20).filter("n_removed < n_words or n_words = 0")
    text = F.coalesce("kept_words", "text")
    return _columns(d, docs, text=text, n_chars=F.coalesce(F.length(text).cast("long"), F.col("rest.n_chars")))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it; a null source is a source, and rows that repeat a doc_id are taken each by
    itself. Texts without words come in whole epochs at no cost."""
    rows, _ = numbered(docs, Stages(spark, "mixed"))
    asked = rows.select(F.col("__doc").alias("doc_id"), "text", F.col("rest.source").alias("source"))
    copies = mixing.mix_sources(asked, mixing.cyclic_weights(WEIGHTS), total_share=1.5, max_epochs=2.0)
    copies = copies.filter("copies > 0").select(F.col("doc_id").alias("__id"), F.col("copies").alias("__n")).hint("merge")
    d = rows.join(copies, F.col("__doc") == F.col("__id"))
    return _columns(d.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))), docs)


def _columns(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs from rest and text, those in new replaced."""
    of = lambda c: new[c] if c in new else F.col("text") if c == "text" else F.col(f"rest.`{c}`")
    return rows.select(*[of(c).alias(c) for c in docs.columns])


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048; null and empty texts are a piece of one token."""
    return packing.pack(docs, capacity=2048)


STAGES = [("quality rules", quality_stage), ("near duplicates", near_duplicate_stage), ("substring dedup", substring_stage), ("source mix", mix_stage), ("packing", pack_stage)]
#: SQL can't express the sketches, seeded hashes and packing; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, st, last = read(spark, sf_dir, "documents"), Stages(spark, "pipeline"), None
    for _, stage in STAGES[:-1]:
        docs, before = st.save(stage(spark, docs, sf_dir)), last
        if before is not None:
            st.drop(before)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
