"""From raw documents to token ids: five stages, each written as Parquet for the next.

A null or empty text is rejected by the quality rules.  Rows that share a doc_id but
not the text are documents of their own; of rows with equal id and text near-dedup
keeps one.  Of near copies the smallest id stays, whatever the order of rows.  A text of
any length goes through whole.  Extra columns, whatever their names, come along through
all stages but the last.  Empty tables give an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm import bpe, line_dedup, mixing, near_dedup, quality_rules
from signalmill.llm.storage import fresh_path, small_batches, smaller, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the learned decision list go."""
    small_batches(spark)
    rules = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judged(docs, rules).where("__quality_kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go from all but their first document; documents of nothing else go whole."""
    small_batches(spark)
    out = line_dedup.deduplicated(docs)
    out = out.where((F.col("__lines_n_removed_words") == 0) | (F.trim(F.regexp_replace("__lines_text", r"[\x09-\x0D]", " ")) != ""))
    new = {"text": F.col("__lines_text"), "n_chars": F.length("__lines_text").cast("bigint")}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the first by id and hash of the text.

    Of rows with equal id and text the first by all its columns as JSON stays; rows without an id are not removed as near copies.
    """
    small_batches(spark)
    found = near_dedup.similar_components(docs.select("doc_id", "text"), width=5, percent=80, keepers=True)
    found = written(found.select("doc_id", "text_hash", "kept"), "kept")
    gone = found.where("not kept").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__gone_text")).distinct()
    gone = smaller(written(gone, "gone"))
    out = docs.join(gone, (docs["doc_id"] == F.col("__gone")) & (F.xxhash64(docs["text"]) == F.col("__gone_text")), "left_anti")
    if found.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        return out
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = out.groupBy("doc_id", "text").agg(F.min_by(whole, F.to_json(whole)).alias("__row"))
    return first.select("__row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their target weights: a document goes, stays, or stands up to three times."""
    small_batches(spark)
    size, key = mixing.word_count(F.col("text")), mixing.text_key(F.col("text"))
    sources, shards = mixing.quotas(written(docs.select("doc_id", key.alias("text_key"), "source", size.alias("size")), "mix-sizes"))
    out = mixing.taken(docs, sources, shards, size, key).where("__mix_copies > 0")
    copies = F.sequence(F.lit(1).cast("bigint"), F.col("__mix_copies"))
    return out.withColumn("__mix_copy", F.explode(copies)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token ids, and whether they decode to the text."""
    small_batches(spark)
    out = bpe.round_trip(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "source", F.size("__bpe_ids").cast("bigint").alias("n_tokens"), F.col("__bpe_ids").alias("token_ids"), (F.col("__bpe_decoded") == F.coalesce("text", F.lit(""))).alias("round_trips"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("source_mix", mix), ("bpe", encode)]

#: The stages learn a classifier and group by similarity, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = fresh_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
