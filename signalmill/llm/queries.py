"""The queries of this subpackage's operators, over the driver's tables."""

from __future__ import annotations


import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fill_in_middle, license_scan, line_dedup, mixing, near_dedup, permutation_index, quality_rules, resampling, secret_scan, toxicity, warc, wavelet
from .storage import fresh_path, small_batches, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.fit(documents, _table(spark, sf_dir, "labels"))
    out = quality_rules.judged(documents, rules)
    counts = [F.col("__quality_counts")[c].alias(c) for c in quality_rules.COUNTS[:5]]
    return out.select("doc_id", *counts, F.col("__quality_base_failed").alias("base_failed"), F.col("__quality_kept").alias("kept"), F.col("__quality_rule").alias("rule"))


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    index = permutation_index.PermutationIndex(vectors, most_ids=21)
    return index.search(vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 20)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", mixing.text_key(F.col("text")).alias("text_key"), "source", mixing.word_count(F.col("text")).alias("size"))
    sized = written(documents, "mix-sizes")
    out = mixing.taken(sized, *mixing.quotas(sized), F.col("size"), F.col("text_key"))
    return out.select("doc_id", "size", F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), F.col("__mix_taken").alias("taken"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scanned(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = license_scan.base_spans(F.col("__lic_found"))
    starts = F.transform(F.col("b"), lambda s: s["start"])
    return out.withColumn("b", base).select(
        "doc_id",
        F.col("__lic_n_words").alias("n_words"),
        F.size("b").cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        F.array_join(license_scan.labels_of(F.col("b")), ",").alias("base_labels"),
        F.array_join(license_scan.labels_of(F.concat("b", "__lic_kept")), ",").alias("labels"),
        license_scan.score_of(F.col("__lic_kept")).alias("score"),
    )


def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_dedup.similar_components(documents, width=3, percent=85)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines_text").alias("text"), F.col("__lines_n_removed_lines").alias("n_removed_lines"), F.col("__lines_n_removed_words").alias("n_removed_words"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secret_scan.BlobLedger(spark, fresh_path(spark, "secret-ledger"))
    ledger.scan(documents)
    out = ledger.join(documents).withColumn("base", F.filter("__secret_spans", lambda s: s["kind"].isin(*secret_scan.BASE)))
    count = lambda kind: F.size(F.filter("__secret_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return out.select(
        "doc_id",
        *map(count, secret_scan.BASE),
        F.sha2(secret_scan.span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.span_list(F.col("__secret_spans")).alias("spans"),
        F.col("__secret_blob").alias("blob_id"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, _table(spark, sf_dir, "labels"))
    out = documents.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), model.column("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_wavelet_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = wavelet.store(documents, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.round_trip(documents, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        F.size("__bpe_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("__bpe_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("__bpe_decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fill_in_middle.restored(fill_in_middle.transformed(documents))
    return out.select("doc_id", *[F.col(f"__fim_{c}").alias(c) for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")])


def op12_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    named = (
        op1_quality_rules, op2_permutation_index, op3_source_mix, op4_license_scan, op5_lsh_forest, op6_line_chunks, op7_secret_scan, op8_toxicity, op9_wavelet_store, op10_bpe_round_trip,
        op11_fill_in_middle, op12_warc_chain, op13_importance_draw,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mix": mixing.ORACLE_SQL, "op5_lsh_forest": near_dedup.oracle_sql(3, 85)}
