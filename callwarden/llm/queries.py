"""The registered queries: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwarden.llm import (
    bpe,
    hyperplane_tree,
    line_dedup,
    packing,
    quality_classifier,
    sharding,
    simhash,
    spelling_variants,
    suffix_index,
    toxicity,
    vantage_trees,
    warc,
    weak_supervision,
)
from callwarden.llm.registry import CHECKS, QUERIES, query  # noqa: F401
from callwarden.llm.sharding_check import sharding_sql
from callwarden.sources.checkpoints import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op5_sharding", sharding_sql(24))
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir), 24)


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir), table(spark, sf_dir, "labels"))


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(table(spark, sf_dir), table(spark, sf_dir, "labels"))


@query("op2_line_dedup")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(table(spark, sf_dir))
    return left.select(
        "doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed_lines"),
        F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.decode(bpe.encode(table(spark, sf_dir), tokenizer_path()), tokenizer_path())
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weak_supervision.judge_quality(table(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


@query("op4_vantage_trees")
def op4_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage_trees.nearest_of_every(table(spark, sf_dir, "embeddings"), every=20, k=20)


@query("op8_suffix_arrays")
def op8_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_index.remove_repeats(table(spark, sf_dir), 400)
    taken = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["z"] - s["a"])
    return left.select(
        "doc_id", "n_bytes", taken.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.expr("make_valid_utf8(cast(kept as string))").alias("kept_text"),
    )


@query("op12_spelling_variants", spelling_variants.spelling_sql(199))
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir), every=199)


@query("op11_warc", warc.warc_sql())
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    records = warc.with_targets(warc.read_archives(spark, folder))
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op13_hard_negatives", hyperplane_tree.negatives_sql())
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hyperplane_tree.hard_negatives(hyperplane_tree.whole_vectors(vectors, 256, label=label))
