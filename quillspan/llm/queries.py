"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import chat, compression, contamination, divergence, line_dedup, packing, pitman_yor, simhash, suffix, url_filter
from quillspan.llm.common import id_hash


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = chat.transcripts(_table(spark, sf_dir, "conversations"))
    model = chat.fit(lines.filter(F.pmod(id_hash("conv_id"), F.lit(4)) != 2))
    return chat.parse(lines, model)


def op3_distribution_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality_rules(_table(spark, sf_dir, "documents"))


def op4_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_texts(_table(spark, sf_dir, "documents"))


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), line_dedup.Settings(least=1))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    own = (op1_compression_quality, op2_chat_turns, op3_distribution_rules, op4_pitman_yor_scores, op5_vector_packing, op6_url_filter, op7_suffix_dedup, op8_line_dedup, op9_decontamination, op10_simhash_groups)
    return {f.__name__: f for f in own}
