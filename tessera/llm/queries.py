"""The contract's queries, one for each operator, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, duck, html_extract, lbl_lm, packing, pii_sanitize, quality_rules, simhash_dedup, source_mix, topk_search, toxicity, url_filter


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash_dedup.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix(common.table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_sanitize.report(common.table(spark, sf_dir, "documents"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl_lm.score(common.table(spark, sf_dir, "documents"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(common.table(spark, sf_dir, "embeddings"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(common.table(spark, sf_dir, "pages")).drop("p_block")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(common.table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(common.table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_mix": op2_mix,
    "op3_pii": op3_pii,
    "op4_language_model": op4_language_model,
    "op5_top_k": op5_top_k,
    "op6_url_filter": op6_url_filter,
    "op7_main_text": op7_main_text,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "pipeline": pipeline,
}
#: The others need XXH64, a tokenizer, positions of matches, trained models or a DOM, which SQL does not have.
ORACLES: dict[str, str] = {
    "op2_mix": duck.mixed(),
    "op5_top_k": duck.top_k(),
    "op6_url_filter": duck.url_verdicts(),
    "op10_quality": duck.quality(),
}
