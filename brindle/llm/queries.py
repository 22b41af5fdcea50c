"""The queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ensure_importable
from . import exact_dedup, html_extract, langid, mixing, packing, quality, simhash, token_counts, toxicity, warc
from .common import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file, on the driver and every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary(), limit=2048)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), length=4096, end_id=2)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return warc.digests(warc.archive(table(spark, sf_dir, "pages"), least_bytes=0))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, threshold=2)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_token_counts, op3_mix_sources, op4_html_extraction, op5_toxicity, op6_language_id, op7_exact_dedup, op8_packing, op9_warc, op10_simhash, pipeline)
}

#: The others can't be said in SQL; tests/llm holds their brute-force versions.
ORACLES: dict[str, str] = {"op3_mix_sources": mixing.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE}
