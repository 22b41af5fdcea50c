"""Documents to packed training sequences: quality rules, exact and near deduplication, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import exact_dedup, mixing, packing, quality, simhash
from brindle.llm.common import new_folder, stored, table
from brindle.llm.queries import vocabulary
from brindle.shipping import ensure_importable


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the model keep: one map over the rows, so null and repeated ids are rows like others.

    Null and empty texts go. Without labels of both kinds only the rules judge.
    """
    ensure_importable(spark)
    return quality.kept_rows(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, also where rows repeat an id or have none (those stay last)."""
    ensure_importable(spark)
    return exact_dedup.distinct_rows(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row (that of the smallest id, null last) of each component of linked fingerprints.

    Rows are numbered and stored once, so the decisions meet rows, not ids: null and repeated ids are rows like others.
    """
    ensure_importable(spark)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = stored(docs.select(whole, F.monotonically_increasing_id().alias("row")), "pipeline-near")
    key = F.struct(F.col("whole.doc_id").isNull().alias("no"), F.col("whole.doc_id").alias("id"), F.col("row"))
    found = simhash.simhash_groups(rows.select(key.alias("key"), F.col("whole.text").alias("text")), id_col="key")
    kept = found.where(F.col("key.row") == F.col("component_id.row")).select("key.row")
    return rows.join(kept, "row", "left_semi").select("whole.*")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: twice at most; none of those without a word."""
    ensure_importable(spark)
    return mixing.mixed(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences; each row is packed, whatever its id."""
    ensure_importable(spark)
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("mix_sources", mix_stage),
    ("packing", pack_stage),
]

#: A trained model, fingerprint components and a tokenizer are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
