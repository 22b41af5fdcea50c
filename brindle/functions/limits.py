"""Size hints, byte caps and running budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Default caps.
MAX_FLAVOR_BYTES, MAX_TOTAL_BYTES, MAX_ITEMS, MAX_PIXELS, MAX_DEPTH = 64 << 20, 256 << 20, 1 << 20, 1 << 28, 64


def known_bytes(kind: Column, n: Column) -> Column:
    """Bytes of an Exact or AtLeast hint; null for Unknown."""
    return F.when(kind.isin("Exact", "AtLeast"), n)


def definitely_exceeds(kind: Column, n: Column, limit: int) -> Column:
    return F.coalesce(known_bytes(kind, n) > limit, F.lit(False))


def rejects(size: Column, cap: int | None = MAX_FLAVOR_BYTES) -> Column:
    """Whether a payload of so many bytes is over the cap for one flavor, the only cap that is enforced by default."""
    return F.lit(False) if cap is None else F.coalesce(size > cap, F.lit(False))


def extended_caps(df: DataFrame, key: str, size_col: str, max_total: int = MAX_TOTAL_BYTES, max_items: int = MAX_ITEMS) -> DataFrame:
    """An extension, off by default elsewhere: payloads whose items or bytes in all exceed a cap, by key."""
    total = df.groupBy(key).agg(F.count(F.lit(1)).alias("items"), F.sum(size_col).alias("total"))
    return total.select(key, "items", "total", ((F.col("items") > max_items) | (F.col("total") > max_total)).alias("refused"))


def budget(df: DataFrame, stream: list[str], order: list[str], n: str, limit: int) -> DataFrame:
    """Running use of a byte budget by stream: spent, accepted, is_exhausted.

    spent counts what was offered, not what fit. A chunk is accepted if it fits in what remains; the first that does
    not leaves nothing, so after it only empty chunks are.
    """
    w = Window.partitionBy(*stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("spent", F.sum(n).over(w))
    return out.withColumn("accepted", (F.col("spent") <= limit) | (F.col(n) == 0)).withColumn("is_exhausted", F.col("spent") >= limit)
