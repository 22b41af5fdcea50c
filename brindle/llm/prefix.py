"""Running sums over queues of any length, without a task that holds a whole queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks whose sums one task adds up, and rows of a range (at least; a large table has more of them).
SPAN, RANGE_ROWS, MOST_RANGES = 4096, 2000, 10_000


def ranges(df: DataFrame, n: int, order: list[str], out: str) -> DataFrame:
    """``df``, of about ``n`` rows, in ranges of ``order`` of about equal size, numbered in that order in ``out``.

    Spark draws the borders from a sample, so the spread of the values does not matter; rows that are equal in
    ``order`` share a range. ``df`` is read twice.
    """
    spark = df.sparkSession
    parts = max(1, min(MOST_RANGES, n // RANGE_ROWS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 1_000_000)))
    if parts == 1:
        return df.withColumn(out, F.lit(0))
    return df.repartitionByRange(parts, *[F.col(c).asc_nulls_last() for c in order]).withColumn(out, F.spark_partition_id())


def offsets(sums: DataFrame, queue: list[str], block: str, value: str, out: str) -> DataFrame:
    """For each (queue, block), the sum of ``value`` over the queue's earlier blocks; two levels of blocks."""
    spans = sums.withColumn("_span", F.expr(f"`{block}` div {SPAN}"))
    inside = Window.partitionBy(*queue, "_span").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*queue).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    total = spans.groupBy(*queue, "_span").agg(F.sum(value).alias("_total"))
    total = total.withColumn("_before", F.coalesce(F.sum("_total").over(across), F.lit(0))).drop("_total")
    local = spans.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*queue, "_span"]]
    return local.alias("a").join(total.alias("b"), on).select(*[F.col(f"a.{c}") for c in [*queue, block]], (F.col("_local") + F.col("_before")).alias(out))


def running_sum(df: DataFrame, queue: list[str], block: str, order: list[str | Column], value: str, out: str) -> DataFrame:
    """``out`` = sum of ``value`` over the earlier rows of the queue and this one, by (block, *order)."""
    local = Window.partitionBy(*queue, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(*queue, block).agg(F.sum(value).alias("_sum"))
    before = offsets(sums, queue, block, "_sum", "_before")
    rows = df.withColumn("_upto", F.sum(value).over(local))
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in [*queue, block]]
    joined = rows.alias("x").join(before.alias("y"), on)
    return joined.select(*[F.col(f"x.{c}") for c in df.columns], (F.col("_upto") + F.col("_before")).cast("long").alias(out))
