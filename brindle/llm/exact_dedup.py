"""Exact duplicates by an extendible-hash index on shared files. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_shuffle, join_hot, stored

#: Rows a bucket holds before it splits, at least; a table has at most 2 ** 16 times its rows' share in a bucket.
BUCKET_ROWS, SHARE_BITS = 1024, 16
#: Bits of the directory that is broadcast; what they can't part is parted by pages.
MOST_BITS = 18
#: Rows an owner task has about, and owner tasks at most.
OWNER_ROWS, MOST_OWNERS = 100_000, 100_000


def normalised(text_col: str = "text") -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    c = F.coalesce(F.col(text_col), F.lit(""))
    for gone in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        c = F.replace(c, F.lit(gone), F.lit(""))
    return c


def prefix_of(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def directory(keys: DataFrame, bits: int, capacity: int) -> DataFrame:
    """(prefix, depth, bucket, held) for each of the 2 ** bits prefixes that occur among ``keys`` (prefix, n).

    Doubling starts from one bucket; a bucket of more than ``capacity`` rows splits by its next bit, until none is
    overfull or the bits end. A prefix thus belongs to the shallowest bucket on its path that is not overfull. One
    pass counts the rows of all depths of the path at once.
    """
    full = keys.groupBy("prefix").agg(F.sum("n").alias("n"))
    path = full.select("prefix", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    path = path.withColumn("bucket", F.expr(f"shiftright(prefix, {bits} - depth)"))
    held = path.groupBy("depth", "bucket").agg(F.sum("n").alias("held"))
    fit = path.join(by_shuffle(held), ["depth", "bucket"]).where((F.col("held") <= capacity) | (F.col("depth") == bits))
    leaf = fit.groupBy("prefix").agg(F.min(F.struct("depth", "bucket", "held")).alias("leaf"))
    return leaf.select("prefix", F.col("leaf.depth").alias("depth"), F.expr(f"shiftleft(leaf.bucket, {bits} - leaf.depth)").alias("bucket"), F.col("leaf.held").alias("held"))


@dataclass
class Index:
    """The directory with owners (prefix, bucket, pages, owner), the keys too hot for a bucket, and their sizes."""

    entries: DataFrame
    hot: DataFrame
    any_hot: bool
    bits: int
    owners: int
    rows: int


def build(keys: DataFrame, capacity: int) -> Index:
    """The index directory from the rows' keys (key). Only keys and counts move.

    ``capacity`` grows with the table, so buckets, and keys that alone overfill one, stay below 2 ** 17: that bounds
    what is broadcast. If a poor key function leaves a bucket overfull when ``MOST_BITS`` end, its keys are dealt
    over pages of one owner each, so no bucket is ever one task's burden.
    """
    spark = keys.sparkSession
    counts = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "dedup-keys")
    rows = counts.agg(F.sum("n")).first()[0] or 0
    capacity = max(capacity, rows >> SHARE_BITS)
    hot = counts.where(F.col("n") > capacity)
    bits = min(MOST_BITS, max(0, (rows // capacity).bit_length() + 1))
    cold = counts.where(F.col("n") <= capacity)
    while True:  # the directory doubles until no bucket is overfull
        leaves = stored(directory(cold.withColumn("prefix", prefix_of(F.col("key"), bits)), bits, capacity), "dedup-directory")
        if bits == MOST_BITS or leaves.where(F.col("held") > capacity).isEmpty():
            break
        bits = min(MOST_BITS, bits + 2)
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_OWNERS, rows // OWNER_ROWS))
    share = max(1, -(-rows // owners))
    before = F.sum("held").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    range_ = leaves.select("bucket", "held").distinct().withColumn("owner", (F.coalesce(before, F.lit(0)) / F.lit(share)).cast("int"))
    pages = F.ceil(F.col("held") / F.lit(capacity)).cast("int").alias("pages")
    entries = stored(leaves.join(range_.select("bucket", "owner"), "bucket").select("prefix", "bucket", pages, "owner"), "dedup-owners")
    return Index(entries, hot, not hot.isEmpty(), bits, owners, rows)


def placed(rows: DataFrame, index: Index) -> DataFrame:
    """``rows`` (key and others) without hot keys, at the owner task of their bucket's range, with ``bucket``."""
    if index.any_hot:
        rows = rows.join(F.broadcast(index.hot.select("key")), "key", "left_anti")
    at = rows.withColumn("prefix", prefix_of(F.col("key"), index.bits)).join(F.broadcast(index.entries), "prefix")
    owner = F.pmod(F.col("owner") + F.pmod(F.hash("key"), F.col("pages")), F.lit(index.owners)).cast("int")
    return at.withColumn("owner", owner).drop("prefix", "pages").repartitionById(index.owners, "owner")


def _first(n: Column, id_: Column) -> list[Column]:
    """The order in which rows of a group stay: most code points, smallest id, null ids last."""
    return [(-n).alias("n"), id_.isNull().alias("no"), id_.alias("id")]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ROWS, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Groups of texts that are equal without white space: ``id_col``, keep_id, group_size, kept, text_sha256, bucket, chain.

    1. The keys (``key`` of the normalised text, a long) are counted, and the directory is built from them by
       doubling; it is bounded (``build``), stored and broadcast.
    2. Buckets are dealt to owner tasks in ranges, and each row's text moves once, to the owner of its bucket.
    3. The owner sorts its range by key and compares whole normalised texts byte by byte: equal texts are one entry,
       other texts of the same key further entries of its chain (numbered in ``chain``).
    4. The index, every row at its entry, is written to the shared folder in the order of buckets.

    A key with more rows than a bucket's capacity (a hot text) never moves whole: its rows are combined by text
    before the shuffle, and find their entry in a join that broadcasts the hot entries, whose number is bounded.

    Of a group the row with the most code points of the original text stays, then the smallest id, null ids last;
    always exactly one row is kept, also of rows that repeat an id. Null texts count as empty (one group with empty
    and blank ones). An empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.char_length(text).cast("long").alias("n_chars"), normalised(text_col).alias("norm")).withColumn("key", key(F.col("norm")))
    index = build(own.select("key"), capacity)
    chained = placed(own, index).withColumn("chain", F.dense_rank().over(Window.partitionBy("owner", "bucket", "key").orderBy("norm")))
    chained = chained.withColumn("text_sha256", F.sha2("norm", 256)).drop("norm")
    entry = Window.partitionBy("owner", "bucket", "key", "chain")
    order = entry.orderBy(*_first(F.col("n_chars"), F.col("id")))
    done = chained.withColumns({"_rank": F.row_number().over(order), "keep_id": F.first("id").over(order), "group_size": F.count(F.lit(1)).over(entry)})
    columns = ["id", "keep_id", "group_size", (F.col("_rank") == 1).alias("kept"), "text_sha256", "bucket", "chain"]
    out = stored(done.select("key", *columns), "dedup-index").drop("key")
    if index.any_hot:
        out = out.unionByName(_hot(own, index).select(*columns))
    return out.withColumnRenamed("id", id_col)


def _hot(own: DataFrame, index: Index) -> DataFrame:
    """Rows of the hot keys with their entries; texts are combined before they move."""
    hot = own.join(F.broadcast(index.hot.select("key")), "key")
    sha = F.sha2("norm", 256).alias("text_sha256")
    rows = stored(hot.select("id", "n_chars", "key", sha).withColumn("row", F.monotonically_increasing_id()), "dedup-hot")
    groups = hot.groupBy("key", "norm").agg(F.count(F.lit(1)).alias("group_size"))
    groups = groups.withColumn("chain", F.dense_rank().over(Window.partitionBy("key").orderBy("norm"))).select("key", sha, "group_size", "chain")
    best = rows.groupBy("key", "text_sha256").agg(F.min(F.struct(*_first(F.col("n_chars"), F.col("id")), "row")).alias("best"))
    entries = stored(groups.join(best, ["key", "text_sha256"]), "dedup-hot-entries")
    found = join_hot(rows, entries, ["key", "text_sha256"], "group_size", index.rows)
    return found.select("id", F.col("best.id").alias("keep_id"), "group_size", F.when(F.col("row") == F.col("best.row"), 1).otherwise(2).alias("_rank"), "text_sha256", prefix_of(F.col("key"), index.bits).alias("bucket"), "chain")


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ROWS, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, whole and with all columns: each text moves once with its row."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key(normalised(text_col)).alias("key"))
    index = build(own.select("key"), capacity)
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    order = [*_first(F.char_length(text), F.col(f"row.`{id_col}`")), text.alias("text")]
    norm = normalised(f"row.`{text_col}`")
    first = F.row_number().over(Window.partitionBy("owner", "bucket", "key", "norm").orderBy(*order))
    out = placed(own, index).withColumn("norm", norm).withColumn("_rank", first).where("_rank = 1").select("row.*")
    if index.any_hot:
        hot = own.join(F.broadcast(index.hot.select("key")), "key").groupBy("key", norm.alias("norm"))
        out = out.unionByName(hot.agg(F.min_by("row", F.struct(*order)).alias("row")).select("row.*"))
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
k AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w AS r FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, r = 1 AS kept, sha256(norm) AS text_sha256 FROM k
"""
