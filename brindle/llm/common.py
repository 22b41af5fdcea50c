"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once by the numpy kernels; bounds their scratch memory.
PIECE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; where that is unset, a new temporary one in local
    mode (tests), an error on a cluster.
    """
    sc = spark.sparkContext
    held = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if held:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(held)
        return held.rstrip("/")
    if sc.getCheckpointDir() is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor sees")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
    return sc.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


_WRITTEN: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    if not _WRITTEN:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may have gone first
            return


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read again: a cut of lineage that later reads can prune."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_shuffle(side: DataFrame) -> DataFrame:
    """``side`` of a join that must not be broadcast, as it grows with the input.

    Spark takes a table for as large as its files and a map's rows for as many as went in. So rows that compress well,
    or of which a map makes many, look small enough, and the driver gets them all.
    """
    return side.hint("merge")


#: Rows of a table that is broadcast as it is small, at most.
FEW_ROWS = 1 << 17


def sized(side: DataFrame, rows: int) -> DataFrame:
    """``side`` of a join, of at most ``rows`` rows: broadcast while they are few, else joined by shuffle."""
    return F.broadcast(side) if rows <= FEW_ROWS else by_shuffle(side)


#: A key is hot above so many rows, and above its share of all rows that leaves at most so many hot keys.
HOT_ROWS, MOST_HOT = 20_000, 10_000


def join_hot(rows: DataFrame, named: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``named``, which is unique by ``on`` and has the rows of each key in ``count``.

    Hot keys are joined by a broadcast of their entries, ``MOST_HOT`` at most of ``total`` rows, so no task gets all
    rows of one; the others by a shuffle. Both frames are read twice and should be stored.
    """
    limit = max(HOT_ROWS, total // MOST_HOT)
    hot = named.where(F.col(count) > limit)
    if hot.isEmpty():
        return rows.join(by_shuffle(named), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(by_shuffle(named.where(F.col(count) <= limit)), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


_HELD: dict[Hashable, Any] = {}


def worker_cache(owner: Hashable, make: Callable[[], Any] = lambda: None) -> Any:
    """An object kept in the worker process for the tasks of one owner; asking for another owner's lets it go.

    Workers outlive a query, so what one operator keeps would add to the memory of the next.
    """
    if owner not in _HELD:
        _HELD.clear()
        _HELD[owner] = make()
    return _HELD[owner]


#: Bytes of features that a fit brings to the driver at most.
FIT_BYTES = 128 << 20


def fit_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, salt: str, id_col: str, text_col: str) -> DataFrame:
    """y, order, text of ``rows`` labelled documents at most: those with the least hash of the id, in ``order``.

    One row a label, whatever repeats: of documents that share an id the least text.
    """
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    picked = picked.withColumn("order", F.xxhash64("id", F.lit(salt))).orderBy("order", "id", "y").limit(rows)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    return found.groupBy("order", "y").agg(F.min("text").alias("text")).select("y", "order", "text").repartition(16, "order")


def fit_features(features: DataFrame, limit: int | None = None, **columns: type) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """``features`` (y, order, idx and others) on the driver, by order: as many of the first as have ``limit`` bytes.

    y, the numbers a row has, and for each column named (with its type) the numbers of all rows end to end. Rows come
    a partition at a time and go straight to their place, so that the driver holds one copy.
    """
    limit = FIT_BYTES if limit is None else limit
    made = stored(features, "fit-features")
    head = made.select("order", "y", F.octet_length("idx").cast("long").alias("n")).toArrow().sort_by([("order", "ascending"), ("y", "ascending")])
    order, y, n = (head.column(c).to_numpy() for c in ("order", "y", "n"))
    fits = int(np.searchsorted(np.cumsum(n), limit, side="right"))
    if fits < len(n):
        made = made.where(F.col("order") < int(order[fits]))
        fits = int(np.searchsorted(order, order[fits]))
    sizes = n[:fits] // np.dtype(columns["idx"]).itemsize
    stop = np.cumsum(sizes)
    out = {c: np.empty(int(stop[-1]) if fits else 0, kind) for c, kind in columns.items()}
    place = {key: i for i, key in enumerate(zip(order[:fits].tolist(), y[:fits].tolist(), strict=True))}
    for row in made.select("order", "y", *columns).toLocalIterator():
        i = place[row[0], row[1]]
        for c, kind in columns.items():
            out[c][stop[i] - sizes[i] : stop[i]] = np.frombuffer(row[c], kind)
    return y[:fits], sizes, out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def pieces(off: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text; a longer text is a piece of its own, whole."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
