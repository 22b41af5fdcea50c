"""Mixture-controlled packing of token sequences by deficit round-robin over source queues."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .bpe_fst import compiled
from .common import by_shuffle, new_folder, pieces, shared_dir, text_buffers
from .prefix import offsets, running_sum

#: Sequences in a window, and rows a block of a queue has about.
WINDOW_SEQUENCES, BLOCK_ROWS = 64, 1500


def token_ids(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, source, n_tokens, ids (little-endian unsigned 16 bit) of each whole text with ``end_id`` after it; null: empty."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(vocabulary)
        for batch in batches:
            text = batch.column(2)
            _, off = text_buffers(text)
            for i, j in pieces(off):
                got, n = fst.ids(["" if t is None else t for t in text.slice(i, j - i).to_pylist()])
                stop = np.cumsum(n)
                raw = np.insert(got, stop, end_id).astype("<u2")
                at = np.concatenate(([0], 2 * (stop + np.arange(1, len(n) + 1)))).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n + 1), ids], ["id", "source", "n_tokens", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, source string, n_tokens long, ids binary")


def queues(rows: DataFrame, targets: Mapping[str | None, float] | None) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``queue``, and (queue, held, weight): each source is a queue; with ``targets`` each named one, and
    the others together one that gets the weight left to 1.
    """
    if targets is None:
        rows = rows.withColumn("queue", F.col("source"))
        sums = rows.groupBy("queue").agg(F.sum("n_tokens").alias("held"))
        return rows, sums.withColumn("weight", F.col("held").cast("double"))
    if min(targets.values(), default=1.0) <= 0 or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("target proportions are positive and add up to 1 at most")
    name = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(k)) for k, s in enumerate(targets)], F.lit(len(targets)))
    rows = rows.withColumn("queue", name)
    left = max(0.0, 1.0 - sum(targets.values()))
    weight = F.get(F.array(*[F.lit(float(w)) for w in (*targets.values(), left)]), F.col("queue"))
    sums = rows.groupBy("queue").agg(F.sum("n_tokens").alias("held")).withColumn("weight", weight)
    # others without a weight wait for the named ones: a weight so small that they are served at the end
    return rows, sums.withColumn("weight", F.when(F.col("weight") > 1e-9, F.col("weight")).otherwise(1e-9))


def schedule(rows: DataFrame, window_tokens: int, targets: Mapping[str | None, float] | None = None) -> DataFrame:
    """row, window, first: where each document begins in the packed stream of all tokens.

    ``rows`` has row, id, source, n_tokens. Deficit round-robin gives each queue, in every window, a quantum of
    ``window_tokens`` in proportion to its weight among the queues that still hold something. A document leaves its
    queue when the quanta so far cover it; what a quantum leaves over is carried to the next window. So after any
    window a queue is behind its quanta by less than one document. That has a closed form: measured in service for
    each unit of weight, a document is due at t = (sum of its queue up to its end) / weight, a queue runs dry at
    held / weight, and all queues together have had V(t) = sum of min(held, weight * t) tokens by then, which tells
    the window. Without ``targets`` the weights are the queues' own tokens and all run dry together, at t = 1.

    The sums of a queue come from its blocks (``prefix``), so deficits are carried across windows and partitions with
    no pass over a queue in one task. In a window the queues follow each other; windows are laid end to end.
    """
    blocks = max(1, rows.count() // BLOCK_ROWS)
    deal = F.xxhash64("id", "row")
    rows, sums = queues(rows, targets)
    queued = rows.select("row", "queue", "n_tokens", deal.alias("deal"), F.pmod(deal, F.lit(blocks)).alias("block"))
    queued = running_sum(queued, ["queue"], "block", ["deal", "row"], "n_tokens", "upto")
    queued = queued.alias("q").join(sums.alias("s"), F.col("q.queue").eqNullSafe(F.col("s.queue"))).select("q.*", "held", "weight")
    total = rows.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    windows = max(1, -(-total // window_tokens))
    if targets is None:
        wide = F.col("upto").cast("decimal(18,0)") * F.lit(windows).cast("decimal(18,0)")
        window = F.ceil(wide / F.col("held").cast("decimal(18,0)"))
    else:  # as many queues as the caller names, and one
        t = F.col("upto") / F.col("weight")
        served = sum((F.least(F.lit(float(x["held"])), F.lit(float(x["weight"])) * t) for x in sums.collect()), F.lit(0.0))
        window = F.ceil(served / F.lit(float(window_tokens)))
    queued = queued.withColumn("window", F.least(F.greatest(window, F.lit(1)), F.lit(windows)).cast("long"))
    inside = Window.partitionBy("window").orderBy(F.col("queue").asc_nulls_last(), "upto", "row").rowsBetween(Window.unboundedPreceding, 0)
    sizes = queued.groupBy("window").agg(F.sum("n_tokens").alias("size")).withColumn("all", F.lit(0))
    before = offsets(sizes, ["all"], "window", "size", "before").drop("all")
    first = F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens")
    return queued.join(before, "window").select("row", "window", first.cast("long").alias("first"))


def pack(docs: DataFrame, vocabulary: str, length: int = 4096, end_id: int = 2, window_sequences: int = WINDOW_SEQUENCES, targets: Mapping[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens (a power of two): one row a piece.

    ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset, and source and window. The stream of
    ``schedule`` is cut every ``length`` tokens; its rest is cut into descending powers of two, which need no
    padding, so no token of padding is left. Each token lies in one piece, and a sequence is gapless from 0.

    ``targets`` gives sources the proportion of the tokens that they have in every window while they last; sources
    that it does not name share what is left to 1, or come last if nothing is. When a queue runs dry, the others
    share its place by their weights, so all tokens are packed. Without ``targets`` each source has its own share of
    all tokens.

    Tokens are made once and stored, with a row number, in the shared folder; the schedule reads only their counts.
    Null and empty texts are the end token alone; repeated rows are packed each; a null source is a source; an empty
    table gives no pieces; other columns are not read.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    path = new_folder(spark, "pack-tokens")
    shared_dir(spark)
    made = token_ids(docs, vocabulary, end_id, id_col, source_col, text_col).withColumn("row", F.monotonically_increasing_id())
    made.write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema(made.schema).parquet(path)
    rows = tokens.select("row", "id", "source", "n_tokens")
    total = rows.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    placed = schedule(rows, length * window_sequences, targets)
    full = total // length
    rest, cuts = total % length, []
    for b in range(length.bit_length() - 1, -1, -1):
        if rest >> b & 1:
            cuts.append((cuts[-1] if cuts else full * length) + (1 << b))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([full * length, *cuts], np.int64)
        for batch in batches:
            columns: list[list] = [[] for _ in range(9)]
            for doc, source, window, first, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                at, n = 0, len(ids)
                while at < n:
                    where = first + at
                    if where < edges[0]:
                        sequence, offset = divmod(where, length)
                        stop = min(n, at + length - offset)
                    else:
                        k = int(np.searchsorted(edges, where, side="right")) - 1
                        sequence, offset = full + k, where - int(edges[k])
                        stop = min(n, at + int(edges[k + 1]) - where)
                    for c, x in zip(columns, (doc, at, stop - at, zlib.crc32(ids[at:stop].tobytes()), n, sequence, offset, source, window), strict=True):
                        c.append(x)
                    at = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "window"]
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, window long"
    kinds = [f.type for f in to_arrow_schema(_parse_datatype_string(schema))]
    joined = tokens.select("row", "id", "source", "ids").join(by_shuffle(placed), "row").select("id", "source", "window", "first", "ids")
    return joined.mapInArrow(cut, schema)
