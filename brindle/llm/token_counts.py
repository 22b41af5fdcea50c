"""Token counts by a compiled finite-state tokenizer (see ``bpe_fst``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_fst import compiled
from .common import pieces, text_buffers

#: The largest batch of texts that the transducer runs at once.
RUN_BYTES = 1 << 20


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: ``id_col``, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``vocabulary`` is the path of a byte-level BPE file with word ends that every executor can open. A map without a
    shuffle; texts are handled in pieces of ``RUN_BYTES``, a longer one alone. Null and empty texts have 0 bytes and
    0 tokens; repeated rows, ties and null ids stay as they are; an empty table gives an empty result; other columns
    are not read, whatever their names.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(vocabulary)
        for batch in batches:
            text = batch.column(1)
            _, off = text_buffers(text)
            counts = [fst.counts(["" if t is None else t for t in text.slice(i, j - i).to_pylist()]) for i, j in pieces(off, RUN_BYTES)]
            n = np.concatenate([np.zeros(0, np.int64), *counts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
