"""A byte budget over streams of chunks, exact across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "stream string, seq long, n long, spent long, accepted boolean, is_exhausted boolean"
STATE = "spent long"
MOST = (1 << 63) - 1


def consume(limit: int):
    """The state function for one stream, chunks in order of ``seq``, with the rules of ``limits.budget``."""

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (spent,) = state.get if state.exists else (0,)
        rows = pd.concat(list(frames)).sort_values("seq")
        n = rows["n"].to_numpy()
        # sums stop at the greatest long instead of turning over
        total = [spent := min(MOST, spent + x) for x in n.tolist()]
        state.update((spent,))
        rows = rows.assign(stream=key[0], spent=total)
        yield rows.assign(accepted=(rows["spent"] <= limit) | (n == 0), is_exhausted=rows["spent"] >= limit)[["stream", "seq", "n", "spent", "accepted", "is_exhausted"]]

    return run


def budget_stream(chunks: DataFrame, limit: int) -> DataFrame:
    """``chunks`` (stream string, seq long, n long), a streaming frame, with the budget's state after each chunk.

    State is one field a stream; memory grows with the number of streams, not with their chunks.
    """
    return chunks.groupBy("stream").applyInPandasWithState(consume(limit), OUT, STATE, "append", GroupStateTimeout.NoTimeout)
