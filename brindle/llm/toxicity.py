"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, fit_features, fit_sample, fold, pieces, text_buffers, worker_cache
from .textfeat import Piece, long_parts

#: Labelled rows that the model is fitted on at most, bits of the hashed feature space.
FIT_ROWS, BITS = 10_000, 20
#: FTRL-proximal: step size, its smoothing, L1 (for 8000 rows; it grows with their root) and L2 strength, passes.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 20.0, 1.0, 3
#: (words in a row, words skipped between two).
GRAMS = ((1, 0), (2, 0), (2, 1), (2, 2))
LETTER = np.zeros(256, bool)
LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def letters_only(raw: np.ndarray) -> np.ndarray:
    """Bytes other than ASCII letters, digits and non-ASCII ones become spaces, so marks around a word don't hide it."""
    return np.where(LETTER[raw], raw, np.uint8(32))


def grams(p: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams and skip-grams, and their texts."""
    at, doc = [], []
    for n, skip in GRAMS:
        h, d, _ = p.word_grams(n, skip)
        at.append((h >> np.uint64(64 - BITS)).astype(np.int64))
        doc.append(d)
    return np.concatenate(at), np.concatenate(doc)


def parts_of(raw: np.ndarray) -> Iterator[Piece]:
    """A long text in pieces that share the words which a window can reach over."""
    raw = letters_only(raw)
    for a, b in long_parts(raw, 0, len(raw), PIECE_BYTES, max(n + skip for n, skip in GRAMS) - 1):
        yield Piece(raw[a:b], np.array([0, b - a]), lower=True)


class Weights:
    """The weights that L1 left, by bucket."""

    def __init__(self, dense: np.ndarray, bias: float):
        self.at = np.flatnonzero(dense).astype(np.int32)
        self.value, self.bias = dense[self.at].astype(np.float32), bias

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, np.float32)
        w[self.at] = self.value
        return w

    @staticmethod
    def hits(p: Piece, dense: np.ndarray) -> np.ndarray:
        """Cells (text, bucket) of the different n-grams that have a weight."""
        at, doc = grams(p)
        hit = np.flatnonzero(dense[at])
        return np.unique(doc[hit] << BITS | at[hit])

    @staticmethod
    def score(p: Piece, dense: np.ndarray, bias: float) -> np.ndarray:
        """Probability by text: each different n-gram counts once, and only those with a weight are looked at."""
        cell = Weights.hits(p, dense)
        z = bias + np.bincount(cell >> BITS, dense[cell & ((1 << BITS) - 1)], minlength=p.n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Weights:
    """FTRL-proximal over ``rows`` labelled documents at most, those with the least hash of the id.

    The caller leaves out the rows that must not be learnt from. Each different n-gram of a text is one binary
    feature. z and n are per coordinate, so frequent features slow down and rare ones keep learning; a weight is zero
    until |z| exceeds L1. The positive rows weigh as much as the negative ones up to a factor of 4. The sample goes
    to the driver as hashed features, bounded by ``rows`` and ``FIT_BYTES``.
    """
    sample = fit_sample(docs, labels, label_col, rows, "toxic", id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column(2))
            raw = letters_only(raw)
            for i, j in pieces(off):
                if off[j] - off[i] > 2 * PIECE_BYTES:
                    cell = np.unique(np.concatenate([np.unique(grams(p)[0]) for p in parts_of(raw[off[i] : off[j]])]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([cell.astype(np.int32).tobytes()], pa.binary())], ["y", "order", "idx"])
                    continue
                p = Piece(raw, off[i : j + 1], lower=True)
                at, doc = grams(p)
                cell = np.unique(doc << BITS | at)
                stop = np.searchsorted(cell, np.arange(1, p.n) << BITS)
                idx = [x.astype(np.int32).tobytes() for x in np.split(cell & ((1 << BITS) - 1), stop)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(idx, pa.binary())], ["y", "order", "idx"])

    y, sizes, got = fit_features(sample.mapInArrow(run, "y int, order long, idx binary"), idx=np.int32)
    if not len(y) or y.min() == y.max():
        return Weights(np.zeros(1 << BITS), -20.0 if not len(y) or not y.max() else 20.0)
    return ftrl(np.split(got["idx"], np.cumsum(sizes)[:-1]), y)


def ftrl(rows: list[np.ndarray], y: np.ndarray, alpha: float = ALPHA, l1: float = L1, l2: float = L2, passes: int = PASSES) -> Weights:
    """FTRL-proximal with binary features: a row is its features' buckets."""
    w, z, n = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS)
    l1 *= (len(y) / 8000) ** 0.5
    weight = min(4.0, (len(y) - y.sum()) / y.sum())
    bn = bz = bias = 0.0
    for _ in range(passes):
        for at, goal in zip(rows, y.tolist(), strict=True):
            za, na = z[at], n[at]
            active = np.abs(za) > l1
            wa = np.where(active, (np.sign(za) * l1 - za) / ((BETA + np.sqrt(na)) / alpha + l2), 0.0)
            bias = -bz / ((BETA + np.sqrt(bn)) / alpha)
            g = 1 / (1 + np.exp(-min(30.0, max(-30.0, wa.sum() + bias)))) - goal
            g *= weight if goal else 1.0
            if abs(g) < 1e-4:
                continue
            sigma = (np.sqrt(na + g * g) - np.sqrt(na)) / alpha
            z[at], n[at] = za + g - sigma * wa, na + g * g
            bz += g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / alpha * bias
            bn += g * g
    active = np.abs(z) > l1
    w[active] = (np.sign(z[active]) * l1 - z[active]) / ((BETA + np.sqrt(n[active])) / alpha + l2)
    return Weights(w, float(bias))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, score, predicted for every whole text.

    Rows whose crc32(id as text) mod ``folds`` is 0 are held out: neither they nor their labels are learnt from.
    Texts enter in lower case as runs of letters and digits; nothing but the text enters the score. The model is the
    sparse list of weights that L1 left, broadcast to the executors.

    Null and empty texts get the score of no features (the bias); repeated rows score alike; an empty table gives an
    empty result; with one kind of label only the score is constant; other columns are not read.
    """
    learn = docs.where(fold(id_col, folds) != 0)
    model = fit(learn, labels.where(fold(id_col, folds) != 0), rows, id_col, text_col)
    kind = dict(docs.dtypes)[id_col]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        dense, bias = sent.value.dense(), sent.value.bias
        for batch in batches:
            raw, off = text_buffers(batch.column(2))
            for i, j in pieces(off):
                if off[j] - off[i] > 2 * PIECE_BYTES:  # one long text
                    cells = [Weights.hits(p, dense) for p in parts_of(raw[off[i] : off[j]])]
                    z = bias + dense[np.unique(np.concatenate(cells))].sum(dtype=np.float64)
                    score = np.array([1 / (1 + np.exp(-np.clip(z, -30, 30)))])
                else:
                    p = Piece(letters_only(raw[off[i] : off[j]]), off[i : j + 1] - off[i], lower=True)
                    score = Weights.score(p, dense, bias)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    held = F.coalesce(fold(id_col, folds) == 0, F.lit(False)).alias("held_out")
    return docs.select(F.col(id_col), held, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
