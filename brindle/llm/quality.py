"""Quality rules: fixed text rules, then a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_features, fit_sample, pieces, text_buffers, worker_cache
from .textfeat import HASH_BYTES, Piece, Rolling, mix, segment_sum

#: Labelled rows that the model is fitted on at most, and weights by feature family.
FIT_ROWS, BUCKETS = 3000, 1 << 16
#: Rejected below this calibrated probability of good quality.
KEEP_AT = 0.35
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: Feature families: (of words or of bytes, length).
FAMILIES = (("word", 1), ("word", 2), ("char", 3), ("char", 5))


def base_counts(p: Piece) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a piece."""
    out = {"n_words": p.words, "word_chars": p.total(~p.space & ((p.data & 0xC0) != 0x80)), "n_symbols": p.total(SYMBOLS[p.data])}
    # lines with a word that equal an earlier line of the text
    stop = np.flatnonzero(p.data == 10)
    begin = np.concatenate(([0], stop[:-1] + 1)) if len(stop) else stop
    text = np.searchsorted(p.end, begin)
    used = np.concatenate(([0], np.cumsum(~p.space)))
    real = used[stop] > used[begin]
    begin, stop, text = begin[real], stop[real], text[real]
    key = mix(p.slices(begin, stop) + mix(text.astype(np.uint64)))
    data = p.data.tobytes()
    dup = _later(key, lambda i, j: text[i] == text[j] and data[begin[i] : stop[i]] == data[begin[j] : stop[j]])
    out["n_dup_lines"] = np.bincount(text[dup], minlength=p.n)
    # words inside windows of 8 words that the text has twice or more
    covered = np.zeros(len(p.ws) + 1, np.int64)
    if len(p.ws) >= 8:
        windows = Rolling(p.word_hash, np.uint64(0xC2B2AE3D27D4EB4F)).windows(8)
        at = np.flatnonzero(p.doc[7:] == p.doc[: len(p.ws) - 7])
        key = mix(windows[at] + mix(p.doc[at].astype(np.uint64)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        hits = at[twice]
        if len(hits):
            hits = hits[_confirmed(p, hits, data)]
        np.add.at(covered, hits, 1)
        np.add.at(covered, hits + 8, -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(covered[:-1]) > 0)))
    out["n_repeat_words"] = inside[p.first[1:]] - inside[p.first[:-1]]
    return out


def _later(key: np.ndarray, equal) -> np.ndarray:
    """Items that equal an earlier one: of those with one key, compared with each different one before."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    same = np.concatenate(([False], key[order][1:] == key[order][:-1])) if len(key) else np.zeros(0, bool)
    leads: list[int] = []
    for k in np.flatnonzero(same):
        if not same[k - 1]:
            leads = [order[k - 1]]
        if any(equal(lead, order[k]) for lead in leads):
            out[order[k]] = True
        else:
            leads.append(order[k])
    return out


def _confirmed(p: Piece, hits: np.ndarray, data: bytes) -> np.ndarray:
    """Windows whose 8 words really occur twice in their text: the hashes only nominate them.

    Windows are compared by the bytes from their first word to their last where single spaces part the words, else
    word by word.
    """
    seen: dict[tuple, int] = {}
    keys = []
    for d, h in zip(p.doc[hits].tolist(), hits.tolist(), strict=True):
        key = (d, *data[p.ws[h] : p.we[h + 7]].split())
        if len(key) != 9:  # split() takes more bytes as white space than the contract does
            key = (d, *(data[a:b] for a, b in zip(p.ws[h : h + 8], p.we[h : h + 8], strict=True)))
        keys.append(key)
        seen[key] = seen.get(key, 0) + 1
    return np.fromiter((seen[k] > 1 for k in keys), bool, len(keys))


def features(p: Piece) -> Iterator[Iterator[tuple[np.ndarray, np.ndarray]]]:
    """For each family the (bucket of each n-gram, their number by text); a long text alone in its piece comes in parts."""
    for family, (kind, n) in enumerate(FAMILIES):
        if kind == "word":
            h, _, sizes = p.word_grams(n)
            parts = iter([(h, sizes)])
        elif p.n == 1 and len(p.data) > 2 * HASH_BYTES:
            parts = ((h, np.array([len(h)])) for h in p.char_parts(n))
        else:
            parts = iter([p.char_grams(n)])
        yield _buckets(parts, family * BUCKETS)


def _buckets(parts: Iterator[tuple[np.ndarray, np.ndarray]], base: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for h, sizes in parts:
        yield (h >> np.uint64(48)).astype(np.int32) + base, sizes


@dataclass
class Model:
    """Weights by bucket; the score is the sum over families of the mean weight, calibrated by slope and intercept."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    intercept: float = 0.0

    def raw(self, p: Piece) -> np.ndarray:
        total = np.full(p.n, self.bias)
        for parts in features(p):
            held, number = np.zeros(p.n), np.zeros(p.n, np.int64)
            for at, sizes in parts:
                held += segment_sum(self.weights[at], sizes)
                number += sizes
            total += held / np.maximum(number, 1)
        return total

    def probability(self, p: Piece) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(p) + self.intercept, -30, 30)))


def minimise(f, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with a backtracking line search; f gives value and gradient."""
    value, grad = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d = -grad
        alphas = []
        for s, y, rho in reversed(steps):
            a = rho * (s @ d)
            alphas.append(a)
            d -= a * y
        if steps:
            s, y, _ = steps[-1]
            d *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(steps, reversed(alphas), strict=True):
            d += (a - rho * (y @ d)) * s
        t, slope = (1.0 if steps else 1.0 / max(1e-9, np.abs(grad).sum())), grad @ d
        for _ in range(25):
            new, new_grad = f(x + t * d)
            if new <= value + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = t * d, new_grad - grad
        x, done = x + s, value - new < 1e-7 * max(1.0, abs(value))
        value, grad = new, new_grad
        if s @ y > 1e-12:
            steps = [*steps[-memory + 1 :], (s, y, 1 / (s @ y))]
        if done:
            break
    return x


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on ``rows`` labelled documents at most (those with the least hash of the id), a fifth of them to calibrate.

    The features of the sample are made on the executors and brought to the driver: ``rows`` and ``FIT_BYTES`` bound
    them. Without both labels the model keeps everything.
    """
    sample = fit_sample(docs, labels, label_col, rows, "fit", id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column(2))
            for i, j in pieces(off):
                p = Piece(raw, off[i : j + 1])
                cells: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(p.n)]
                for parts in features(p):
                    if p.n == 1:
                        held = sum((np.bincount(at, minlength=len(FAMILIES) * BUCKETS) for at, _ in parts), np.zeros(len(FAMILIES) * BUCKETS, np.int64))
                        u = np.flatnonzero(held)
                        cells[0].append((u.astype(np.int32), (held[u] / held.sum()).astype(np.float32)))
                        continue
                    ((at, sizes),) = parts
                    stop = np.cumsum(sizes)
                    for d in np.flatnonzero(sizes):
                        u, c = np.unique(at[stop[d] - sizes[d] : stop[d]], return_counts=True)
                        cells[d].append((u.astype(np.int32), (c / sizes[d]).astype(np.float32)))
                idx = [np.concatenate([np.zeros(0, np.int32), *(u for u, _ in c)]).tobytes() for c in cells]
                val = [np.concatenate([np.zeros(0, np.float32), *(v for _, v in c)]).tobytes() for c in cells]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], ["y", "order", "idx", "val"])

    y, sizes, got = fit_features(sample.mapInArrow(run, "y int, order long, idx binary, val binary"), idx=np.int32, val=np.float32)
    y = y.astype(np.float64)
    size = len(FAMILIES) * BUCKETS
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(size, np.float32), 20.0)
    at, v = got["idx"], got["val"]
    hold = np.arange(len(y)) % 5 == 4
    edge = np.concatenate(([0], np.cumsum(sizes)))
    parts = [(i, min(i + 200, len(y))) for i in range(0, len(y), 200)]  # bounds the arrays made in a pass
    learn = int((~hold).sum())

    def scores(x: np.ndarray) -> np.ndarray:
        return np.concatenate([segment_sum(x[at[edge[i] : edge[j]]] * v[edge[i] : edge[j]], sizes[i:j]) for i, j in parts])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = scores(x) + x[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        reg = 2e-5
        value = float(np.logaddexp(0, -z * (2 * y - 1))[~hold].sum() / learn + reg * 0.5 * (x[:-1] @ x[:-1]))
        r = np.where(hold, 0, p - y) / learn
        grad = np.zeros(size + 1)
        for i, j in parts:
            grad += np.bincount(at[edge[i] : edge[j]], np.repeat(r[i:j], sizes[i:j]) * v[edge[i] : edge[j]], minlength=size + 1)
        grad[:-1] += reg * x[:-1]
        grad[-1] = r.sum()
        return value, grad

    x = minimise(loss, np.zeros(size + 1), 25)
    model = Model(x[:-1].astype(np.float32), float(x[-1]))
    z = scores(x) + x[-1]
    model.slope, model.intercept = calibrate(z[hold], y[hold])
    return model


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and intercept, with smoothed targets, by Newton's method."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 1.0, 0.0
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w, r = p * (1 - p) + 1e-9, p - goal
        h = np.array([[w @ (z * z) + 1e-6, w @ z], [w @ z, w.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([r @ z + 1e-6 * (a - 1), r.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def quality_rules(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rule counts and verdict of every whole text.

    ``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality. base_failed:
    fewer than 20 words, or over 30 % of the words in repeated 8-word windows. kept: not base_failed, and the
    calibrated probability of good quality is ``keep_at`` or more. The model (1 MB) goes to the executors with the
    task and scores Arrow batches; only ``labels`` and text enter it.

    Null and empty texts have no words and fail; repeated rows are judged alike; an empty table gives an empty
    result; without labels of both kinds only the rules judge; other columns are not read.
    """
    return judge(docs, fit(docs, labels, rows, id_col, text_col), keep_at, id_col, text_col)


def judge(docs: DataFrame, model: Model, keep_at: float = KEEP_AT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``quality_rules`` by a model already fitted; ``id_col`` is only passed through."""
    kind = dict(docs.dtypes)[id_col]
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality")
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            for i, j in pieces(off):
                p = Piece(raw, off[i : j + 1])
                c = base_counts(p)
                failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
                quality = sent.value.probability(p)
                cols = [pa.array(np.asarray(c[k], np.int64)) for k in COUNTS]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *cols, pa.array(failed), pa.array(~failed & (quality >= keep_at)), pa.array(quality)], [id_col, *COUNTS, "base_failed", "kept", "quality"])

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, kept boolean, quality double"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def kept_rows(docs: DataFrame, model: Model, keep_at: float = KEEP_AT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``judge`` keeps: a map without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality")
        for batch in batches:
            raw, off = text_buffers(batch.column(at))
            for i, j in pieces(off):
                p = Piece(raw, off[i : j + 1])
                c = base_counts(p)
                good = (c["n_words"] >= 20) & (100 * c["n_repeat_words"] <= 30 * c["n_words"])
                yield batch.slice(i, j - i).filter(pa.array(good & (sent.value.probability(p) >= keep_at)))

    return docs.mapInArrow(run, docs.schema)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
