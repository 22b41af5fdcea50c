"""Language identification by multilingual mixture inference."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, fold, pieces, text_buffers, worker_cache
from .textfeat import Piece, long_parts, lowered, mix, segment_sum

#: Documents of each language that the models are fitted on, about; hash buckets of the n-grams.
FIT_DOCS, BUCKETS = 3000, 1 << 16
#: Bytes of the model at most: with many languages its buckets are halved until it fits.
MODEL_BYTES = 64 << 20
#: EM rounds by language set, and the price of each further language: PRICE * ln(words) of log-likelihood.
ROUNDS, PRICE = 6, 3.0
#: n-gram lengths in bytes, with the space before and after the word.
ORDERS = (2, 3, 4)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _piece(raw: np.ndarray, off: np.ndarray) -> Piece:
    raw, off = raw[off[0] : off[-1]], off - off[0]
    return Piece(lowered(np.where(_LETTER[raw], raw, np.uint8(32))), off)


def _grams(p: Piece, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: bucket of the n-gram that begins at each byte (0: a space before the piece), and the range of each
    word's n-grams. They lie in the word and one space on each side, so nothing depends on what stands around it.
    """
    values = np.concatenate((np.full(1, 32, np.uint64), p.data.astype(np.uint64)))
    values[values == 10] = 32
    for n in ORDERS:
        h = np.zeros(len(values), np.uint64)
        for k in range(n):
            h[: len(values) - k] |= values[k:] << np.uint64(8 * k)
        yield (mix(h + np.uint64(n)) >> np.uint64(65 - buckets.bit_length())).astype(np.int64), p.ws, np.maximum(p.we + 3 - n, p.ws)


def buckets_for(langs: int) -> int:
    """Buckets a language has, a power of two, so that the model is at most ``MODEL_BYTES``."""
    n = BUCKETS
    while n > 256 and n * langs * len(ORDERS) * 4 > MODEL_BYTES:
        n //= 2
    return n


class Words:
    """In place of the piece of one long text: how many words it has."""

    def __init__(self, words: int):
        self.n, self.words = 1, np.array([words])


@dataclass
class Model:
    langs: list[str]
    log: np.ndarray  # (order, bucket, language): log-probability

    def words(self, p: Piece) -> np.ndarray:
        """Log-likelihood of each word by language: the mean over orders of the sum over its n-grams."""
        total = np.zeros((len(p.ws), len(self.langs)))
        for k, (at, begin, stop) in enumerate(_grams(p, self.log.shape[1])):
            for x in range(len(self.langs)):
                run = np.zeros(len(at) + 1)
                np.cumsum(self.log[k, :, x][at], out=run[1:])
                total[:, x] += run[stop] - run[begin]
        return total / len(ORDERS)

    def infer(self, p: Piece, ll: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of the languages by text (0 outside the chosen set), and which are in the set.

        EM over the words: the share of each language in a word by its likelihood and the text's proportions, then
        the proportions as mean shares. A text starts with the one language of the greatest likelihood; further
        languages (by their proportion under all of them) are tried, and stay while the gain in log-likelihood
        exceeds ``PRICE`` * ln(words) each.
        """
        ll = self.words(p) if ll is None else ll
        m = len(self.langs)
        full = p.words > 0
        top = ll.max(axis=1, keepdims=True) if len(ll) else np.zeros((0, 1))
        like = np.exp(ll - top)
        best = segment_sum(ll, p.words)
        order1 = best.argmax(axis=1) if m else np.zeros(p.n, int)
        chosen = np.zeros((p.n, m))
        chosen[np.arange(p.n), order1] = full
        value = np.where(full, best[np.arange(p.n), order1] if m else 0, 0)
        base = segment_sum(top[:, 0], p.words)
        price = PRICE * np.log(np.maximum(p.words, 2))
        # no mixture is likelier than every word in its best language: where that gains too little, one language stays
        growing = full & (base - value > price)
        some = np.flatnonzero(growing)
        share, rank = np.zeros((p.n, m)), np.zeros((p.n, m), np.int64)
        if len(some):
            share[some] = self._em(like[np.repeat(growing, p.words)], p, np.full((p.n, m), 1.0 / m), ROUNDS, some)[0]
            rank[some] = np.argsort(-share[some], axis=1, kind="stable")
        for k in range(2, m + 1):
            rows = np.flatnonzero(growing)
            if not len(rows):
                break
            start = np.zeros((p.n, m))
            for r in range(k):
                start[rows, rank[rows, r]] = share[rows, rank[rows, r]] + 1e-3
            start[rows] /= start[rows].sum(axis=1, keepdims=True)
            keep = np.repeat(growing, p.words)
            mixed, gain = self._em(like[keep], p, start, 3, rows)
            better = gain + base[rows] > value[rows] + price[rows]
            chosen[rows[better]], value[rows[better]] = mixed[better], gain[better] + base[rows][better]
            growing[rows[~better]] = False
        return chosen, chosen > 0

    def _em(self, like: np.ndarray, p: Piece, share: np.ndarray, rounds: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(p.n) if rows is None else rows
        sizes, share = p.words[rows], share[rows]
        doc = np.repeat(np.arange(len(rows)), sizes)
        for _ in range(rounds):
            r = like * share[doc]
            whole = r.sum(axis=1) + 1e-300
            r /= whole[:, None]
            share = segment_sum(r, sizes) / np.maximum(sizes, 1)[:, None]
        whole = (like * share[doc]).sum(axis=1) + 1e-300
        return share, segment_sum(np.log(whole), sizes)


def fit(docs: DataFrame, per_language: int = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """n-gram models of every language, each from about ``per_language`` documents picked by a hash of the id."""
    spoken = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["n"] for r in spoken.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((len(ORDERS), BUCKETS, 0), np.float32))
    odds = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_language / counts[k])))])
    draw = F.pmod(F.xxhash64("id", F.lit("lang")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = spoken.where(draw < odds[F.col("lang")]).select("lang", "text").repartition(8)

    buckets = buckets_for(len(langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), len(ORDERS), buckets), np.int64)
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            names = batch.column(0).to_pylist()
            ranges = [r for i, j in pieces(off) for r in ([(i, j, off[i], off[j])] if off[j] - off[i] <= 2 * PIECE_BYTES else [(i, j, a, b) for a, b in long_parts(raw, off[i], off[j], PIECE_BYTES)])]
            for i, j, a, b in ranges:
                p = _piece(raw, np.array([a, *off[i + 1 : j], b]))
                lang = np.repeat([langs.index(x) for x in names[i:j]], p.words)
                for k, (at, begin, stop) in enumerate(_grams(p, buckets)):
                    for x in np.unique(lang):
                        own = lang == x
                        marks = np.bincount(begin[own], minlength=len(at) + 1) - np.bincount(stop[own], minlength=len(at) + 1)
                        total[x, k] += np.bincount(at[np.cumsum(marks[:-1]) > 0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array([t.tobytes() for t in total], pa.binary())], ["lang", "counts"])

    got = sample.mapInArrow(run, "lang string, counts binary").toLocalIterator()
    total = np.zeros((len(langs), len(ORDERS), buckets))
    for r in got:
        total[langs.index(r["lang"])] += np.frombuffer(r["counts"], np.int64).reshape(len(ORDERS), buckets)
    log = np.log((total + 0.05) / (total.sum(axis=2, keepdims=True) + 0.05 * buckets))
    return Model(langs, np.ascontiguousarray(log.transpose(1, 2, 0)).astype(np.float32))


def identify(docs: DataFrame, folds: int = 4, held: int = 2, per_language: int = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col``, held_out, lang_pred, score, langs, shares for every whole text.

    Rows whose crc32(id as text) mod ``folds`` is ``held`` are held out and not learnt from; the sample, the counts
    of languages and the table sizes are bounded, so the model is broadcast. lang_pred is the language of the
    greatest proportion in the set that the penalised likelihood chose, score that proportion; langs and shares give
    the whole set. ``und`` with score 0 if the text is null or has no letter (or nothing could be learnt).

    Ties go to the first language by name; repeated rows agree; an empty table gives an empty result; other columns
    are not read.
    """
    model = fit(docs.where(fold(id_col, folds) != held), per_language, id_col, text_col, lang_col)
    kind = dict(docs.dtypes)[id_col]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("langid")
        model = sent.value
        names = np.array([*model.langs, "und"], object)
        for batch in batches:
            raw, off = text_buffers(batch.column(3))
            spoken = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in pieces(off, PIECE):
                if off[j] - off[i] > 2 * PIECE:  # one long text: the likelihoods of its words, part by part
                    parts = [_piece(raw, np.array([a, b])) for a, b in long_parts(raw, off[i], off[j], PIECE)]
                    ll = np.concatenate([model.words(p) for p in parts])
                    share, used = model.infer(Words(len(ll)), ll)
                else:
                    share, used = model.infer(_piece(raw, off[i : j + 1]))
                known = spoken[i:j] & (used.any(axis=1) if len(model.langs) else False)
                first = np.where(known, share.argmax(axis=1) if len(model.langs) else 0, len(model.langs))
                score = np.where(known, share.max(axis=1) if len(model.langs) else 0.0, 0.0)
                sets = [[] if not k else [int(x) for x in np.argsort(-s, kind="stable") if s[x] > 0] for k, s in zip(known, share, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array(names[first].tolist(), pa.string()),
                        pa.array(np.clip(score, 0.0, 1.0)),
                        pa.array([[model.langs[x] for x in s] for s in sets], pa.list_(pa.string())),
                        pa.array([[float(v[x]) for x in s] for s, v in zip(sets, share, strict=True)], pa.list_(pa.float64())),
                    ],
                    [id_col, "held_out", "lang_pred", "score", "langs", "shares"],
                )

    out = F.coalesce(fold(id_col, folds) == held, F.lit(False)).alias("held_out")
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("spoken")
    return docs.select(F.col(id_col), out, letter, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, langs array<string>, shares array<double>")


PIECE = 1 << 19
