"""Near duplicates by SimHash fingerprints and anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, by_shuffle, join_hot, pieces, stored, text_buffers, worker_cache
from .components import components
from .textfeat import Piece, long_parts

LINK_BITS = 2
#: Fingerprints a task sends to their anchors, about.
NODES_A_TASK = 50_000
#: Generator polynomial of the binary Golay code.
GOLAY = 0b101011100011


def fingerprint_of(raw: bytes, shingle: int = 3) -> int:
    """Of one text, word by word: the plain rule that the batch kernel repeats."""
    words = [w for w in raw.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)), b"").replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    return _majority(np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], np.uint64))


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return ones


def _bits(ones: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _majority(h: np.ndarray) -> int:
    return _bits(_ones(h), len(h))


def _hashes(p: Piece, shingle: int, whole: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(text, hashes of its shingles) of a piece; with ``whole`` a text of fewer words is one shingle."""
    digest = xxhash.xxh64_intdigest
    upper = (p.data >= 65) & (p.data <= 90)
    data = p.data + (upper * np.uint8(32))
    # one space between words, whatever was there: words keep their order, so their places follow
    size = p.we - p.ws
    joined = np.full(int(size.sum() + len(size)), 32, np.uint8)
    begin = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    keep = np.ones(len(joined), bool)
    keep[begin + size] = False
    joined[keep] = data[~p.space]
    flat, a, b = joined.tobytes(), begin.tolist(), (begin + size).tolist()
    for d in np.flatnonzero(p.words if whole else p.words >= shingle):
        x, y = int(p.first[d]), int(p.first[d + 1])
        last = max(x + 1, y - shingle + 1)
        ends = b[x + shingle - 1 : y] or [b[y - 1]]
        yield d, np.array([digest(flat[s:e], 42) for s, e in zip(a[x:last], ends, strict=True)], np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, fp (long, the 64 bits) of every whole text; null or without a word: 0."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            out = np.zeros(len(off) - 1, np.uint64)
            for i, j in pieces(off):
                if off[j] - off[i] > 2 * PIECE_BYTES:  # one long text: votes are added up over its parts
                    ones, n = np.zeros(64, np.int64), 0
                    for a, b in long_parts(raw, off[i], off[j], PIECE_BYTES, shingle - 1):
                        for _, h in _hashes(Piece(raw, np.array([a, b])), shingle, whole=False):
                            ones, n = ones + _ones(h), n + len(h)
                    if n:
                        out[i] = _bits(ones, n)
                        continue
                for d, h in _hashes(Piece(raw, off[i : j + 1]), shingle):
                    out[i + d] = _majority(h)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], [id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, fp long")


class Cover:
    """The covering code: the product of two binary Golay codes [23,12], a Hamming code [15,11] and a repetition
    code [3,1], on 23 + 23 + 15 + 3 = 64 bits.

    Each part is perfect: every word has one codeword within the part's radius (3, 3, 1, 1), so the product has one
    nearest anchor a fingerprint, and 2 ** 36 anchors in all. If two fingerprints differ in t bits, and a is the
    anchor of one, then the other is within radius + d of a in each part, with the d of the parts adding up to t at
    most. A fingerprint is therefore sent to the anchors within (radius + d) by part with d up to the threshold, and
    compared there with the fingerprints whose nearest anchor it is: no pair is missed. Codewords at a given
    distance of a word are found through its syndrome: they are the word plus the patterns of that weight and
    syndrome. Of a pair with different anchors both meetings would show it; only that at the lesser anchor is kept.
    """

    PARTS = ((23, "golay", 3), (23, "golay", 3), (15, "hamming", 1), (3, "repetition", 1))

    def __init__(self, threshold: int = LINK_BITS):
        if threshold > 2:
            raise ValueError("the anchors are laid out for thresholds up to 2")
        self.threshold = threshold
        self.parts, shift = [], 0
        for size, name, radius in self.PARTS:
            checks = self.checks(name, size)
            self.parts.append((shift, size, checks, self._patterns(size, checks, radius, threshold)))
            shift += size

    @staticmethod
    def checks(name: str, size: int) -> np.ndarray:
        """Syndrome of each single bit."""
        if name == "hamming":
            return np.arange(1, size + 1)
        if name == "repetition":
            return np.array([1, 2, 3])
        out, x = [], 1  # powers of the root of the generator polynomial
        for _ in range(size):
            out.append(x)
            x <<= 1
            if x >> 11:
                x ^= GOLAY
        return np.array(out)

    @staticmethod
    def _patterns(size: int, checks: np.ndarray, radius: int, more: int) -> list[dict[int, np.ndarray]]:
        """By extra distance 0..more: syndrome -> error patterns. Weight 0..radius for 0, radius + d for d."""
        from itertools import combinations

        out = []
        for d in range(more + 1):
            found: dict[int, list[int]] = {}
            for weight in range(radius + 1) if d == 0 else [radius + d]:
                for bits in combinations(range(size), weight):
                    s = e = 0
                    for b in bits:
                        s ^= int(checks[b])
                        e |= 1 << b
                    found.setdefault(s, []).append(e)
            out.append({s: np.array(e, np.uint64) for s, e in found.items()})
        return out

    def syndrome(self, fp: int) -> tuple[int, ...]:
        out = []
        for shift, size, checks, _ in self.parts:
            word, s = fp >> shift & ((1 << size) - 1), 0
            while word:
                low = word & -word
                s ^= int(checks[low.bit_length() - 1])
                word ^= low
            out.append(s)
        return tuple(out)

    def _near(self, syndrome: tuple[int, ...]) -> tuple[int, np.ndarray]:
        """XOR masks from a word with this syndrome to its nearest anchor, and from that one to the others in reach."""
        none = np.zeros(0, np.uint64)
        home, rel = 0, []
        for s, (shift, _, _, patterns) in zip(syndrome, self.parts, strict=True):
            lead = int(patterns[0][s][0])
            home |= lead << shift
            rel.append([(patterns[d].get(s, none) ^ np.uint64(lead)) << np.uint64(shift) for d in range(1, self.threshold + 1)])
        out = [r for part in rel for r in part]
        if self.threshold > 1:
            out += [(rel[i][0][:, None] ^ rel[j][0][None, :]).ravel() for i in range(len(rel)) for j in range(i)]
        return home, np.concatenate([none, *out])

    def reach(self, fp: int) -> tuple[int, np.ndarray]:
        """The nearest anchor, and the other anchors that the fingerprint is sent to."""
        home, rel = self._near(self.syndrome(fp))
        return fp ^ home, np.uint64(fp ^ home) ^ rel


def anchors(nodes: DataFrame, threshold: int, visits: bool) -> DataFrame:
    """(anchor, fp): each fingerprint at its nearest anchor; with ``visits`` at all anchors in reach that are not greater."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = worker_cache(("cover", threshold), lambda: Cover(threshold))
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                found = []
                for fp in part.tolist():
                    home, others = code.reach(fp)
                    found.append(np.append(others[others < np.uint64(home)], np.uint64(home)) if visits else np.array([home], np.uint64))
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(part, sizes).view(np.int64))], ["anchor", "fp"])

    return nodes.select("fp").mapInArrow(run, "anchor long, fp long")


def links(nodes: DataFrame, threshold: int = LINK_BITS) -> DataFrame:
    """(x, y): all pairs of different fingerprints that differ in at most ``threshold`` bits, compared by anchor."""
    home = anchors(nodes, threshold, False).select("anchor", F.col("fp").alias("x"))
    visit = anchors(nodes, threshold, True).select("anchor", F.col("fp").alias("y"))
    differ = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    met = home.join(by_shuffle(visit), "anchor").where((differ <= threshold) & (differ > 0))
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, threshold: int = LINK_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, fingerprint (16 hex digits), component_id: the smallest id reachable over linked fingerprints.

    A node is a fingerprint, named by its smallest id (null last) and itself, so null and repeated ids neither part nor
    join anything. Null ids never are the smallest: component_id is null only where no row of the component has an id.

    Equal fingerprints are one node (combined before the shuffle), so copies are never paired; between different
    ones every link is found (``Cover``). Null, empty and blank texts have fingerprint 0 and are linked like any
    other; texts of fewer words than a shingle are one shingle; repeated rows share a component; an empty table
    gives an empty result; other columns are not read. A fingerprint of very many rows is joined back by broadcast.
    """
    rows = stored(fingerprints(docs, shingle, id_col, text_col), "simhash")
    nodes = rows.groupBy("fp").agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("held"))
    nodes = stored(nodes.select("fp", "held", F.struct(F.col("id").isNull().alias("no"), "id", "fp").alias("node")), "simhash-nodes")
    total = rows.count()
    # a fingerprint becomes about 80 rows, so a few rows of the small table are work for a task
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // NODES_A_TASK)
    pairs = stored(links(nodes.select("fp").repartition(parts, "fp"), threshold), "simhash-links")
    end = lambda fp, node: by_shuffle(nodes.select(F.col("fp").alias(fp), F.col("node").alias(node)))
    edges = pairs.join(end("x", "a"), "x").join(end("y", "b"), "y").select("a", "b")
    found = components(edges).select(F.col("node.fp").alias("fp"), "component")
    named = nodes.join(by_shuffle(found), "fp", "left").select("fp", "held", F.coalesce("component", "node")["id"].alias("component_id"))
    out = join_hot(rows, stored(named, "simhash-named"), ["fp"], "held", total)
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
