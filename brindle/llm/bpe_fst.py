"""A byte-pair vocabulary compiled to a deterministic finite-state transducer.

Greedy merging looks unbounded, but the tokens of a prefix follow from a
finite summary of it. Write e(i) for the last token of the prefix of length i.
A token t that ends at i is e(i) exactly if the pair (e(i - |t|), t) survives
merging when joined, and there is one such t. So what the past can still
change is: the positions k whose rest p[k:i] begins some longer token, with
e(k) and the number of tokens since k. That summary is a state. A transition
reads one byte and carries the change in the number of tokens (and the new
last token); the END symbol closes a word with its word-end token.

States and transitions are made when first met (lazy determinisation) and kept
in dense tables, so that numpy runs many chunks of text in lockstep. Chunks
are cut anywhere, and each has a map from entry state to exit state. A chunk
that holds a word boundary has a constant map. Of others, which lie inside long
words, the map is tabulated for the entries that can occur: the start state
and the exits of the chunk before. The maps of all chunks are composed by a
parallel prefix scan (doubling), which gives every chunk its entry; where an
exit meets no tabulated entry, the tables grow by it and the scan is repeated.
As states forget what lies far behind, that is seldom more than once. Then all
heads and inner chunks are run at once from their entries.

Splitting a text into words (Unicode letters, numbers, other runs, English
contractions) is done before, by tables over code points; rare texts that such
tables can't split surely (characters that combine or change length in lower
case, special strings) are split with the same rules by a regular expression.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex

from .common import worker_cache

CHUNK = 192
#: Above so many states the tables are dropped and made anew, as lazy automata do; a run stops at a quarter more, so
#: that the tables, which double, stay below 2 ** 18 states (150 MB).
MOST_STATES = 200_000
#: Verdicts on pairs of tokens that are kept at most.
MOST_FITS = 300_000
#: Bytes that run at once, and characters of a text that are split at once; both end at white space or a word's end.
SEGMENT, PART = 1 << 20, 1 << 20
DEAD, START = 0, 1

#: The pre-tokenizer's pattern of the vocabulary file.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACES = regex.compile(r"\s")
TAILS = ("s", "t", "m", "d", "re", "ve", "ll")
SPACE, LETTER, NUMBER, OTHER, ODD, UNSEEN = 0, 1, 2, 3, 4, 5


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest is shifted above 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


#: In place of a last token at the beginning of a word.
NONE = (1 << 24) - 1


def packed(tail: bytes, live: list[tuple[int, int, int]]) -> bytes:
    """A state's summary as bytes: there are many, so they are kept small."""
    return bytes((len(live),)) + b"".join((e << 16 | since + 128 << 8 | size).to_bytes(5, "little") for e, since, size in live) + tail


def unpacked(key: bytes) -> tuple[bytes, list[tuple[int, int, int]]]:
    n = key[0]
    cells = [int.from_bytes(key[1 + 5 * i : 6 + 5 * i], "little") for i in range(n)]
    return key[1 + 5 * n :], [(c >> 16, (c >> 8 & 255) - 128, c & 255) for c in cells]


class Full(Exception):
    """The tables have outgrown ``MOST_STATES`` by a quarter within a run."""


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        back = {c: b for b, c in byte_letters().items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.merged: dict[tuple[int, int], int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        for a, b in model["merges"]:
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merged[x, y], self.left[z], self.right[z] = z, x, y
        if max(vocab.values()) > 0xFFFF:
            raise ValueError("the tables hold token ids of 16 bits")
        self.inner: dict[bytes, int] = {}
        self.closing: dict[bytes, int] = {}
        self.begins: set[bytes] = set()
        self.length = np.zeros(max(vocab.values()) + 1, np.uint8)
        for t, i in vocab.items():
            closes = t.endswith(end)
            body = bytes(back[c] for c in (t[: -len(end)] if closes else t))
            if len(body) > 0xFF:
                raise ValueError("the tables hold token lengths of 8 bits")
            (self.closing if closes else self.inner)[body] = i
            self.length[i] = len(body)
            self.begins.update(body[:k] for k in range(1, len(body) + closes))
        self.strict = True
        self.kind = np.full(0x110000, UNSEEN, np.uint8)
        self.low = np.arange(0x110000, dtype=np.uint32)
        self._empty()

    def _empty(self) -> None:
        self.fits: dict[int, bool] = {}
        self.key: list[bytes] = [b"", packed(b"", [(NONE, 0, 0)])]
        self.known = {self.key[START]: START}
        self.width = 96
        self.klass = np.full(256, -1, np.int16)
        self.byte: list[int] = [0]
        self.klass[0] = 0  # stands for white space between words
        self.next = np.full((1024, self.width), -1, np.int32)  # state << 8 | (tokens + 128)
        self.last = np.zeros((1024, self.width), np.uint16)
        self.end_out = np.zeros(1024, np.int8)
        self.end_last = np.zeros(1024, np.uint16)
        self.next[DEAD] = DEAD << 8 | 128
        self.next[START, 0] = START << 8 | 128

    # -- compilation ---------------------------------------------------

    def survives(self, a: int, b: int) -> bool:
        """Whether token a followed by token b stays so when their bytes are merged anew."""
        known = self.fits.get(a << 20 | b)
        if known is None:
            if len(self.fits) >= MOST_FITS:
                self.fits.clear()
            known = self.fits[a << 20 | b] = self._survives(a, b)
        return known

    def _survives(self, a: int, b: int) -> bool:
        limit = 1 << 30
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < limit:
                return False
            undo_left = a > b
            for _ in range(2):  # undo the younger merge; if that side is a byte, the other
                if undo_left:
                    limit, part = a, self.right.get(a)
                    if part is not None:
                        a = part
                        break
                else:
                    limit, part = b + 1, self.left.get(b)
                    if part is not None:
                        b = part
                        break
                undo_left = not undo_left
            else:
                return True

    def _state(self, tail: bytes, live: list[tuple[int, int, int]]) -> int:
        key = packed(tail, live)
        n = self.known.get(key)
        if n is None:
            if self.strict and len(self.key) > MOST_STATES * 5 // 4:
                raise Full
            n = self.known[key] = len(self.key)
            self.key.append(key)
            if n >= len(self.next):
                grow = lambda x, fill: np.concatenate((x, np.full(x.shape, fill, x.dtype)))
                self.next, self.last = grow(self.next, -1), grow(self.last, 0)
                self.end_out, self.end_last = grow(self.end_out, 0), grow(self.end_last, 0)
            for e, since, size in live:
                t = self.closing.get(tail[len(tail) - size :])
                if t is not None and (e == NONE or self.survives(e, t)):
                    self.end_out[n], self.end_last[n] = 1 - since, t
                    break
        return n

    def _compile(self, state: int, k: int) -> None:
        tail, live = unpacked(self.key[state])
        text = tail + bytes((self.byte[k],))
        for e, since, size in live:
            t = self.inner.get(text[len(tail) - size :])
            if t is not None and (e == NONE or self.survives(e, t)):
                out = 1 - since
                break
        else:
            raise ValueError("the vocabulary has no token for a byte")
        kept = [(e, since + out, size + 1) for e, since, size in live if text[len(tail) - size :] in self.begins]
        size = kept[0][2] if kept else 0
        n = self._state(text[len(text) - size :], [*kept, (t, 0, 0)])
        self.next[state, k], self.last[state, k] = n << 8 | (out + 128), t

    def _classes(self, data: np.ndarray) -> np.ndarray:
        got = self.klass[data]
        if (got < 0).any():
            for b in np.unique(data[got < 0]):
                self.klass[b] = len(self.byte)
                self.byte.append(int(b) if b < 255 else 0)  # 255, no byte of UTF-8, stands for the character NUL
            if len(self.byte) > self.width:
                more = np.full((len(self.next), 257 - self.width), -1, np.int32)
                more[DEAD] = DEAD << 8 | 128
                self.next = np.concatenate((self.next, more), axis=1)
                self.last = np.concatenate((self.last, np.zeros(more.shape, np.uint16)), axis=1)
                self.width = 257
            got = self.klass[data]
        return got

    # -- running -------------------------------------------------------

    def run(self, data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Transitions over bytes: ``cut`` marks where a word (or white space, byte 0) begins.

        Returns the packed transition taken at each byte and the table cell it was read from.
        """
        size = min(CHUNK, max(1, len(data)))
        lanes = max(1, -(-len(data) // size))
        pad = lanes * size - len(data)
        k = np.ascontiguousarray(np.pad(self._classes(data), (0, pad)).reshape(lanes, size).T)
        cuts = np.pad(cut, (0, pad), constant_values=True).reshape(lanes, size)
        c = np.ascontiguousarray(cuts.T)
        v, cell = np.empty((size, lanes), np.int32), np.empty((size, lanes), np.int32)
        constant = c.any(axis=0)
        state = np.where(c[0] | ~constant, START, DEAD).astype(np.int64)
        for j in range(size):
            np.copyto(state, START, where=c[j])
            state *= self.width
            state += k[j]
            cell[j] = state
            self._read(state, v[j])
            np.right_shift(v[j], 8, out=state)
        entry = self._entries(k, constant, state)
        live = np.flatnonzero(~c[0])
        s, reach = entry[live], np.where(constant, c.argmax(axis=0), size)  # where a head ends
        for j in range(size):
            on = reach[live] > j
            live, s = live[on], s[on]
            if not len(live):
                break
            at = s * self.width + k[j, live]
            got = np.empty(len(at), np.int32)
            self._read(at, got)
            cell[j, live], v[j, live] = at, got
            s = (got >> 8).astype(np.int64)
        return v.T.reshape(-1)[: len(data)], cell.T.reshape(-1)[: len(data)]

    def _entries(self, k: np.ndarray, constant: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Entry state of each chunk, from the composed maps of those before it.

        ``out`` is the exit of each chunk: of a constant map for every entry, of the others for START.
        """
        lanes = len(out)
        before = np.concatenate(([START], out[:-1]))
        inner = np.flatnonzero(~constant)
        if not len(inner):
            return before
        entry, exit_ = np.full((lanes, 1), START, np.int64), out[:, None].copy()
        fresh = 1  # columns of the last round
        while True:
            n = entry.shape[1]
            # column of a chunk's map -> column of the next one's; n stands for an entry that is not tabulated
            step = np.full((lanes, n + 1), n, np.int64)
            step[0] = 0
            for r in range(n):
                hit = exit_[:-1, r : r + 1] == entry[1:]
                step[1:, r] = np.where(constant[1:], 0, np.where(hit.any(axis=1), hit.argmax(axis=1), n))
            step[1:][constant[1:]] = 0
            d = 1
            while d < lanes:  # the prefix scan
                step[d:] = np.take_along_axis(step[d:], step[:-d], axis=1)
                d *= 2
            column = step[:, 0]
            unknown = inner[column[inner] == n]
            if not len(unknown):
                break
            # the entry of the first unknown chunk of a word is sure; periodic words have it in later chunks too
            lead = unknown[np.concatenate(([True], np.diff(unknown) > 1))]
            sure = np.repeat(exit_[lead - 1, np.where(constant[lead - 1], 0, column[lead - 1])], np.diff(np.append(np.searchsorted(unknown, lead), len(unknown))))
            new_entry, new_exit = [], []
            for asked in (sure, *(exit_[unknown - 1, r] for r in range(n - fresh, n))):
                tried = np.concatenate([entry[unknown], *(e[unknown, None] for e in new_entry)], axis=1)
                todo = (asked >= 0) & ~(tried == asked[:, None]).any(axis=1)
                if todo.any():
                    e, x = np.full(lanes, -1, np.int64), np.full(lanes, -2, np.int64)
                    who = unknown[todo]
                    e[who], s = asked[todo], asked[todo]
                    for j in range(len(k)):
                        got = np.empty(len(who), np.int32)
                        self._read(s * self.width + k[j, who], got)
                        s = (got >> 8).astype(np.int64)
                    x[who] = s
                    new_entry.append(e)
                    new_exit.append(np.where(constant, out, x))
            entry, exit_ = np.column_stack([entry, *new_entry]), np.column_stack([exit_, *new_exit])
            fresh = len(new_entry)
        exits = np.where(constant, out, exit_[np.arange(lanes), column])
        return np.concatenate(([START], exits[:-1]))

    def runs(self, data: np.ndarray, cut: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``run`` over segments that end where a word does: (from, to, transitions, cells), valid until the next one.

        Between segments the tables are dropped if they are too large; a segment that outgrows them is halved.
        """
        edges = np.append(np.flatnonzero(cut), len(data))
        todo = [(0, len(data))] if len(data) else []
        while todo:
            a, b = todo.pop()
            if b - a > SEGMENT:
                mid = int(edges[np.searchsorted(edges, a + SEGMENT)])
                if mid < b:
                    todo.append((mid, b))
                    b = mid
            if len(self.key) > MOST_STATES:
                self._empty()
            try:
                v, cell = self.run(data[a:b], cut[a:b])
            except Full:
                self._empty()
                mid = int(edges[np.searchsorted(edges, (a + b) // 2)])
                if mid < b and mid > a:
                    todo += [(mid, b), (a, mid)]
                    continue
                self.strict = False  # one word
                v, cell = self.run(data[a:b], cut[a:b])
                self.strict = True
            yield a, b, v, cell

    def _read(self, at: np.ndarray, out: np.ndarray) -> None:
        """Read cells of the table, compiling the transitions that are new."""
        np.take(self.next.reshape(-1), at, out=out, mode="clip")
        if len(out) and out.min() < 0:
            for cell in np.unique(at[out < 0]):
                self._compile(*divmod(int(cell), self.width))
            np.take(self.next.reshape(-1), at, out=out, mode="clip")

    def _emitted(self, v: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Tokens by byte of a segment, those of a word's END with its last byte."""
        out = (v & 255) - 128
        before = np.append(np.flatnonzero(cut[1:]), len(v) - 1)
        out[before] += self.end_out[v[before] >> 8]
        return out

    # -- splitting into words ------------------------------------------

    def _learn(self, points: np.ndarray) -> None:
        for p in np.unique(points):
            ch = chr(p)
            low = ch.lower()
            odd = len(low) != 1 or unicodedata.category(ch)[0] == "M" or unicodedata.category(ch) == "Cs" or 0x1160 <= p <= 0x11FF or not unicodedata.is_normalized("NFC", ch)
            found = WORDS.match(low)
            if odd or p == 0:
                self.kind[p] = ODD
            elif regex.match(r"\s", low):
                self.kind[p] = SPACE
            else:
                self.kind[p] = LETTER if regex.match(r"\p{L}", low) else NUMBER if regex.match(r"\p{N}", low) else OTHER if found else SPACE
            if not odd:
                self.low[p] = ord(low)

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with white space as 0, where words begin, and the end of each text; texts end with a 0."""
        plain = "\n".join(texts) + "\n"
        cp = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[cp]
        if (kind == UNSEEN).any():
            self._learn(cp[kind == UNSEEN])
            kind = self.kind[cp]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        stop = np.cumsum(sizes)
        low = self.low[cp]
        cut = np.ones(len(cp), bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) | (kind[1:] == SPACE)
        self._contractions(low, kind, cut)
        text = np.where(kind == SPACE, np.uint32(0), low)
        if text.max(initial=0) < 128:
            return text.astype(np.uint8), cut, stop
        text[kind == ODD] = 1
        wide = 1 + (text >= 0x80).astype(np.int64) + (text >= 0x800) + (text >= 0x10000)
        where = np.concatenate(([0], np.cumsum(wide)))
        data = np.frombuffer(text.tobytes().decode("utf-32-le").encode(), np.uint8)
        begin = np.zeros(len(data), bool)
        begin[where[:-1]] = cut
        return data, begin, where[stop]

    @staticmethod
    def _contractions(low: np.ndarray, kind: np.ndarray, cut: np.ndarray) -> None:
        """An apostrophe that begins a word takes its tail with it; the tail's end begins another word."""
        for p in np.flatnonzero((low == 39) & cut):
            for tail in TAILS:
                if low[p + 1 : p + 1 + len(tail)].tobytes() == tail.encode("utf-32-le"):
                    after = p + 1 + len(tail)
                    cut[p + 1 : after] = False
                    cut[after] = True
                    break

    def slow(self, text: str) -> bool:
        """Whether the tables can't split this text: characters that combine or change length, or special strings."""
        if self.special_at is not None and "<|" in text and self.special_at.search(text):
            return True
        if text.isascii():
            return "\0" in text
        kind = self.kind[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if (kind == UNSEEN).any():
            self._learn(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)[kind == UNSEEN])
            return self.slow(text)
        return bool((kind == ODD).any())

    def plain_words(self, text: str) -> list[str | int]:
        """The words of any text, by the regular expression; special strings as their ids."""
        found: list[str | int] = []
        parts = regex.split(f"({self.special_at.pattern})", text) if self.special_at is not None else [text]
        for part in parts:
            if part in self.special:
                found.append(self.special[part])
            elif part:
                found += WORDS.findall("".join(map(str.lower, unicodedata.normalize("NFC", part))))
        return found

    @staticmethod
    def parts(text: str) -> list[str]:
        """A long text in parts that begin with white space: no word, mark or special string is cut."""
        out, at = [], 0
        while len(text) - at > PART:
            m = SPACES.search(text, at + PART)
            if m is None:
                break
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        if any(len(t) > PART for t in texts):
            return np.array([sum(int(self.counts_of([p])[0]) for p in self.parts(t)) for t in texts], np.int64)
        return self.counts_of(texts)

    def counts_of(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        fast = [i for i, t in enumerate(texts) if not self.slow(t)]
        odd = sorted(set(range(len(texts))) - set(fast))
        if fast:
            data, cut, stop = self.split([texts[i] for i in fast])
            made = np.zeros(len(data), np.int32)
            for a, b, v, _ in self.runs(data, cut):
                made[a:b] = self._emitted(v, cut[a:b])
            at = np.concatenate(([0], np.cumsum(made, dtype=np.int64)))
            total[fast] = np.diff(at[np.concatenate(([0], stop))])
        if odd:
            for i, ids in zip(odd, self._slow_ids([texts[i] for i in odd]), strict=True):
                total[i] = len(ids)
        return total

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids end to end, and the number of each text."""
        if any(len(t) > PART for t in texts):
            got = [np.concatenate([self.ids_of([p])[0] for p in self.parts(t)]) for t in texts]
            return np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got))
        return self.ids_of(texts)

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        fast = [i for i, t in enumerate(texts) if not self.slow(t)]
        odd = sorted(set(range(len(texts))) - set(fast))
        got, total = np.zeros(0, np.uint16), np.zeros(len(texts), np.int64)
        if fast:
            data, cut, stop = self.split([texts[i] for i in fast])
            got, n = self._ids(data, cut)
            at = np.concatenate(([0], np.cumsum(n)))
            total[fast] = np.diff(at[np.concatenate(([0], stop))])
        if not odd:
            return got, total
        rest = dict(zip(odd, self._slow_ids([texts[i] for i in odd]), strict=True))
        begin, parts, done = 0, [], 0
        for i in range(len(texts)):
            if i in rest:
                parts += [got[begin:done], rest[i]]
                begin, total[i] = done, len(rest[i])
            else:
                done += int(total[i])
        return np.concatenate([*parts, got[begin:]]), total

    def _ids(self, data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and the number of tokens of each word with its last byte."""
        n, got = np.zeros(len(data), np.int64), [np.zeros(0, np.uint16)]
        for a, b, v, cell in self.runs(data, cut):
            got.append(self._segment_ids(cut[a:b], v, cell, n[a:b]))
        return np.concatenate(got), n

    def _segment_ids(self, cut: np.ndarray, v: np.ndarray, cell: np.ndarray, n: np.ndarray) -> np.ndarray:
        begin = np.flatnonzero(cut)
        stop = np.append(begin[1:], len(cut))
        token = self.end_last[v[stop - 1] >> 8].astype(np.int64)
        words = np.flatnonzero(token)
        if not len(words):
            return np.zeros(0, np.uint16)
        begin, at, token = begin[words], stop[words], token[words]
        last, live = self.last.reshape(-1), np.arange(len(words))
        each, back = np.zeros(len(words), np.int64), []
        final = at - 1
        while len(live):
            back.append((live, token))
            each[live] += 1
            at = at - self.length[token]
            keep = at > begin[live]
            live, at = live[keep], at[keep]
            token = last[cell[at - 1]].astype(np.int64)
        place = np.cumsum(each)
        got = np.zeros(int(place[-1]), np.uint16)
        for step, (who, token) in enumerate(back):
            got[place[who] - 1 - step] = token
        n[final] = each
        return got

    def _slow_ids(self, texts: list[str]) -> list[np.ndarray]:
        words = [self.plain_words(t) for t in texts]
        plain = sorted({w for ws in words for w in ws if isinstance(w, str)})
        table = {}
        if plain:
            raw = [w.encode("utf-8", "surrogatepass").replace(b"\0", b"\xff") for w in plain]
            data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
            size = np.fromiter(map(len, raw), np.int64, len(raw))
            gap = np.cumsum(size + 1) - 1
            cut = np.zeros(len(data), bool)
            cut[gap] = True
            cut[gap - size] = True
            got, n = self._ids(data, cut)
            at = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], gap + 1))]
            table = {w: got[a:b] for w, a, b in zip(plain, at[:-1], at[1:], strict=True)}
        nothing = np.zeros(0, np.uint16)
        return [np.concatenate([nothing, *(table[w] if isinstance(w, str) else np.array([w], np.uint16) for w in ws)]) for ws in words]


def compiled(path: str) -> Transducer:
    """One transducer a worker process, until another operator's tasks come to the process."""
    return worker_cache(("transducer", path), lambda: Transducer(path))
