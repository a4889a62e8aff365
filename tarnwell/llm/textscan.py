"""Vectorised scanning of many texts at once: code points, spans, and tables of spans by content.

Texts are joined by a separator that valid text cannot hold (a lone surrogate) and scanned as one
numpy array of code points, so the work per character is a few array operations.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

SEPARATOR, SPECIAL = "\udfff", "\udffe"
OTHER, LETTER, NUMBER, SPACE, SEPARATED, MARKED, UNKNOWN = 0, 1, 2, 3, 4, 5, 255
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a code point; a place in a span stands above them.
_CODE = np.uint64(21)


def code_points(texts: list[str]) -> np.ndarray:
    """Code points of the texts, each followed by the separator."""
    joined = SEPARATOR.join(texts) + SEPARATOR if texts else ""
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads differences over all of them (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of all spans one after the other, each one's place in its span, and where spans begin (and the end)."""
    sizes = ends - starts
    to = np.append(0, np.cumsum(sizes))
    inner = np.arange(to[-1]) - np.repeat(to[:-1], sizes)
    return np.repeat(starts, sizes) + inner, inner, to


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span, equal for equal spans wherever they stand; never 0.

    A sum over the span of a mixed value of each code point with its place. It finds spans; whoever
    must tell spans apart compares them (:class:`SpanTable`).
    """
    place, inner, to = flat(starts, ends)
    value = codes[place].astype(np.uint64)
    value |= inner.astype(np.uint64) << _CODE
    value += np.uint64((seed + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    total = np.append(np.uint64(0), np.cumsum(mixed(value), dtype=np.uint64))
    found = mixed(total[to[1:]] - total[to[:-1]] + np.uint64(seed))
    found[found == 0] = 1
    return found


def equal_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether span i of ``a`` has the content of span i of ``b``, which is as long."""
    place, inner, to = flat(a_starts, a_starts + sizes)
    wrong = np.append(0, np.cumsum(a[place] != b[np.repeat(b_starts, sizes) + inner]))
    return wrong[to[1:]] == wrong[to[:-1]]


class HashIndex:
    """64-bit keys (not 0) to small integers by open addressing, looked up a whole array at a time."""

    def __init__(self, bits: int = 16):
        self.clear(bits)

    def clear(self, bits: int = 16) -> None:
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)
        self.n = 0

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _BASE) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        at, mask = self._at(keys), len(self.keys) - 1
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            at[left] = (at[left] + 1) & mask
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there != 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that are distinct and not yet there."""
        while 2 * (self.n + len(keys)) > len(self.keys):
            old = self.keys != 0
            k, v = self.keys[old], self.values[old]
            self.clear(int(len(self.keys)).bit_length())
            self.put(k, v)
        self.n += len(keys)
        at, mask = self._at(keys), len(self.keys) - 1
        left = np.arange(len(keys))
        while len(left):
            slot = at[left]
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[left[free]]
            own = free & (self.keys[slot] == keys[left])
            self.values[slot[own]] = values[left[own]]
            left = left[~own]
            at[left] = (at[left] + 1) & mask


class SpanTable:
    """Numbers spans of code points from 0 on, told apart by their content; hashes only find them."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.index, self.n = HashIndex(), 0
        self.codes, self.at = np.zeros(1 << 14, np.uint32), np.zeros(1 << 12, np.int64)

    def _find(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each span, -1 where none has its hash, -2 where another one has it."""
        found = self.index.get(hashes)
        hit = np.flatnonzero(found >= 0)
        own, sizes = found[hit], (ends - starts)[hit]
        alike = self.at[own + 1] - self.at[own] == sizes
        alike[alike] = equal_spans(codes, starts[hit[alike]], self.codes, self.at[own[alike]], sizes[alike])
        found[hit[~alike]] = -2
        return found

    def _append(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        place, _, to = flat(starts, ends)
        base, n = self.at[self.n], len(starts)
        while base + to[-1] > len(self.codes):
            self.codes = np.append(self.codes, np.zeros_like(self.codes))
        while self.n + n >= len(self.at):
            self.at = np.append(self.at, np.zeros_like(self.at))
        self.codes[base : base + to[-1]] = codes[place]
        self.at[self.n + 1 : self.n + n + 1] = base + to[1:]
        self.n += n

    def numbers(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, learn: Callable[[int, np.ndarray], None]) -> np.ndarray:
        """The number of each span. ``learn(first, at)`` is told which spans (``at``) get the numbers
        from ``first`` on; 0 means that all earlier numbers are void.

        A span whose hash another one has taken gets a new number each time.
        """
        hashes = span_hashes(codes, starts, ends)
        found = self._find(codes, starts, ends, hashes)
        if (found < 0).any():
            if self.n > self.most:
                self.clear()
                found[:] = -1
            missing = np.flatnonzero(found == -1)
            new, first = np.unique(hashes[missing], return_index=True)
            at = missing[first]
            learn(self.n, at)
            self.index.put(new, np.arange(self.n, self.n + len(new), dtype=np.int32))
            self._append(codes, starts[at], ends[at])
            found[missing] = self._find(codes, starts[missing], ends[missing], hashes[missing])
            if len(other := np.flatnonzero(found == -2)):
                learn(self.n, other)
                found[other] = np.arange(self.n, self.n + len(other))
                self._append(codes, starts[other], ends[other])
        return found


class Lower:
    """Lower case of code points, one for one, so that places in a text stay as they are."""

    def __init__(self) -> None:
        self.table = np.zeros(0x110000, np.uint32)

    def of(self, codes: np.ndarray) -> np.ndarray:
        out = self.table[codes]
        if not out.all():
            for c in np.unique(codes[out == 0]):
                self.table[c] = ord(chr(c).lower()[0])
            out = self.table[codes]
        return out


class Classes:
    """Character classes by code point, each asked for once when it first occurs."""

    def __init__(self, ask: Callable[[str], int]):
        self.ask = ask
        self.table = np.full(0x110000, UNKNOWN, np.uint8)
        self.table[ord(SEPARATOR)], self.table[ord(SPECIAL)] = SEPARATED, MARKED

    def of(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.table[codes]
        if (new := kinds == UNKNOWN).any():
            for c in np.unique(codes[new]):
                self.table[c] = self.ask(chr(c))
            kinds = self.table[codes]
        return kinds


def byte_level_starts(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of byte-level BPE start, in code points of any number of texts.

    The rule is the public pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``:
    runs of one class, the last white space before a run stands alone or, if it is a blank, belongs
    to the run; an apostrophe that starts a run of one and is followed by s, t, re, ve, m, ll or d
    takes those letters.
    """
    n = len(codes)
    start = np.ones(n, bool)
    start[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] >= SEPARATED)
    last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] < SPACE))
    start[last] = True
    start[last[codes[last] == 0x20] + 1] = False
    quote = np.flatnonzero((codes == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[kinds[quote + 1] == LETTER]
    if len(quote):
        one = codes[quote + 1]
        two = np.where(quote + 2 < n, codes[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("l")) & (two == ord("l"))) | (np.isin(one, [ord("r"), ord("v")]) & (two == ord("e")))
        start[quote[short | long] + 1] = False
        start[quote[short] + 2] = True
        after = quote[long] + 3
        start[after[after < n]] = True
    return start


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
