"""Word shingles of many texts at once, as sets of 64-bit hashes, and SuperMinHash signatures of them.

Sets that decide a link are made by :func:`exact_sets`, which compares the words of shingles of one
hash; the hashes of :func:`shingle_sets` alone choose candidates and, with a second and independent
hash of each shingle, tell equal sets.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa

from . import textscan as ts
from .common import text_buffer

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM_BITS = np.uint32(25)


@dataclass
class Sets:
    """Distinct shingles of each text: ``hashes[at[i] : at[i + 1]]``, ascending; ``second``: their other hashes."""

    hashes: np.ndarray
    at: np.ndarray
    second: np.ndarray | None = None

    def __getitem__(self, i: int) -> np.ndarray:
        return self.hashes[self.at[i] : self.at[i + 1]]


@dataclass
class _Words:
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    count: np.ndarray


def _words(texts: pa.Array) -> _Words:
    """The words of the texts in A-Z lower case, and how many each text has."""
    data, offsets = text_buffer(texts)
    data = _LOWER[data]
    inside = ~_BLANK[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    bounds = offsets[:-1][(offsets[:-1] < len(data))]
    start[bounds] = inside[bounds]
    starts = np.flatnonzero(start)
    # a word ends at the first blank after it, at the next text or at the end of all
    stop = np.concatenate([np.flatnonzero(~inside), offsets[1:]])
    stop.sort()
    ends = stop[np.searchsorted(stop, starts, "right")] if len(starts) else starts
    document = np.searchsorted(offsets, starts, "right") - 1
    return _Words(data, starts, ends, np.bincount(document, minlength=len(offsets) - 1))


def _shingles(count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of each shingle; fewer words than k are one shingle."""
    first = np.cumsum(count) - count
    n = np.maximum(count - k + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(count)), n)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return owner, begin, np.minimum(count, k)[owner]


def _joined(words: np.ndarray, begin: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """A hash of each shingle from the hashes of its words."""
    value = np.full(len(begin), 0x51, np.uint64)
    for i in range(k):
        part = words[np.minimum(begin + i, max(len(words) - 1, 0))] if len(words) else value
        value = np.where(i < size, ts.mixed(value * np.uint64(0xD1342543DE82EF95) + part), value)
    return ts.mixed(value + size.astype(np.uint64))


def _distinct(value: np.ndarray, owner: np.ndarray, n: int, second: np.ndarray | None = None) -> tuple[Sets, np.ndarray]:
    """Each text's values once, ascending, and the order that sorts all of them."""
    order = np.argsort(value)
    order = order[np.argsort(owner[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    at = np.append(0, np.cumsum(np.bincount(owner[fresh], minlength=n)))
    return Sets(value[fresh], at, second[order][fresh] if second is not None else None), order


def shingle_sets(texts: pa.Array, k: int) -> Sets:
    """Sets of ``k``-word shingles of texts in A-Z lower case; fewer words are one shingle, none are none."""
    own = _words(texts)
    owner, begin, size = _shingles(own.count, k)
    first, second = (_joined(ts.span_hashes(own.data, own.starts, own.ends, seed), begin, size, k) for seed in (0, 1))
    return _distinct(first, owner, len(own.count), second)[0]


def exact_sets(texts: pa.Array, k: int) -> Sets:
    """As :func:`shingle_sets`, but values are equal exactly where the shingles are, within these texts.

    Words of one hash are compared byte by byte and shingles of one hash word by word; should two
    differ, all are hashed anew under another seed.
    """
    own = _words(texts)
    owner, begin, size = _shingles(own.count, k)
    for seed in count():
        words = ts.span_hashes(own.data, own.starts, own.ends, seed)
        order = np.argsort(words, kind="stable")
        alike = np.flatnonzero(words[order][1:] == words[order][:-1])
        a, b = order[alike], order[alike + 1]
        sizes = own.ends[a] - own.starts[a]
        if (sizes != own.ends[b] - own.starts[b]).any() or not ts.equal_spans(own.data, own.starts[a], own.data, own.starts[b], sizes).all():
            continue
        value = _joined(words, begin, size, k)
        order = np.argsort(value, kind="stable")
        alike = np.flatnonzero(value[order][1:] == value[order][:-1])
        a, b = order[alike], order[alike + 1]
        told = size[a] == size[b]
        for i in range(k):
            inside = i < np.minimum(size[a], size[b])
            told[inside] &= words[begin[a[inside]] + i] == words[begin[b[inside]] + i]
        if told.all():
            return _distinct(value, owner, len(own.count))[0]
    raise AssertionError("unreachable")


def set_fingerprints(sets: Sets) -> np.ndarray:
    """Two 64-bit sums over each set, of its shingles' two independent hashes: equal for equal sets."""
    total = [np.append(np.uint64(0), np.cumsum(ts.mixed(h ^ np.uint64(c)), dtype=np.uint64)) for h, c in ((sets.hashes, 0x243F6A8885A308D3), (sets.second, 0x13198A2E03707344))]
    return np.stack([t[sets.at[1:]] - t[sets.at[:-1]] for t in total], axis=1)


def super_minhash(sets: Sets, m: int) -> np.ndarray:
    """SuperMinHash signatures (sets by m, 32 bits): component i is the least ``step + random`` of any
    element, where ``step`` is the place of i in the element's own random permutation.

    All elements take a step of their permutation (a Fisher-Yates shuffle) at once; a set stops as soon
    as all its components are below the next step, which long sets reach after one or two steps.
    Empty sets keep the highest value everywhere.
    """
    n = len(sets.at) - 1
    out = np.full(n * m, 0xFFFFFFFF, np.uint32)
    element = sets.hashes
    owner = np.repeat(np.arange(n), np.diff(sets.at))
    order = np.zeros((0, m), np.uint8)
    for step in range(m):
        if not len(element):
            break
        x = ts.mixed(element + np.uint64(0x9E3779B97F4A7C15 * (step + 1) & 0xFFFFFFFFFFFFFFFF))
        pick = (((x >> np.uint64(32)) * np.uint64(m - step)) >> np.uint64(32)).astype(np.int64) + step
        value = ((x & np.uint64((1 << 25) - 1)).astype(np.uint32)) | (np.uint32(step) << _RANDOM_BITS)
        if step:
            rows = np.arange(len(element))
            component = order[rows, pick]
            order[rows, pick] = order[:, step]
        else:
            component = pick
        np.minimum.at(out, owner * m + component, value)
        done = out.reshape(n, m).max(axis=1) < np.uint32(step + 1) << _RANDOM_BITS if step + 1 < m else np.ones(n, bool)
        left = ~done[owner]
        if step:
            order = order[left]
        element, owner = element[left], owner[left]
        if not step:
            order = np.tile(np.arange(m, dtype=np.uint8), (len(element), 1))
            order[np.arange(len(element)), component[left]] = 0
    return out.reshape(n, m)
