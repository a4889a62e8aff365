"""Simple-8b coding of unsigned integers in 64-bit words, a whole array at a time.

The four high bits of a word select how many values it holds and of how many bits; the other 60 bits
hold them, the first value lowest. Values are coded in blocks of ``BLOCK``, each starting a word of
its own, so that an offset per block is enough to decode any block alone and all blocks at once. A
word of the widest selector whose 60 bits are all set is an escape: its value, which 60 bits cannot
hold, is the next one of the escapes.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Values in a word and bits of each, by selector (fixed values of the format).
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = np.uint64((1 << 60) - 1)
_SELECTOR_SHIFT = np.uint64(60)


def _levels(values: np.ndarray) -> np.ndarray:
    """The narrowest selector that can hold each value."""
    most = (np.uint64(1) << BITS.astype(np.uint64)) - np.uint64(1)
    most[0] = 0
    if len(values) and (top := values.max()) < 1 << 20:
        return np.searchsorted(most, np.arange(top + np.uint64(1)), "left").astype(np.int8)[values]
    return np.searchsorted(most, values, "left").astype(np.int8)


def _best(level: np.ndarray) -> np.ndarray:
    """For each place of each block the selector that takes the most values from there on.

    Places after the block's end count as zeros, so the last word of a block may reach past it.
    """
    blocks, wide = level.shape[0], BLOCK + int(COUNTS[0])
    highest = {1: np.zeros((blocks, wide), np.int8)}
    highest[1][:, :BLOCK] = level

    def window(n: int) -> np.ndarray:
        """The highest level of the n values from each place."""
        if n not in highest:
            part = 1 << ((n - 1).bit_length() - 1)
            base, out = window(part), window(part).copy()
            np.maximum(base[:, : wide - (n - part)], base[:, n - part :], out=out[:, : wide - (n - part)])
            highest[n] = out
        return highest[n]

    best = np.full((blocks, BLOCK), len(COUNTS) - 1, np.int8)
    for s in range(len(COUNTS) - 2, -1, -1):
        np.copyto(best, np.int8(s), where=window(int(COUNTS[s]))[:, :BLOCK] <= s)
    return best


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, the first word of each block, escapes) of an array of unsigned integers."""
    values = np.asarray(values, np.uint64)
    n, blocks = len(values), -(-len(values) // BLOCK)
    escapes = values[values >= ESCAPE]
    padded = np.zeros(blocks * BLOCK, np.uint64)
    np.minimum(values, ESCAPE, out=padded[:n])
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), escapes
    best = _best(_levels(padded).reshape(blocks, BLOCK))
    ends = np.minimum(n - np.arange(blocks) * BLOCK, BLOCK)
    at, alive, taken = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(alive):
        here = at[alive]
        chosen = best[alive, here]
        taken.append((alive * BLOCK + here, chosen))
        at[alive] = here + COUNTS[chosen]
        alive = alive[at[alive] < ends[alive]]
    first, chosen = (np.concatenate(x) for x in zip(*taken, strict=True))
    order = np.argsort(first)
    first, chosen = first[order], chosen[order]
    held = np.diff(np.append(first, len(padded)))
    shift = (np.arange(len(padded)) - np.repeat(first, held)) * np.repeat(BITS[chosen], held)
    padded <<= np.minimum(shift, 63).astype(np.uint64)  # what lies past a short last block is 0
    words = np.bitwise_or.reduceat(padded, first) | (chosen.astype(np.uint64) << _SELECTOR_SHIFT)
    return words, np.searchsorted(first, np.arange(blocks) * BLOCK), escapes


def unpack(words: np.ndarray, starts: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of :func:`pack`."""
    blocks = len(starts)
    out = np.zeros(blocks * BLOCK + COUNTS[0], np.uint64)
    if not n:
        return out[:0]
    chosen = (words >> _SELECTOR_SHIFT).astype(np.int64)
    count = COUNTS[chosen]
    before = np.cumsum(count) - count
    block = np.searchsorted(starts, np.arange(len(words)), "right") - 1
    to = before - before[starts][block] + block * BLOCK
    limit = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(chosen):
        own = np.flatnonzero(chosen == s)
        lane = np.arange(COUNTS[s])
        part = (words[own, None] >> (lane * BITS[s]).astype(np.uint64)) & np.uint64((1 << int(BITS[s])) - 1)
        place = to[own, None] + lane
        real = place < limit[own, None]
        out[place[real]] = part[real]
    out = out[:n]
    out[out == ESCAPE] = escapes
    return out
