"""Token counts by the whole-token shortcut.

:func:`whole_tokens` proves once, offline, which strings of the vocabulary are a pre-token of their
own and encode alone as exactly one token. Texts are cut into pre-tokens; those in the proven set
count as 1 without any merging, and only the rest is merged by the library (each distinct one once
per worker).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import slices, text_buffer
from .token_model import MOST_KNOWN, byte_alphabet, encoder

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> list[str]:
    """The vocabulary's strings that alone give one token, proved once per file."""
    own = encoder(path)
    if not own.fast:
        return []
    back = {c: b for b, c in byte_alphabet().items()}
    strings = []
    for piece in own.tokenizer.get_vocab(with_added_tokens=False):
        try:
            strings.append(bytes(back[c] for c in piece).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    codes, starts, ends, firsts = own.spans(strings)
    alone = np.flatnonzero(np.diff(firsts) == 1)
    at = firsts[:-1][alone]
    return [strings[i] for i, ids in zip(alone, own.merged(codes, starts[at], ends[at]), strict=True) if len(ids) == 1]


class Counter:
    """Tokens of texts: pre-tokens that are proven whole tokens are numbered first and count as 1."""

    def __init__(self, path: str, whole: list[str]):
        self.encoder, self.whole, self.n = encoder(path), whole, np.zeros(1024, np.int64)
        self.known = ts.SpanTable(MOST_KNOWN + len(whole))

    def _put(self, first: int, n: np.ndarray) -> None:
        while first + len(n) > len(self.n):
            self.n = np.append(self.n, self.n)
        self.n[first : first + len(n)] = n

    def counts(self, texts: list[str]) -> np.ndarray:
        own = self.encoder
        if not own.fast:
            return np.array([len(e) for e in own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)], np.int64)
        if self.known.n > MOST_KNOWN:
            self.known.clear()
        if not self.known.n and self.whole:
            codes, starts, ends, _ = own.spans(self.whole)
            self.known.numbers(codes, starts, ends, lambda first, at: self._put(first, np.ones(len(at), np.int64)))
        codes, starts, ends, firsts = own.spans(texts)
        found = self.known.numbers(codes, starts, ends, lambda first, at: self._put(first, np.fromiter(map(len, own.merged(codes, starts[at], ends[at])), np.int64, len(at))))
        return np.diff(np.append(0, np.cumsum(self.n[found]))[firsts])


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs`` (doc_id, text; others unread).

    Tokens are counted as the library encodes the text without added special tokens; a special
    string inside a text is its one token. Null texts count as empty; repeated rows, null ids and
    very long texts are counted like any other; an empty table gives an empty result.
    """
    whole = whole_tokens(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(path, whole)
        for part in slices(batches):
            texts = part.column("text").fill_null("")
            n = _counters[path].counts(texts.to_pylist())
            _, offsets = text_buffer(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, SCHEMA)
