"""Token ids of whole texts as the tokenizers library gives them, each distinct pre-token once.

A byte-level BPE text is cut into pre-tokens, and each pre-token is encoded by itself; so a text's
ids are its pre-tokens' ids one after the other. :class:`Encoder` finds the pre-tokens of many texts
at once, has the library encode those it has not met, and puts the ids together; pre-tokens are told
apart by their content. A file of another kind is encoded text by text.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from . import textscan as ts

#: Distinct pre-tokens kept by a worker before it starts afresh.
MOST_KNOWN = 1 << 19


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def is_plain_byte_level(config: dict) -> bool:
    """Whether pre-tokens are those of :func:`textscan.byte_level_starts` and specials stand for themselves."""
    pre, model = config.get("pre_tokenizer") or {}, config["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    bpe = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
    added = config.get("added_tokens") or []
    alone = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in added)
    return bool(plain and bpe and alone and config.get("normalizer") is None and len(added) <= 1)


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.fast = is_plain_byte_level(config)
        self.model = self.tokenizer.model
        self.alphabet = str.maketrans(byte_alphabet())
        self.special = [(t["content"], t["id"]) for t in config.get("added_tokens") or []]
        self.classes = ts.Classes(self._class)
        self.reset()

    def reset(self) -> None:
        self.known = ts.SpanTable(MOST_KNOWN)
        self.offsets, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids, self.used = np.zeros(4096, np.uint32), 0

    def _class(self, c: str) -> int:
        """A character's class, as the library's own pre-tokenizer treats it."""
        cut = [o for _, o in self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{c}1")]
        if cut[0] == (0, 2):
            return ts.LETTER
        among = len(self.tokenizer.pre_tokenizer.pre_tokenize_str(f"!{c}!"))
        return ts.OTHER if among == 1 else ts.NUMBER if len(cut) == 2 and among == 3 else ts.SPACE

    def merged(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        """The library's ids of each of these pre-tokens."""
        sizes = ends - starts + 1
        to = np.cumsum(sizes)
        joined = codes[np.minimum(np.repeat(starts - to + sizes, sizes) + np.arange(to[-1] if len(to) else 0), max(len(codes) - 1, 0))]
        joined[to - 1] = ord(ts.SEPARATOR)
        text = joined.tobytes().decode("utf-32-le", "surrogatepass")
        stand_ins = self._stand_ins(text).split(self._stand_ins(ts.SEPARATOR))[:-1]
        mark, tokenize = self._stand_ins(ts.SPECIAL), self.model.tokenize
        return [[self.special[0][1]] if p == mark else [t.id for t in tokenize(p)] for p in stand_ins]

    def _stand_ins(self, text: str) -> str:
        return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)

    def spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points, starts and ends of all pre-tokens, and the first pre-token of each text (and the end)."""
        if self.special:
            mark = self.special[0][0]
            texts = [t.replace(mark, ts.SPECIAL) if mark in t else t for t in texts]
        codes = ts.code_points(texts)
        kinds = self.classes.of(codes)
        starts = np.flatnonzero(ts.byte_level_starts(codes, kinds))
        ends = np.append(starts[1:], len(codes))
        real = kinds[starts] != ts.SEPARATED
        breaks = np.flatnonzero(kinds == ts.SEPARATED)
        starts, ends = starts[real], ends[real]
        return codes, starts, ends, np.append(0, np.searchsorted(starts, breaks))

    def entries(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each pre-token its place in offsets and lengths."""

        def learn(first: int, at: np.ndarray) -> None:
            if not first:
                self.used = 0
            found = self.merged(codes, starts[at], ends[at])
            lengths = np.fromiter(map(len, found), np.int32, len(found))
            flat = np.fromiter((i for f in found for i in f), np.uint32, int(lengths.sum()))
            while first + len(at) > len(self.offsets):
                self.offsets, self.lengths = np.append(self.offsets, self.offsets), np.append(self.lengths, self.lengths)
            while self.used + len(flat) > len(self.ids):
                self.ids = np.append(self.ids, self.ids)
            self.offsets[first : first + len(at)] = self.used + np.cumsum(lengths) - lengths
            self.lengths[first : first + len(at)] = lengths
            self.ids[self.used : self.used + len(flat)] = flat
            self.used += len(flat)

        return self.known.numbers(codes, starts, ends, learn)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text begins (and the end)."""
        if not self.fast:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            ends = np.cumsum([0, *map(len, lists)])
            return np.fromiter((i for x in lists for i in x), np.uint32, int(ends[-1])), ends
        codes, starts, ends, firsts = self.spans(texts)
        found = self.entries(codes, starts, ends)
        lengths = self.lengths[found]
        total = np.append(0, np.cumsum(lengths, dtype=np.int64))
        place = np.repeat(self.offsets[found] - total[:-1], lengths) + np.arange(total[-1])
        return self.ids[place], total[firsts]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)
