"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a word
is the sum, over all ways to cut it into pieces, of the product of the pieces' probabilities; a
forward pass over the word's places sums them all. A text's score for a language is the product over
its words, and the prediction is the language of the highest posterior under equal priors.

Words are runs of letters and marks in lower case, of any length; each stands with the vocabulary's
mark of a word start before it. A letter that is no piece costs ``RARE`` in every language.

Piece probabilities are learned by expectation maximisation: expected piece counts come from a forward
and a backward pass over the distinct words of a sample of labelled texts (at most about
``most_documents`` a language, drawn by a hash of doc_id), summed by Spark for each language and piece.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from . import textscan as ts
from .common import SHARES, crc_remainder, in_share, slices, stable

RARE, SMOOTHING = 1e-8, 0.01
MOST_DOCUMENTS, ROUNDS = 1500, 3
#: The model has a column, and the driver a number, for each language; more are an error.
MOST_LANGUAGES = 1000
WORD_START = "▁"
MARK = ts.NUMBER
#: Words times languages whose probabilities a worker keeps before it starts afresh; letters summed at once.
MOST_KEPT, LETTERS = 4 << 20, 1 << 18


def _kind(c: str) -> int:
    return {"L": ts.LETTER, "M": MARK}.get(unicodedata.category(c)[0], ts.OTHER)


_classes = ts.Classes(_kind)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> list[str]:
    """The vocabulary's pieces that lower-case words can hold."""
    model = SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    return sorted(p for p in pieces if p == p.lower() and all(unicodedata.category(c)[0] in "LM" for c in p.removeprefix(WORD_START)))


def _steps(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The hash of a prefix made longer by one code point."""
    return ts.mixed(h * np.uint64(0x9E3779B97F4A7C15) + codes.astype(np.uint64) + np.uint64(1)) | np.uint64(1)


@dataclass
class Words:
    """Words one after the other, each with the mark of a start: code points, where each begins, sizes."""

    codes: np.ndarray
    at: np.ndarray
    sizes: np.ndarray

    def left(self) -> np.ndarray:
        """Code points from each place to its word's end."""
        return np.repeat(self.at + self.sizes, self.sizes) - np.arange(len(self.codes))


class Lattice:
    """Finds the pieces at every place of many words at once, and sums over segmentations.

    Words come as one array of code points, the longest word first, each with its mark of a start.
    """

    def __init__(self, pieces: list[str]):
        self.unknown, self.widest = len(pieces), max(map(len, pieces), default=1)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        at = np.cumsum(sizes) - sizes
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        h, keys, values = np.zeros(len(pieces), np.uint64), [], []
        for n in range(self.widest):
            own = np.flatnonzero(sizes > n)
            h[own] = _steps(h[own], codes[at[own] + n])
            keys.append(h[own])
            values.append(np.where(sizes[own] == n + 1, own, len(pieces)))
        keys, values = np.concatenate(keys), np.concatenate(values)
        # a prefix that is a piece itself stands for that piece, the others for none
        order = np.lexsort((values, keys))
        first = np.append(True, keys[order][1:] != keys[order][:-1])[: len(order)]
        self.index = ts.HashIndex()
        self.index.put(keys[order][first], values[order][first].astype(np.int32))

    def pieces(self, codes: np.ndarray, left: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1 on: the places where a piece of that length starts, and the piece.

        left: code points from each place to its word's end. A single letter that is no piece is the
        unknown one.
        """
        out, alive, h = [], np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for n in range(self.widest):
            h = _steps(h, codes[alive + n])
            found = self.index.get(h)
            hit = (found >= 0) & (found < self.unknown)
            out.append((alive[hit], found[hit]) if n else (alive, np.where(hit, found, self.unknown)))
            on = (found >= 0) & (left[alive] > n + 1)
            alive, h = alive[on], h[on]
            if not len(alive):
                break
        return out

    def forward(self, words: Words, p: np.ndarray, language: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each word in each language (or in its own), and with ``language`` that of
        what lies before each place.

        A place's sum goes to the next ``widest`` places, so a ring of them is all that is kept; it is
        scaled at each place, so that no word is too long.
        """
        k = p.shape[1] if language is None else 1
        arcs = np.full((self.widest, len(words.codes)), -1, np.int32)
        for n, (at, piece) in enumerate(self.pieces(words.codes, words.left())):
            arcs[n, at] = piece
        ring, scale = np.zeros((self.widest + 1, len(words.sizes), k)), np.zeros((len(words.sizes), k))
        ring[0] = 1
        before = np.zeros(len(words.codes)) if language is not None else None
        for i in range(int(words.sizes[0]) if len(words.sizes) else 0):
            n = int(np.searchsorted(-words.sizes, -i))  # words of more than i code points come first
            at, now = words.at[:n] + i, ring[i % len(ring), :n].copy()
            ring[:, :n] /= now
            scale[:n] += np.log(now)
            ring[i % len(ring), :n] = 0
            if before is not None:
                before[at] = scale[:n, 0]
            for m in range(self.widest):
                piece = arcs[m, at]
                hit = np.flatnonzero(piece >= 0)
                if not len(hit):
                    continue
                chance = p[piece[hit]] if language is None else p[piece[hit], language[hit]][:, None]
                ring[(i + m + 1) % len(ring), hit] += chance
        end = ring[words.sizes % len(ring), np.arange(len(words.sizes))]
        return scale + np.log(end), before

    def expected(self, words: Words, counts: np.ndarray, language: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected counts of pieces by language over words of a known language.

        What lies behind a place is what lies before its mirror image in the reversed lattice; here it
        is summed from each word's end on with logarithms.
        """
        total, before = self.forward(words, p, language)
        owner = np.repeat(np.arange(len(words.sizes)), words.sizes)
        arcs = [(at, at + n + 1, piece, np.log(p[piece, language[owner[at]]])) for n, (at, piece) in enumerate(self.pieces(words.codes, words.left()))]
        behind = np.full(len(words.codes) + len(words.sizes), -np.inf)  # a place more for each word: its end
        shift = owner
        behind[words.at + words.sizes + np.arange(len(words.sizes))] = 0
        by_left = [np.argsort(words.left()[at], kind="stable") for at, *_ in arcs]
        edges = [np.searchsorted(words.left()[at][order], np.arange(int(words.sizes[0]) + 2)) for (at, *_), order in zip(arcs, by_left, strict=True)]
        for left in range(1, int(words.sizes[0]) + 1):
            for (at, to, _, log_p), order, edge in zip(arcs, by_left, edges, strict=True):
                own = order[edge[left] : edge[left + 1]]
                if len(own):
                    a, b = at[own] + shift[at[own]], to[own] + shift[at[own]]
                    behind[a] = np.logaddexp(behind[a], log_p[own] + behind[b])
        out = np.zeros(p.size)
        for at, to, piece, log_p in arcs:
            w = owner[at]
            share = counts[w] * np.exp(before[at] + log_p + behind[to + shift[at]] - total[w, 0])
            out += np.bincount(piece * p.shape[1] + language[w], share, p.size)
        return out.reshape(p.shape)


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, starts, ends and text of each word, and whether each text has a letter."""
    codes = ts.code_points([t.lower() for t in texts])
    kinds = _classes.of(codes)
    starts, ends = ts.runs((kinds == ts.LETTER) | (kinds == MARK))
    breaks = np.flatnonzero(kinds == ts.SEPARATED)
    letters = np.bincount(np.searchsorted(breaks, np.flatnonzero(kinds == ts.LETTER)), minlength=len(texts)) > 0
    return codes, starts, ends, np.searchsorted(breaks, starts), letters


def in_parts(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, Words]]:
    """Words by falling length in parts of about ``LETTERS`` code points, or one word: (which, the words)."""
    order = np.argsort(starts - ends, kind="stable")
    part = np.cumsum((ends - starts + 1)[order]) // LETTERS
    for which in np.split(order, np.flatnonzero(np.diff(part)) + 1) if len(order) else ():
        place, inner, to = ts.flat(starts[which] - 1, ends[which])
        own = codes[np.maximum(place, 0)]
        own[to[:-1]] = ord(WORD_START)
        yield which, Words(own, to[:-1], np.diff(to))


@dataclass
class Model:
    pieces: list[str]
    languages: list[str]
    p: np.ndarray


def learn(docs: DataFrame, path: str, most_documents: int = MOST_DOCUMENTS, rounds: int = ROUNDS) -> Model:
    """Piece probabilities from text and non-null lang of rows whose crc32(doc_id) mod 4 is not 2.

    The words of the sample, the piece counts of each round (languages times pieces) and the list of
    languages are the only things gathered; the sample bounds the first, the vocabulary the second.
    Without usable rows the model knows no language; a language of which no document is drawn is an error.
    """
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    rows = rows.where(F.coalesce(crc_remainder("doc_id", 4) != 2, F.lit(True)))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages, pieces = sorted(sizes), vocabulary(path)
    if not languages:
        return Model(pieces, [], np.zeros((len(pieces) + 1, 0)))
    place = F.element_at(F.create_map(*[F.lit(x) for i, name in enumerate(languages) for x in (name, i)]), F.col("lang"))
    least = F.element_at(F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, int(SHARES * min(1.0, most_documents / n)))]), F.col("lang"))
    sample = rows.where(in_share(F.col("doc_id"), least)).select(place.alias("language"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            codes, starts, ends, document, _ = word_spans(part.column("text").to_pylist())
            language = part.column("language").to_numpy()[document].astype(np.int64)
            number = ts.SpanTable(1 << 62).numbers(codes, starts, ends, lambda first, at: None)
            keys, first, n = np.unique(number.astype(np.int64) * len(languages) + language, return_index=True, return_counts=True)
            texts = [codes[s:e].tobytes().decode("utf-32-le") for s, e in zip(starts[first], ends[first], strict=True)]
            own, documents = np.unique(part.column("language").to_numpy(), return_counts=True)
            found = np.append(keys % len(languages), own), texts + [None] * len(own), np.append(n, documents)  # documents: rows without a word
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int32()), pa.array(found[1], pa.string()), pa.array(found[2], pa.int64())], ["language", "word", "n"])

    counted = stable(sample.mapInArrow(count, "language int, word string, n long").groupBy("language", "word").agg(F.sum("n").alias("n")))
    drawn = {r["language"] for r in counted.where("word is null").select("language").collect()}
    if len(drawn) < len(languages):
        raise ValueError(f"no document was drawn of {sorted(set(languages) - {languages[i] for i in drawn})}; raise most_documents")
    counted = counted.where("word is not null")
    p = np.full((len(pieces) + 1, len(languages)), 1 / len(pieces))
    p[-1], name = RARE, f"lattice {path}"
    for _ in range(rounds):
        expected = np.zeros(p.shape)
        for part in counted.mapInArrow(_expectation(pieces, p, name), "language int, piece int, n double").groupBy("language", "piece").agg(F.sum("n").alias("n")).toArrow().to_batches():
            language, piece, n = (part.column(c).to_numpy() for c in ("language", "piece", "n"))
            expected[piece, language] = n
        expected = expected[:-1] + SMOOTHING
        p[:-1] = expected / expected.sum(axis=0)
    return Model(pieces, languages, p)


_workers: dict[str, object] = {}


def kept_by_worker(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once per worker process and kept until another name comes."""
    if name not in _workers:
        _workers.clear()
        _workers[name] = make()
    return _workers[name]


def _expectation(pieces: list[str], p: np.ndarray, name: str):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = kept_by_worker(name, lambda: Lattice(pieces)), np.zeros(p.shape)
        for batch in batches:
            codes, starts, ends, document, _ = word_spans(batch.column("word").to_pylist())
            language, n = batch.column("language").to_numpy()[document].astype(np.int64), batch.column("n").to_numpy()[document].astype(float)
            for which, words in in_parts(codes, starts, ends):
                total += lattice.expected(words, n[which], language[which], p)
        piece, language = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(language, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[piece, language])], ["language", "piece", "n"])

    return expect


class Scorer:
    """Log probabilities of words by language, each distinct word computed once and kept."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.known = ts.SpanTable(MOST_KEPT // max(1, len(model.languages)))
        self.kept = np.zeros((1024, len(model.languages)), np.float32)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text by language, and whether it has a letter."""
        codes, starts, ends, document, letters = word_spans(texts)

        def learn(first: int, at: np.ndarray) -> None:
            while first + len(at) > len(self.kept):
                self.kept = np.concatenate([self.kept, np.zeros_like(self.kept)])
            for which, words in in_parts(codes, starts[at], ends[at]):
                self.kept[first + which] = self.lattice.forward(words, self.model.p)[0]

        found = self.known.numbers(codes, starts, ends, learn) if self.model.languages else starts
        totals = [np.bincount(document, self.kept[found, k], len(texts)) for k in range(self.kept.shape[1])]
        return np.stack(totals, axis=1) if totals else np.zeros((len(texts), 0)), letters


def language_id(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``docs`` (doc_id, text; others unread).

    score is the posterior of lang_pred. A text that is null or has no letter is ``und`` with score 0,
    as is every text if the model knows no language. Equal posteriors go to the first language by
    name; repeated rows are predicted alike; an empty table gives an empty result.
    """

    name = f"scorer {uuid.uuid4().hex}"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept_by_worker(name, lambda: Scorer(model))
        names = np.array([*model.languages, "und"], object)
        for part in slices(batches):
            total, letters = scorer.scores(part.column("text").fill_null("").to_pylist())
            letters &= total.shape[1] > 0
            best = np.where(letters, total.argmax(axis=1) if total.shape[1] else 0, len(names) - 1)
            top = total.max(axis=1, keepdims=True) if total.shape[1] else np.zeros((len(best), 1))
            score = np.where(letters, 1 / np.maximum(np.exp(total - top).sum(axis=1), 1), 0.0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    predicted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
    return predicted.select("doc_id", F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
