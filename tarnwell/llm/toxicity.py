"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A document is a bag of units: its sentences (ended by ``.``, ``!``, ``?`` or a line end), long ones
cut every ``UNIT_WORDS`` words. A unit's score is the logistic of a bias and the weights of its
words, each word standing for itself and for its first 4, 5 and 6 letters. A document's score is the
noisy-or of its units and of a leak that stands for labels which no sentence explains; a unit without
a weighted word scores 0, so a clean text stays clean however long it is::

    score = 1 - (1 - leak) * product over units of (1 - unit score)

so training on document labels alone teaches which sentences are to blame, and :func:`offending`
returns them.

Fitting uses a sample of at most about ``most_labels`` labelled documents and ``most_bytes`` of their
text, drawn by a hash of doc_id; texts of more than ``LONGEST`` bytes are not drawn. Weights are tried for the ``features`` features whose counts in the sample differ most between the two
labels; their counting is a distributed aggregate, and only the sample's occurrences of those
features go to the driver. A lasso leaves few of them, and those of positive weight are fitted again.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import SHARES, crc_remainder, in_share, slices, small, stable, written

PREFIXES = (4, 5, 6)
UNIT_WORDS = 32
MOST_LABELS, MOST_BYTES, LONGEST, FEATURES, LEAST_DOCUMENTS = 20_000, 64 << 20, 1 << 20, 8192, 3
ENDS = np.array([ord(c) for c in ".!?\n"], np.uint32)


def _kind(c: str) -> int:
    return ts.LETTER if unicodedata.category(c)[0] in "LM" else ts.OTHER


_classes = ts.Classes(_kind)
_lower = ts.Lower()


@dataclass
class Words:
    """The words of some texts: where they are, their text, their unit and their features (0: none)."""

    starts: np.ndarray
    ends: np.ndarray
    document: np.ndarray
    unit: np.ndarray
    features: np.ndarray
    unit_document: np.ndarray
    breaks: np.ndarray


def words_of(texts: list[str]) -> Words:
    codes = _lower.of(ts.code_points(texts))
    kinds = _classes.of(codes)
    starts, ends = ts.runs(kinds == ts.LETTER)
    breaks = np.flatnonzero(kinds == ts.SEPARATED)
    document = np.searchsorted(breaks, starts)
    sentence = np.cumsum(np.isin(codes, ENDS) | (kinds == ts.SEPARATED))[starts]
    fresh = np.append(True, sentence[1:] != sentence[:-1]) if len(starts) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(starts)), 0)) if len(starts) else starts
    fresh |= (np.arange(len(starts)) - first) % UNIT_WORDS == 0
    unit = np.cumsum(fresh) - 1
    features = np.zeros((1 + len(PREFIXES), len(starts)), np.uint64)
    features[0] = ts.span_hashes(codes, starts, ends)
    for k, n in enumerate(PREFIXES, 1):
        longer = ends - starts > n
        # a prefix is another feature than the word of the same letters
        features[k, longer] = ts.mixed(ts.span_hashes(codes, starts[longer], starts[longer] + n) + np.uint64(k))
    return Words(starts, ends, document, unit, features, document[fresh], breaks)


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float
    leak: float

    def index(self) -> ts.HashIndex:
        index = ts.HashIndex()
        index.put(self.keys, np.arange(len(self.keys), dtype=np.int32))
        return index

    def unit_scores(self, words: Words, index: ts.HashIndex) -> np.ndarray:
        """The logit of each unit, minus infinity where it has no weighted word."""
        z, weighted = np.full(len(words.unit_document), self.bias), np.zeros(len(words.unit_document), bool)
        for row in words.features:
            found = index.get(row) if len(self.keys) else np.full(len(row), -1)
            hit = np.flatnonzero((found >= 0) & (row != 0))
            z += np.bincount(words.unit[hit], self.weights[found[hit]], len(z))
            weighted[words.unit[hit]] = True
        return np.where(weighted, z, -np.inf)

    def scores(self, words: Words, z: np.ndarray) -> np.ndarray:
        clean = np.bincount(words.unit_document, np.logaddexp(0, z), len(words.breaks))
        return np.clip(1 - (1 - self.leak) * np.exp(-clean), 0, 1)


def fitted(y: np.ndarray, bare: np.ndarray | None, document: np.ndarray, unit: np.ndarray, feature: np.ndarray, start: np.ndarray, steps: int = 300, rate: float = 0.05, ridge: float = 0.02, lasso: float = 0.7) -> tuple[np.ndarray, float, float]:
    """(weights, bias, leak) by gradient ascent (Adam) on the likelihood of the document labels.

    document, unit, feature: of each occurrence, in order of unit. The lasso pulls the weights of all but the features
    that explain the labels to 0: a step ends with the soft threshold of its own size. bare: number of
    each document's units without an occurrence, which share the bias; if None, such units score 0, no
    weight may be negative and the bias stays as it is.
    """
    fresh = np.append(True, unit[1:] != unit[:-1]) if len(unit) else np.zeros(0, bool)
    unit, owner = np.cumsum(fresh, dtype=np.int32) - np.int32(1), document[fresh]
    x = np.concatenate([start, [-6.0, -4.0] if bare is not None else [-4.0, -3.0]])
    lowest, free = (-np.inf, 1.0) if bare is not None else (0.0, 0.0)
    bare = np.zeros(len(y)) if bare is None else bare - np.bincount(owner, minlength=len(y))
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        w, bias, leak = x[:-2], x[-2], x[-1]
        z = bias + np.bincount(unit, w[feature], len(owner))
        clean = np.bincount(owner, np.logaddexp(0, z), len(y)) + bare * np.logaddexp(0, bias) + np.logaddexp(0, leak)
        toxic = np.maximum(-np.expm1(-clean), 1e-12)
        pull = np.where(y == 1, np.exp(-clean) / toxic, -1.0)
        share = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        dz = pull[owner] * share
        low = 1 / (1 + np.exp(-bias))
        grad = np.concatenate([np.bincount(feature, dz[unit], len(w)), [free * (dz.sum() + (pull * bare).sum() * low), pull.sum() / (1 + np.exp(-leak))]]) / len(y)
        grad[:-2] -= ridge / len(y) * w
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        size = rate / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        x = x + size * first / (1 - 0.9**step)
        x[:-2] = np.maximum(np.sign(x[:-2]) * np.maximum(np.abs(x[:-2]) - size[:-2] * lasso / len(y), 0), lowest)
    return x[:-2], float(x[-2]), float(1 / (1 + np.exp(-x[-1])))


def sampled(docs: DataFrame, labels: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """(text, toxic) of labelled documents, written once: about ``most`` of them and ``most_bytes`` at
    most, by a hash of doc_id; all where there are not so many. A label of which none is drawn is an error."""
    sizes = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    total = sizes.where(F.col("size") <= LONGEST).join(labels, "doc_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.collect_set("toxic").alias("kinds")).first()
    share = min(1.0, most / max(1, total["n"]), most_bytes / max(1, total["size"]))
    if share < 1:
        labels = labels.where(in_share(F.col("doc_id"), F.lit(int(SHARES * share))))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= LONGEST)
    sample = written(rows.join(small(labels), "doc_id").select("text", "toxic"))
    if {r["toxic"] for r in sample.select("toxic").distinct().collect()} != set(total["kinds"]):
        raise ValueError("no document of one label was drawn; raise most_labels or most_bytes")
    return sample


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, features: int = FEATURES, most_bytes: int = MOST_BYTES) -> Model:
    """A model of labels.toxic from the texts of labelled rows whose crc32(doc_id) mod 5 is not 0.

    Rows with a null label are not used; of several labels of a document the highest counts. Without
    labels of both kinds the model has no weights and gives every text the share of toxic labels.
    """
    usable = labels.where("toxic is not null and doc_id is not null").where(crc_remainder("doc_id", 5) != 0)
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = sampled(docs, stable(usable), most_labels, most_bytes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = words_of(part.column("text").to_pylist())
            y = part.column("toxic").to_numpy()
            flat = words.features.ravel()
            real = flat != 0
            pairs = pd.DataFrame({"feature": flat[real].view(np.int64), "document": np.tile(words.document, len(words.features))[real]}).drop_duplicates()
            pairs["toxic"] = y[pairs["document"]]
            own = pairs.groupby("feature")["toxic"].agg(["sum", "count"]).reset_index()
            yield pa.RecordBatch.from_arrays([pa.array(own[c].astype("int64")) for c in own], ["feature", "toxic", "n"])

    counted = sample.mapInArrow(count, "feature long, toxic long, n long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    base = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if not 0 < base["toxic"] < base["n"]:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -50.0, base["toxic"] / base["n"] if base["n"] else 0.0)
    p = base["toxic"] / base["n"]
    z = (F.col("toxic") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    kept = counted.where(F.col("n") >= LEAST_DOCUMENTS).withColumn("z", z).orderBy(F.abs("z").desc(), "feature").limit(features).toPandas()
    keys = kept["feature"].to_numpy(np.int64).view(np.uint64)
    odds = np.log((kept["toxic"] + 0.5) / (kept["n"] - kept["toxic"] + 0.5) * (1 - p) / p).to_numpy(float)
    start = np.where(np.abs(kept["z"]) > 3, odds / 2, 0.0)
    model = Model(keys, start, -6.0, 0.02)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.index()
        for part in slices(batches):
            words = words_of(part.column("text").to_pylist())
            found = index.get(words.features.ravel()) if len(keys) else np.zeros(0, np.int32)
            hit = np.flatnonzero((found >= 0) & (words.features.ravel() != 0))
            word = hit % max(1, words.features.shape[1])
            order = np.argsort(words.unit[word], kind="stable")
            unit, feature = words.unit[word][order], found[hit][order]
            at = np.searchsorted(words.document[word][order], np.arange(part.num_rows + 1))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (unit, feature)]
            n = np.bincount(words.unit_document, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(n, pa.int32()), *lists], ["toxic", "units", "unit", "feature"])

    rows = sample.mapInArrow(occurrences, "toxic int, units int, unit array<int>, feature array<int>").toArrow()
    units, y = rows.column("units").to_numpy(), rows.column("toxic").to_numpy()
    sizes = rows.column("feature").combine_chunks().value_lengths().to_numpy()
    feature = rows.column("feature").combine_chunks().flatten().to_numpy()
    unit = rows.column("unit").combine_chunks().flatten().to_numpy().copy()
    del rows
    document = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    # units are numbered within the part that a task read at once; two documents never share one here
    unit = np.cumsum(np.append(0, (unit[1:] != unit[:-1]) | (document[1:] != document[:-1])), dtype=np.int32) if len(unit) else unit
    weights, _, _ = fitted(y, units, document, unit, feature, start)
    # the features that explain toxic labels are fitted again by themselves
    chosen = weights > 0.1
    place, own = np.cumsum(chosen) - 1, chosen[feature]
    again, bias, leak = fitted(y, None, document[own], unit[own], place[feature[own]], weights[chosen])
    return Model(keys[chosen][again > 0], again[again > 0], bias, leak)


def toxicity_scores(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text; others unread).

    Null and empty texts have no unit, so their score is the leak. Repeated rows score alike; an empty
    table gives an empty result.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.index()
        for part in slices(batches):
            words = words_of(part.column("text").fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(words, model.unit_scores(words, index)))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")
    held_out = F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def offending(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The units whose own score reaches ``threshold``: doc_id, start, end (code points of the text as
    it is), score, unit text. Null and empty texts have none; repeated rows each have theirs; an empty
    table gives an empty result."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.index()
        for part in slices(batches):
            texts = part.column("text").fill_null("").to_pylist()
            words = words_of(texts)
            z = model.unit_scores(words, index)
            bad = np.flatnonzero(1 / (1 + np.exp(-z)) >= threshold)
            first, last = np.searchsorted(words.unit, bad), np.searchsorted(words.unit, bad, "right") - 1
            document = words.unit_document[bad]
            base = np.append(0, words.breaks + 1)[document]
            start, end = words.starts[first] - base, words.ends[last] - base
            ids = part.column("doc_id").to_pylist()
            found = [texts[d][s:e] for d, s, e in zip(document, start, end, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in document], pa.int64()), pa.array(start), pa.array(end), pa.array(1 / (1 + np.exp(-z[bad]))), pa.array(found, pa.string())], ["doc_id", "start", "end", "score", "unit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(locate, "doc_id long, start long, end long, score double, unit string")


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all their columns, whose score stays below ``threshold``.

    Null and empty texts score as :func:`toxicity_scores` says and so stay; repeated rows stay or go
    alike; an empty table stays empty.
    """
    model = fit(docs, labels)
    # Python tasks get columns by plain names, whatever those of the table are
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index('text')}"

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.index()
        for part in slices(batches, text):
            words = words_of(part.column(text).fill_null("").to_pylist())
            yield part.filter(pa.array(model.scores(words, model.unit_scores(words, index)) < threshold))

    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
