"""Importance resampling towards a target distribution, by hashed runs of words.

1. A 256-byte table lower-cases A-Z and blanks separators in the UTF-8 bytes; ``bytes.split`` gives the
   words. The crc32 of a run of words is the crc32 of its last word seeded with that of the run before
   it, so runs of n words cost one call more than those of n - 1. Counters reduce the crc32s of a slice,
   then its buckets, then Spark sums the tasks' buckets: at most ``buckets`` rows from each task.
2. A bucket's gain is the logarithm of its share in the target over its share in all documents; the
   gains, one number a bucket, go to all tasks, which add them up over each document.
3. Gumbel noise from the document's id makes the highest scores a draw without replacement. Ranks come
   from a sort over ranges of score and the sizes of the ranges before.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import PIECE, byte_table, word_lists
from .common import slices, stable, text_buffer

#: Everything in ASCII but letters and digits separates words.
TABLE = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
WEIGHED = "doc_id long, n_words long, n_features long, weight long"


def run_hashes(data: bytes, n: int, piece: int = PIECE) -> Iterator[tuple[int, list[int]]]:
    """(number of words, crc32s of a number of runs) for each piece of a translated text: all runs of 1 to ``n`` words."""
    carry: list[bytes] = []
    for new in word_lists(data, piece):
        words, old = carry + new, len(carry)
        crcs = list(map(crc32, words))
        found = crcs[old:]
        if n > 1:
            spaced = [b" " + w for w in words]
            for size in range(2, n + 1):
                crcs = list(map(crc32, spaced[size - 1 :], crcs))
                found += crcs[max(0, old - size + 1) :]  # those before lie in the piece before
            carry = words[1 - n :]
        yield len(new), found


def _rows(part: pa.RecordBatch) -> Iterator[bytes]:
    data, offsets = text_buffer(part.column("text"))
    translated = data.tobytes().translate(TABLE)
    for i in range(part.num_rows):
        yield translated[offsets[i] : offsets[i + 1]]


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """(bucket, count) over all runs of all texts; buckets without a run are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for part in slices(batches):
            own: Counter[int] = Counter()
            for text in _rows(part):
                for _, found in run_hashes(text, n):
                    own.update(found)
                    if len(own) > PIECE:  # a very long text: no more crc32s at a time than a slice has
                        _fold(own, total, buckets)
            _fold(own, total, buckets)
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64())], ["bucket", "count"])

    return texts.select("text").mapInArrow(count, "bucket int, count long").groupBy("bucket").agg(F.sum("count").alias("count"))


def _fold(own: Counter[int], total: Counter[int], buckets: int) -> None:
    for crc, n in own.items():
        total[crc % buckets] += n
    own.clear()


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """Each bucket's gain, from (bucket, count) of both sides: at most ``buckets`` rows of each come to the driver."""
    s, t = (dict(map(tuple, side.collect())) for side in (source, target))
    all_s, all_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return [math.floor(1000 * math.log((t.get(b, 0) + 1.0) * all_s / ((s.get(b, 0) + 1.0) * all_t))) for b in range(buckets)]


def weighed(docs: DataFrame, gain: list[int], n: int) -> DataFrame:
    """doc_id, n_words, n_features, weight (the sum of the gains of all features) of each row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = len(gain)
        for part in slices(batches):
            words, features, weights = [], [], []
            for text in _rows(part):
                n_words = n_features = weight = 0
                for new, found in run_hashes(text, n):
                    n_words += new
                    n_features += len(found)
                    weight += sum(gain[crc % buckets] * times for crc, times in Counter(found).items())
                words.append(n_words)
                features.append(n_features)
                weights.append(weight)
            columns = [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (words, features, weights))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(weigh, WEIGHED)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the id; rows without an id have that of the empty id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` (already stable) with their ``rank`` from 1 on: sorted in ranges, each after the rows of the ranges before."""
    # the last key splits ranges even where rows are equal
    ordered = stable(rows.withColumn("_row", F.monotonically_increasing_id()).orderBy(*order, "_row").drop("_row"))
    placed = ordered.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    base = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(base), "_part").withColumn("rank", F.col("_base") + F.col("_place") + 1).drop("_part", "_place", "_base")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of ``docs`` (doc_id, text; others unread).

    ``target`` has a column text. Of the documents with at least ``least_words`` words, the
    ``percent`` hundredths (rounded down) of the highest score are drawn and ranked from 1 on; rank is
    null for all others. Ties go to the lesser doc_id, rows without one come last, then by fewer
    features. Null and empty texts have no features and weigh 0; repeated rows are documents of their
    own and may be drawn each; texts of any length count whole. Without documents the result is empty;
    without a target, gains come from the documents alone.
    """
    source = bucket_counts(docs, n, buckets)
    rows = stable(weighed(docs, gains(source, bucket_counts(target, n, buckets), buckets), n))
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    enough = rows.where(F.col("n_words") >= least_words)
    drawn = percent * enough.count() // 100
    places = ranked(enough, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"))
    places = places.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return places.unionByName(others).select("doc_id", "n_features", "weight", "score", "rank")
