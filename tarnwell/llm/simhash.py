"""SimHash near-duplicates by pigeonring filtering.

A fingerprint's 64 bits are a ring of three segments. If two fingerprints differ in at most two bits,
then, going round from some segment, the first segment differs in none, the first two in at most one
and all three in at most two: each prefix of the chain stays within its share of the budget
(``length * DISTANCE // SEGMENTS``). So every link is found from a segment that both share:

1. Distinct fingerprints are filed under each of their three segments; buckets of one are pruned.
2. Buckets of up to ``MOST`` members are compared in tasks: chains whose second segment goes beyond its
   budget are pruned before the full Hamming check, and each task returns a forest of the links.
3. Larger buckets are cut by the chain's second step: its members are filed under their second segment
   with one bit left out, once for each bit, so members of a bucket are within the step's budget.
4. Buckets that are still larger are cut by the last step: of the bits that are still free (the one
   left out and the last segment), two members differ in at most two exactly where a value within one
   bit of both exists. Members are filed under all values within one bit, of which no bucket can hold
   more than one a bit.

No step makes a row per pair, no bucket beyond ``MOST`` comes to a task, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .bytewords import PIECE, byte_table, word_lists
from .common import slices, stable, text_buffer
from .components import components, forest

TABLE = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
SEED, DISTANCE = 42, 2
#: Bits of the segments, from the highest on.
WIDTHS = (22, 21, 21)
SEGMENTS = len(WIDTHS)
#: Members of a bucket that one task compares.
MOST = 1024


def budget(length: int) -> int:
    """How many bits a chain of so many segments may differ in."""
    return length * DISTANCE // SEGMENTS


def shingle_hashes(data: bytes, k: int, piece: int = PIECE) -> Iterator[np.ndarray]:
    """XXH64 of the ``k``-word shingles of a translated text; fewer words are one shingle, none are none."""
    carry: list[bytes] = []
    whole = True
    for new in word_lists(data, piece):
        words = carry + new
        if len(words) >= k:
            whole = False
            shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
            yield np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - k + 1)
        carry = words[len(words) - k + 1 :] if len(words) >= k else words
    if whole and carry:
        yield np.array([xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def simhash(data: bytes, k: int, piece: int = PIECE) -> int:
    """The fingerprint of a translated text: each bit that over half of its shingles' hashes have."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(data, k, piece):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprinted(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and fingerprint (a long of the 64 bits) of each row."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = text_buffer(part.column("text"))
            translated = data.tobytes().translate(TABLE)
            found = np.array([simhash(translated[a:b], k) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(mark, "doc_id long, f long")


def turned(f: Column, start: int) -> Column:
    """The ring from segment ``start`` on, at the highest bits."""
    by = sum(WIDTHS[:start])
    return F.shiftleft(f, by).bitwiseOR(F.shiftrightunsigned(f, 64 - by)) if by else f


def chains(distinct: DataFrame) -> DataFrame:
    """(f, start, key, next, last) of each fingerprint (f) and each segment that a chain may start from."""
    parts = []
    for start in range(SEGMENTS):
        ring, (a, b, c) = turned(F.col("f"), start), (WIDTHS * 2)[start : start + SEGMENTS]
        key = F.shiftrightunsigned(ring, b + c).bitwiseOR(start << max(WIDTHS))
        parts.append(F.struct(F.lit(start).alias("start"), key.alias("key"), F.shiftrightunsigned(ring, c).bitwiseAND((1 << b) - 1).alias("next"), ring.bitwiseAND((1 << c) - 1).alias("last")))
    return distinct.select("f", F.inline(F.array(*parts)))


def by_size(rows: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` of the buckets of 2 to ``most`` members, and of larger ones; rows alone are pruned."""
    sizes = stable(rows.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1"))
    return tuple(rows.join(sizes.where(which).drop("size"), keys) for which in (F.col("size") <= most, F.col("size") > most))


def by_second_step(rows: DataFrame) -> DataFrame:
    """``rows`` once for each bit of the second segment, filed under that segment without the bit."""
    widths = [(WIDTHS * 2)[i + 1] for i in range(SEGMENTS)]
    bits = F.sequence(F.lit(0), F.element_at(F.array(*map(F.lit, widths)), F.col("start") + 1) - 1)
    rows = rows.withColumn("bit", F.explode(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    key = F.shiftleft(F.shiftleft("key", 5).bitwiseOR(F.col("bit")), max(WIDTHS)).bitwiseOR(F.col("next").bitwiseAND(F.bitwise_not(one)))
    free = F.shiftleft("last", 1).bitwiseOR(F.when(F.col("next").bitwiseAND(one) != 0, 1).otherwise(0))
    return rows.select("f", "start", key.alias("key"), free.alias("free"))


def by_last_step(rows: DataFrame) -> DataFrame:
    """``rows`` once for each value within one bit of those that are still free, filed under it."""
    values = [F.col("free"), *(F.col("free").bitwiseXOR(1 << b) for b in range(max(WIDTHS) + 1))]
    return rows.select("f", "start", "key", F.explode(F.array(*values)).alias("near"))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the links within buckets; rows come sorted by bucket, and an open bucket waits for its rest."""
    columns = ("f", "start", "key", "near")
    rest = {c: np.zeros(0, np.int64) for c in columns}
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: np.concatenate([rest[c], batch.column(c).to_numpy()]) for c in columns}
        opened = np.flatnonzero((now["key"] != now["key"][-1]) | (now["near"] != now["near"][-1]))
        to = opened[-1] + 1 if len(opened) else 0
        rest = {c: now[c][to:] for c in columns}
        yield from _forest_of({c: now[c][:to] for c in columns})
    yield from _forest_of(rest)


def _forest_of(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    f, n = rows["f"].view(np.uint64), len(rows["f"])
    turn = np.array([sum(WIDTHS[:i]) for i in range(SEGMENTS)], np.uint64)[rows["start"]]
    tail = np.array([64 - sum((WIDTHS * 2)[i : i + 2]) for i in range(SEGMENTS)], np.uint64)[rows["start"]]
    left, found = np.arange(n), []
    for step in count(1):  # all buckets at once: each member and the one so many places on
        left = left[left + step < n]
        left = left[(rows["key"][left] == rows["key"][left + step]) & (rows["near"][left] == rows["near"][left + step])]
        if not len(left):
            break
        differ = f[left] ^ f[left + step]
        by = turn[left]
        ring = (differ << by) | np.where(by > 0, differ >> ((np.uint64(64) - by) & np.uint64(63)), np.uint64(0))
        viable = np.bitwise_count(ring >> tail[left]) <= budget(2)
        near = left[viable][np.bitwise_count(differ[viable]) <= budget(SEGMENTS)]
        found.append((near, near + step))
    if found:
        a, b = (np.concatenate([pair[side] for pair in found]) for side in (0, 1))
        a, b = forest(rows["f"][a], rows["f"][b])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(distinct: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): links between distinct fingerprints (f), enough of them to connect all that are linked."""
    none = F.lit(0).cast("long")
    small, large = by_size(chains(distinct), ["key"], most)
    second, third = by_size(by_second_step(stable(large)), ["key"], most)
    filed = small.select("f", "start", "key", none.alias("near")).unionByName(second.select("f", "start", "key", none.alias("near")))
    last, _ = by_size(by_last_step(stable(third)), ["key", "near"], max(most, max(WIDTHS) + 2))  # none is larger than that
    filed = filed.unionByName(last.select("f", "start", "key", "near")).withColumn("start", F.col("start").cast("long"))
    return filed.repartition("key", "near").sortWithinPartitions("key", "near").mapInArrow(_links, "a long, b long")


def simhash_dedup(docs: DataFrame, k: int = 5, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of ``docs`` (doc_id, text; others unread).

    Documents are linked if their fingerprints differ in at most two bits; component_id is the least
    doc_id that links reach. Texts without words (null, empty) have the fingerprint zero and are linked
    by it like any other; texts of fewer than ``k`` words are one shingle; texts of any length count
    whole. Repeated rows and rows of one doc_id are linked by their texts alone; rows without a doc_id
    get their component's least doc_id, null where it has none. An empty table gives an empty result.
    """
    rows = stable(fingerprinted(docs, k))
    distinct = stable(rows.groupBy("f").agg(F.min("doc_id").alias("first")))
    roots = components(stable(links(distinct, most)))
    own = distinct.join(roots, F.col("f") == F.col("node"), "left").select("f", "first", F.coalesce("root", "f").alias("label"))
    least = own.groupBy("label").agg(F.min("first").alias("component_id"))
    found = rows.join(own.join(least, "label").select("f", "component_id"), "f")
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
