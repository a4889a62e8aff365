"""Cost-balanced packing of tokenised documents into sequences of a fixed capacity.

A document's ids are cut into full sequences and a rest. Rests are dealt by hash into shards of about
``SHARD_TOKENS`` tokens. In a shard there are as many sequences as its tokens need at least; rests go, in
falling order of length, to the sequence of the lowest estimated attention cost (a linear part for
the tokens, a quadratic part for attention within each piece) that still has room for all of it. A
rest that fits nowhere is cut over the sequences with the most room. So a shard pads by less than one
sequence in all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .token_model import encoder

CAPACITY, SHARD_TOKENS = 1024, 1 << 20
#: Bytes of text that a task encodes at a time; its arrays take some hundred bytes for each.
SLICE = 1 << 18
LINEAR, QUADRATIC = 1.0, 1.0 / 512
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def assigned(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start in it, length, sequence, offset in it) for documents shorter than ``capacity``."""
    n = int(-(-lengths.sum() // capacity))
    cost, room = np.zeros(n), np.full(n, capacity)
    out = []

    def put(i: int, start: int, length: int, to: int) -> None:
        out.append((i, start, length, to, capacity - int(room[to])))
        room[to] -= length
        cost[to] += LINEAR * length + QUADRATIC * length * length

    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        to = int(np.argmin(np.where(room >= length, cost, np.inf)))
        if room[to] >= length:
            put(int(i), 0, length, to)
            continue
        start = 0
        while start < length:
            to = int(np.argmax(room))
            part = min(length - start, int(room[to]))
            put(int(i), start, part, to)
            start += part
    return out


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, with_ids: bool) -> DataFrame:
    """Full pieces (their ids only if asked for) and rests (with ids) of each row of ``docs``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most_bytes=SLICE):
            ids, at = encoder(vocabulary).encode(part.column("text").fill_null("").to_pylist())
            ids = np.insert(ids, at[1:], end_id).astype("<u4")
            at = at + np.arange(len(at))
            rows = []
            for doc_id, a, b in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for s in range(a, b, capacity):
                    own = ids[s : min(s + capacity, b)]
                    raw = own.tobytes()
                    rows.append((doc_id, s - a, len(own), zlib.crc32(raw), b - a, raw if with_ids or len(own) < capacity else None))
            columns = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r[-1] for r in rows], pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE)


def packed(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text; others unread) with their place: sequence_id and offset.

    Null texts count as empty and have the end id only. Repeated rows, and rows without a doc_id, are
    documents of their own. ``with_ids`` fills ids (little-endian 32 bits) of full pieces too, for
    writing the sequences. An empty table gives an empty result.

    Texts are encoded once and their pieces written; full pieces are numbered where they are, only rests
    are dealt. Sequences of full pieces have even numbers, those of rests odd ones.
    """
    pieces = written(token_pieces(docs, vocabulary, end_id, capacity, with_ids))
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.monotonically_increasing_id() * 2, "offset": F.lit(0).cast("long")})
    rests = pieces.where(F.col("length") < capacity)
    shards = max(1, -(-(rests.agg(F.sum("length")).first()[0] or 0) // SHARD_TOKENS))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("ids_crc32", "ascending"), ("start", "ascending")])
        base, ids = table.column("shard")[0].as_py() << 32, table.column("ids")
        rest, start, length, to, offset = np.array(assigned(table.column("length").to_numpy(), capacity), np.int64).T
        cut = [ids[r].as_py()[4 * s : 4 * (s + n)] for r, s, n in zip(rest.tolist(), start.tolist(), length.tolist(), strict=True)]
        whole = table.take(pa.array(rest))
        columns = {
            "doc_id": whole.column("doc_id"), "start": pa.array(whole.column("start").to_numpy() + start), "length": pa.array(length), "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64()),
            "doc_tokens": whole.column("doc_tokens"), "sequence_id": pa.array(2 * (base + to) + 1), "offset": pa.array(offset), "ids": pa.array(cut, pa.binary()),
        }
        return pa.table(columns)

    dealt = rests.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return full.unionByName(dealt.groupBy("shard").applyInArrow(pack, PACKED))
