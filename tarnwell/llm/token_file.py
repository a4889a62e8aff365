"""Token ids of a corpus in a binary file format, in ascending order of doc_id.

A token file is a folder that Spark's committer writes, so a lost executor leaves no half record. A
record holds some documents of a shard: their ids one after the other, Simple-8b coded (see
:mod:`simple8b`) after each id was replaced by its rank by frequency within the record, the table of
those ranks, the first word of every block, and each document's doc_id and number of ids. Shards are
ranges of doc_id, and a record says how many ids of its shard come before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices
from .simple8b import pack, unpack
from .token_model import encoder

RECORD = "shard int, record int, before long, n_ids long, doc_ids array<long>, n_tokens array<long>, ranks binary, words binary, blocks binary, escapes binary"
DOCUMENT = "shard int, doc_id long, within long, n_tokens long, ids_crc32 long"


def coded(ids: np.ndarray) -> dict[str, bytes]:
    if len(ids) and ids.max() < 1 << 22:
        counts = np.bincount(ids)
        table = np.flatnonzero(counts)
        table = table[np.argsort(-counts[table], kind="stable")]
        rank = np.zeros(len(counts), np.uint64)
        rank[table] = np.arange(len(table))
        ranks = rank[ids]
    else:
        table, ranks = np.unique(ids, return_inverse=True)
    words, blocks, escapes = pack(ranks)
    kinds = {"ranks": (table, "<u4"), "words": (words, "<u8"), "blocks": (blocks, "<u4"), "escapes": (escapes, "<u8")}
    return {k: v.astype(kind).tobytes() for k, (v, kind) in kinds.items()}


def decoded(ranks: bytes, words: bytes, blocks: bytes, escapes: bytes, n: int) -> np.ndarray:
    kinds = ((ranks, "<u4"), (words, "<u8"), (blocks, "<u4"), (escapes, "<u8"))
    table, words, blocks, escapes = (np.frombuffer(b, k) for b, k in kinds)
    return table[unpack(words.astype(np.uint64), blocks.astype(np.int64), escapes, n)]


def write_token_file(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2) -> None:
    """Encode ``docs`` (doc_id, text; others unread) and write a token file to ``path``.

    Every document ends with ``end_id``. Null texts count as empty; null ids come first; rows of one
    doc_id (or of none) go by a hash of their text, then by text, so that many of them still make many
    shards. An empty table gives a file without records.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        for record, part in enumerate(slices(batches)):
            ids, at = encoder(vocabulary).encode(part.column("text").fill_null("").to_pylist())
            ids = np.insert(ids, at[1:], end_id)
            n = np.diff(at) + 1
            row = {"shard": shard, "record": record, "before": before, "n_ids": len(ids), "doc_ids": part.column("doc_id").to_pylist(), "n_tokens": n.tolist()}
            row |= coded(ids)
            before += len(ids)
            types = {"shard": pa.int32(), "record": pa.int32(), "doc_ids": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([pa.array([v], types.get(k)) for k, v in row.items()], list(row))

    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    ordered.mapInArrow(encode, RECORD).write.parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of a token file's documents.

    Rows of one doc_id and rows without one are read back as they were written; a file without records
    gives an empty result.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decoded(row["ranks"], row["words"], row["blocks"], row["escapes"], row["n_ids"]).astype("<u4")
                n = np.array(row["n_tokens"], np.int64)
                end = np.cumsum(n)
                crc = [zlib.crc32(ids[e - k : e]) for e, k in zip(end, n, strict=True)]
                columns = [pa.array([row["shard"]] * len(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["before"] + end - n), pa.array(n), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "within", "n_tokens", "ids_crc32"])

    records = spark.read.parquet(path)
    # one row per shard, so the running total is over as many rows as the file has shards
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = records.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).select("shard", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("base"))
    return records.mapInArrow(decode, DOCUMENT).join(shards, "shard").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
