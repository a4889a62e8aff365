"""Helpers that the corpus operators share: tables, checkpoints and Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Lists of ids are broadcast up to this many rows.
MOST_BROADCAST = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, inside the one that ``spark.checkpoint.dir`` names.

    Where that is unset, a session in one process (``local[n]``, as in tests) takes a temporary folder;
    on a cluster it is an error, as no folder is known to be shared.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tarnwell-checkpoint-"))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/tarnwell-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's checkpoint folder; Spark's cleaner removes it
    where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a table of its own in the shared folder."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that this session wrote to the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows (of a few numbers each), else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def in_rows(df: DataFrame, **keys) -> DataFrame:
    """(row, keys): the columns of ``df`` as one struct, out of the way of the names of ``keys``."""
    return df.select(F.struct(*[F.col(named(c)) for c in df.columns]).alias("row"), *[k.alias(name) for name, k in keys.items()])


def named(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` where all ``keys`` are equal, null to null; keys come once."""
    other = right.withColumnsRenamed({k: f"right_{k}" for k in keys})
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"right_{k}" for k in keys])


def without_repeats(df: DataFrame, *keys: str) -> DataFrame:
    """One row of those that share all ``keys``; only rows that share them are shuffled if they are few."""
    twice = small(stable(df.groupBy(*keys).count().where("count > 1").select(*keys)))
    return matched(df, twice, list(keys), "left_anti").unionByName(matched(df, twice, list(keys), "left_semi").dropDuplicates(list(keys)))


def crc_remainder(column: str, modulus: int):
    """crc32 of a column's text form, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


#: Shares are compared with hashes of so many values, so that the share of a billionth of a table is not none.
SHARES = 1 << 62


def in_share(key: Column, share: Column) -> Column:
    """Whether a row belongs to a share (0 to 1, in :data:`SHARES`) of all rows, by the hash of its key."""
    return F.pmod(F.xxhash64(key), F.lit(SHARES)) < share


def text_hash(text: str = "text") -> Column:
    """Tells apart rows of one doc_id (or of none); null counts as empty."""
    return F.xxhash64(F.lit(1), F.coalesce(F.col(text), F.lit("")))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, values = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def slices(batches: Iterator[pa.RecordBatch], *text: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``most_bytes`` of the text columns, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.zeros(batch.num_rows, np.int64)
        for name in text or ("text",):
            sizes = batch.column(name).fill_null("").cast(pa.large_string())
            own = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
            ends += own[1:] - own[0]
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to
