"""Tokens of two tokenizers over the same bytes: overlapping pairs, groups of common ends, and counts of pairs.

1. Both sides' tokens are spelled out as bytes and, where both spell the text, placed on it. For each
   batch ``pandas.merge_asof``, keyed by document, finds the other side's token that covers each token's
   start, in both directions; the union of the directions is all pairs that overlap. Ends that both
   sides have cut a document into groups.
2. Documents with their pairs are written once. Spark counts the documents of each pair of ids.
3. Counts go back to the pairs by a broadcast of the most frequent pairs, of a bounded number, and by a
   shuffled join for the pairs beyond, which by their rareness are few; sums come back to the documents.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from . import textscan as ts
from .common import MOST_BROADCAST, shared_folder, slices, stable, text_buffer
from .token_model import Encoder, byte_alphabet

#: So many tokens of one side are aligned at a time; texts are cut where both sides end a token.
CHUNK = 1 << 17
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>"


class Spelling:
    """The bytes of each token id."""

    def __init__(self, tokens: list[bytes]):
        self.n = len(tokens)
        self.length = np.fromiter(map(len, tokens), np.int64, self.n)
        self.at = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ts.flat(self.at[ids], self.at[ids] + self.length[ids])[0]]


class ByteSide(Encoder):
    """A byte-level vocabulary over a blank and the text; strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.special, self.tokenizer.encode_special_tokens = [], True
        back = {c: b for b, c in byte_alphabet().items()}
        with open(path, encoding="utf-8") as f:
            added = {t["id"]: t["content"].encode() for t in json.load(f).get("added_tokens") or []}
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            tokens[i] = added[i] if i in added else bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
        self.spelling = Spelling(tokens)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return super().encode([f" {t}" for t in texts])


class PieceSide(Encoder):
    """A sentencepiece vocabulary, whose encoder adds the blank itself.

    Where no piece holds a blank after another character and the text is taken as it is, no merge of
    BPE crosses from a character to the blank after it. Then each run of blanks with what follows is
    encoded by itself, each distinct one once per worker; otherwise texts are encoded whole.
    """

    def __init__(self, path: str):
        self.library = SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        own = model.normalizer_spec
        as_is = own.add_dummy_prefix and not own.remove_extra_whitespaces and not own.precompiled_charsmap
        bpe = model.trainer_spec.model_type == model.trainer_spec.BPE and not model.trainer_spec.treat_whitespace_as_suffix
        self.fast = bool(as_is and bpe and not any("▁" in n.lstrip("▁") for n in names))
        self.spelling = Spelling([bytes([int(n[1:-1], 16)]) if self.library.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])
        # a blank at a text's end stands alone; the library adds none to an empty text
        self.blank = self.library.encode("a ")[len(self.library.encode("a")) :]
        self.reset()

    def spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        codes = ts.code_points([f" {t}" for t in texts])
        blank, apart = codes == 0x20, codes == ord(ts.SEPARATOR)
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        starts = np.flatnonzero(start)
        breaks = np.flatnonzero(apart)
        # a span ends at the next start or at the text's end
        stop = np.sort(np.concatenate([starts, breaks]))
        ends = stop[np.searchsorted(stop, starts, "right")] if len(starts) else starts
        return codes, starts, ends, np.append(0, np.searchsorted(starts, breaks))

    def merged(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        words = [codes[a + 1 : b].tobytes().decode("utf-32-le") for a, b in zip(starts, ends, strict=True)]
        found = self.library.encode(words, num_threads=1) if words else []
        return [ids if w else self.blank for w, ids in zip(words, found, strict=True)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.fast:
            return super().encode(texts)
        lists = self.library.encode(texts, num_threads=1) if texts else []
        ends = np.cumsum([0, *map(len, lists)])
        return np.fromiter((i for x in lists for i in x), np.uint32, int(ends[-1])), ends


@lru_cache(maxsize=4)
def side(path: str) -> ByteSide | PieceSide:
    """One encoder per worker process and file: sentencepiece for .model, else byte-level."""
    return PieceSide(path) if path.endswith(".model") else ByteSide(path)


def spells(own: Spelling, ids: np.ndarray, at: np.ndarray, target: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text's tokens, put together, are its bytes in ``target``."""
    length = np.append(0, np.cumsum(own.length[ids]))
    sizes = np.diff(length[at])
    right = (sizes == np.diff(offsets)) & (sizes > 1)  # a blank alone is an empty text
    data = own.bytes_of(ids)
    right[right] = ts.equal_spans(data, length[at[:-1]][right], target, offsets[:-1][right], sizes[right])
    return right


class Placed:
    """The tokens of one side on the bytes of the texts that both sides spell."""

    def __init__(self, own: Spelling, ids: np.ndarray, at: np.ndarray, right: np.ndarray):
        keep = np.repeat(right, np.diff(at))
        self.ids = ids[keep].astype(np.int64)
        self.doc = np.repeat(np.arange(len(right)), np.diff(at))[keep]
        length = own.length[self.ids]
        self.end = np.cumsum(length)
        self.start = self.end - length

    def frame(self, name: str, a: int, b: int) -> pd.DataFrame:
        return pd.DataFrame({"doc": self.doc[a:b], "at": self.start[a:b], name: np.arange(a, b)})


def overlaps(a: Placed, b: Placed, same: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens (their places) whose bytes overlap, in order of a and b; ``same``: the common ends."""
    if not len(same):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    to_a, to_b = (np.searchsorted(s.end, same, "right") for s in (a, b))
    cuts = np.unique(np.append(np.searchsorted(to_a, np.arange(chunk, to_a[-1], chunk)), len(same) - 1))
    found, from_a, from_b = [], 0, 0
    for cut in cuts:
        x, y = a.frame("a", from_a, to_a[cut]), b.frame("b", from_b, to_b[cut])
        down = pd.merge_asof(x, y, on="at", by="doc")  # the b that covers the start of each a
        up = pd.merge_asof(y, x, on="at", by="doc")
        up = up[a.start[up["a"]] < up["at"]]  # equal starts are in the other direction
        pairs = pd.concat([down[["a", "b"]], up[["a", "b"]]]).sort_values("a", kind="stable")  # two runs in order; b follows
        found.append(pairs.to_numpy(np.int64))
        from_a, from_b = to_a[cut], to_b[cut]
    pairs = np.concatenate(found)
    return pairs[:, 0], pairs[:, 1]


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = side(path_a), side(path_b)
        # what is written for each id inside a group and at its end, for both sides
        self.signs = [f"{i}{s}" for own, signs in ((self.a, ",|"), (self.b, ",;")) for s in signs for i in range(own.spelling.n)]

    def digests(self, a: Placed, b: Placed, same: np.ndarray, n: int) -> list[str]:
        """The sha256 of each text's groups, '' without any."""
        sizes = self.a.spelling.n, self.b.spelling.n
        group_a, group_b = (np.searchsorted(same, s.end) for s in (a, b))
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (group_a, group_b))
        code = np.concatenate([a.ids + sizes[0] * last_a, 2 * sizes[0] + b.ids + sizes[1] * last_b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        code = code[order]
        at = np.append(0, np.cumsum(np.bincount(a.doc, minlength=n) + np.bincount(b.doc, minlength=n)))
        signs = self.signs
        return [hashlib.sha256("".join([signs[c] for c in code[x:y].tolist()])[:-1].encode()).hexdigest() if y > x else "" for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def align(self, part: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
        texts, n = part.column("text").fill_null(""), part.num_rows
        strings = texts.to_pylist()
        target, offsets = self._prefixed(text_buffer(texts))
        coded = [s.encode(strings) for s in (self.a, self.b)]
        right = np.ones(n, bool)
        for own, (ids, at) in zip((self.a, self.b), coded, strict=True):
            right &= spells(own.spelling, ids, at, target, offsets)
        a, b = (Placed(own.spelling, ids, at, right) for own, (ids, at) in zip((self.a, self.b), coded, strict=True))
        same = np.intersect1d(a.end, b.end, assume_unique=True)
        x, y = overlaps(a, b, same)
        links, doc = a.ids[x] * self.b.spelling.n + b.ids[y], a.doc[x]
        n_links = np.bincount(doc, minlength=n)
        groups = np.bincount(a.doc[np.searchsorted(a.end, same)], minlength=n)
        pairs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_links)), pa.int32()), pa.array(links))
        counts = (np.bincount(a.doc, minlength=n), np.bincount(b.doc, minlength=n), groups, n_links)
        columns = [pa.array(rows), part.column("doc_id"), *map(pa.array, counts), pa.array(self.digests(a, b, same, n)), pairs]
        return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    @staticmethod
    def _prefixed(text: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes, a blank before each."""
        data, offsets = text
        return np.insert(data, offsets[:-1], 0x20), offsets + np.arange(len(offsets))


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Each row of ``docs`` with its numbers of tokens, groups and links, the digest of its groups, and its
    linked pairs (id of a times b's number of ids, plus id of b; one for each link), as a written table."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        for part in slices(batches):
            yield own.align(part, np.arange(row, row + part.num_rows))
            row += part.num_rows

    path = shared_folder(docs.sparkSession)
    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(align, ALIGNED).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(ALIGNED).parquet(path)


def pair_counts(found: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): in how many documents each pair is linked, and whether no pair of its a has more."""
    counts = stable(found.select(F.explode(F.array_distinct("pairs")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    own = F.floor(F.col("pair") / n_b).cast("int")
    most = counts.groupBy(own.alias("a")).agg(F.max("n").alias("most"))  # a row for each id of one vocabulary
    return counts.join(F.broadcast(most), own == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, most: int) -> int:
    """The least power of two so that at most ``most`` pairs have that count or more; 1 if all may."""
    by_power = dict(map(tuple, counts.groupBy(F.floor(F.log2("n")).alias("p")).count().collect()))  # 63 rows at most
    power, total = 64, 0
    while power and total + by_power.get(power - 1, 0) <= most:
        power -= 1
        total += by_power.get(power, 0)
    return 1 << power


def alignment(docs: DataFrame, path_a: str, path_b: str, most: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of ``docs`` (doc_id, text; others unread).

    ``path_a`` is a byte-level BPE of tokenizers, which gets a blank before the text; ``path_b`` a
    sentencepiece model, which adds it. Texts that are null or empty, or whose tokens do not spell the
    blank and the text, have no tokens: zeros and an empty digest. Repeated rows are documents of their
    own and count as such; rows without a doc_id stay; texts of any length are aligned whole. An empty
    table gives an empty result.
    """
    found = aligned(docs, path_a, path_b)
    counts = stable(pair_counts(found, side(path_b).spelling.n))
    least = frequent(counts, most)
    links = found.select("row", F.explode("pairs").alias("pair"))
    known = F.broadcast(counts.where(F.col("n") >= least))
    sums = [links.join(known, "pair")]
    if least > 1:
        sums.append(links.join(known.select("pair"), "pair", "left_anti").join(counts.where(F.col("n") < least), "pair"))
    totals = [s.groupBy("row").agg(F.sum("n").alias("count_sum"), F.count_if("best").alias("n_best")) for s in sums]
    total = totals[0] if len(totals) == 1 else totals[0].unionByName(totals[1]).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return found.drop("pairs").join(total, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
