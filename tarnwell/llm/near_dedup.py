"""Near-duplicate detection: SuperMinHash, banding, verification on full sets, union-find grouping.

1. Every text's shingle set gives a fingerprint and a SuperMinHash signature. Texts of equal sets are
   one class from here on, represented by one of its rows, so copies cost one row each.
2. Signatures are cut into bands; classes that share a band are a bucket. With the production bands a
   pair of similarity 0.8 shares none with a probability of (1 - 0.8^4)^32, about 5e-8.
3. Each member of a bucket is verified, on full sets, against the bucket's center: the member whose
   buckets are the largest, which in a group of edited copies is the text that most resemble. Verified
   links give components.
4. Buckets that still hold several components are worked off exactly, in tiles of bounded size; tiles
   that hold the center's component alone never meet. A first pass over signatures finds the members
   with a partner: of another component, of a size that fits, sharing this band first and agreeing in
   at least ``CLOSE`` of the signature. (A pair of similarity 0.8 agrees in fewer with a probability of
   about 1e-8.) A second pass gets their texts, counts all their common shingles at once as a product
   of 0/1 matrices, and returns a forest of the links. So no link between components is lost, and no
   row per pair is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, in_rows, matched, slices, small, stable, text_hash, without_repeats
from .components import components, forest
from .shingles import Sets, exact_sets, set_fingerprints, shingle_sets, super_minhash

BANDS, ROWS, CLOSE = 32, 4, 0.6
#: A tile has about so many members at most, and so many shingles; a product takes so many shingles at once.
TILE, TILE_SHINGLES, WIDE = 1024, 1 << 20, 2048
SIGNED = "doc_id long, h long, n_shingles long, fingerprint binary, signature binary"


def signed(docs: DataFrame, k: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(part.column("text"), k)
            marks, signatures = set_fingerprints(sets).tobytes(), super_minhash(sets, BANDS * ROWS).astype("<u4").tobytes()
            n, width = part.num_rows, 4 * BANDS * ROWS
            columns = [part.column("doc_id"), part.column("h"), pa.array(np.diff(sets.at)), pa.array([marks[16 * i : 16 * i + 16] for i in range(n)]), pa.array([signatures[width * i : width * (i + 1)] for i in range(n)])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "n_shingles", "fingerprint", "signature"])

    return docs.select(F.col("doc_id").cast("long"), text_hash().alias("h"), "text").mapInArrow(sign, SIGNED)


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b: classes) whose full sets reach the similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text_a", "text_b"):
            n = part.num_rows
            sets = exact_sets(pa.concat_arrays([part.column("text_a"), part.column("text_b")]), k)
            keep = np.zeros(n, bool)
            for i in range(n):
                x, y = sets[i], sets[n + i]
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
            yield part.select(["a", "b"]).filter(pa.array(keep))

    pairs = stable(pairs)
    texts = texts_of(docs, classes, pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))))
    sides = [texts.select(F.col("c").alias(s), F.col("text").alias(f"text_{s}")) for s in ("a", "b")]
    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(compare, "a long, b long")


def texts_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, text): the text that stands for each class which ``wanted`` (c) lists, once."""
    wanted = small(stable(classes.select("c", "doc_id", "h").join(wanted.distinct(), "c", "left_semi")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), "text")
    return matched(rows, wanted, ["h", "doc_id"]).select("c", "text").dropDuplicates(["c"])


def fits(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def tiled(rows: DataFrame) -> DataFrame:
    """``rows`` (key, main, c, label, n_shingles, ...) once for each tile that theirs is to meet: low, high, tile.

    The members of a bucket's ``main`` component have tiles of their own, which do not meet each other.
    """
    own = F.coalesce(F.col("label") == F.col("main"), F.lit(False))

    def tiles(which: Column) -> Column:
        return F.ceil(F.greatest(F.count_if(which) / TILE, F.coalesce(F.sum(F.when(which, F.col("n_shingles"))), F.lit(0)) / TILE_SHINGLES)).cast("int")

    rows = stable(rows)
    rows = rows.join(small(stable(rows.groupBy("key").agg(tiles(own).alias("mains"), tiles(~own).alias("others")))), "key")
    place = lambda n: F.pmod(F.xxhash64("c"), F.greatest(n, F.lit(1))).cast("int")
    rows = rows.withColumn("tile", F.when(own, place(F.col("mains"))).otherwise(F.col("mains") + place(F.col("others"))))
    meets = F.when(own & (F.col("others") > 0), F.sequence("mains", F.col("mains") + F.col("others") - 1)).when(~own, F.sequence(F.lit(0), F.col("mains") + F.col("others") - 1))
    rows = rows.withColumn("other", F.explode(meets))
    return rows.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("mains", "others", "other", "main")


def with_partner(rows: DataFrame, percent: int) -> DataFrame:
    """The tiles' members (key, low, high, tile, c, label) that may have a link to another component."""

    def find(table: pa.Table) -> pa.Table:
        own, label, n, tile = (table.column(c).to_numpy() for c in ("c", "label", "n_shingles", "tile"))
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u4").reshape(len(own), -1)
        band, low, high = (table.column(c)[0].as_py() for c in ("band", "low", "high"))
        found = np.zeros(len(own), bool)
        for i in range(len(own)):
            other = np.arange(i + 1, len(own))
            other = other[label[other] != label[i]]
            if low != high:
                other = other[tile[other] != tile[i]]
            other = other[100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i])]
            if not len(other):
                continue
            same = signature[other] == signature[i]
            close = same.sum(axis=1) >= CLOSE * same.shape[1]
            first = same[close].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
            found[other[close][first]] = True
            found[i] |= first.any()
        return table.select(["key", "low", "high", "tile", "c", "label"]).filter(pa.array(found))

    rows = rows.select("band", "key", "low", "high", "tile", "c", "label", "n_shingles", "signature")
    return rows.repartition("key", "low", "high").groupBy("key", "low", "high").applyInArrow(find, "key long, low int, high int, tile int, c long, label long")


def common_shingles(sets: Sets) -> np.ndarray:
    """The number of common elements of each two sets."""
    n = len(sets.at) - 1
    _, column, count = np.unique(sets.hashes, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner = np.repeat(np.arange(n), np.diff(sets.at))[shared]
    column = (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, WIDE):
        own = slice(*np.searchsorted(column, [c, c + WIDE]))
        part = np.zeros((n, WIDE), np.float32)
        part[owner[own], column[own] - c] = 1
        common += part @ part.T
    return common.astype(np.int64)


def tile_links(members: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): a forest of the links between components within each tile or two."""

    def link(table: pa.Table) -> pa.Table:
        own, label, tile = (table.column(c).to_numpy() for c in ("c", "label", "tile"))
        sets = exact_sets(table.column("text"), k)
        size, common = np.diff(sets.at), common_shingles(sets)
        linked = (common > 0) & (100 * common >= percent * (size[:, None] + size - common)) & (label[:, None] != label)
        if table.column("low")[0].as_py() != table.column("high")[0].as_py():
            linked &= tile[:, None] != tile
        x, y = np.nonzero(np.triu(linked))
        a, b = forest(own[x], own[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    members = members.join(texts_of(docs, classes, members.select("c")), "c")
    return members.repartition("key", "low", "high").groupBy("key", "low", "high").applyInArrow(link, "a long, b long")


def linked(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, h, n_shingles, fingerprint; classes of equal sets: fingerprint, c, doc_id, h; roots: node, root).

    A class stands for all rows of its set, by the row of the least doc_id (null last, then by text
    hash ``h``). Two rows of one doc_id whose texts differ are two documents.
    """
    rows = stable(signed(docs, k))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    found = rows.where("n_shingles > 0").groupBy("fingerprint").agg(first)
    classes = stable(found.select("fingerprint", F.monotonically_increasing_id().alias("c"), "first.doc_id", "first.h"))
    reps = stable(matched(rows, classes, ["fingerprint", "doc_id", "h"]).select("c", "n_shingles", "signature").dropDuplicates(["c"]))
    key = lambda b: F.xxhash64(b, F.substring(F.col("signature"), b * (4 * ROWS) + 1, F.lit(4 * ROWS)))
    banded = reps.select("c", "n_shingles", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), key)).alias("band", "key"))
    # sizes and centers are tables of their own, so that Spark may split a hot bucket in the joins with them
    sizes = stable(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    shared = stable(banded.join(sizes, "key"))
    weight = shared.groupBy("c").agg(F.sum("size").alias("weight"))
    center = F.max_by(F.struct("c", "n_shingles"), F.struct("weight", -F.col("c")))
    centers = stable(shared.join(weight, "c").groupBy("key").agg(center.alias("x")).select("key", F.col("x.c").alias("center"), F.col("x.n_shingles").alias("center_n")))
    filed = stable(shared.join(centers, "key"))
    star = filed.where("c != center").where(fits(F.col("n_shingles"), F.col("center_n"), percent)).select(F.least("center", "c").alias("a"), F.greatest("center", "c").alias("b")).distinct()
    links = stable(verified(star, classes, docs, k, percent))
    roots = stable(components(links))
    labelled = stable(filed.where("size > 2").join(roots, F.col("c") == F.col("node"), "left").withColumn("label", F.coalesce("root", "c")).drop("node", "root"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max(F.when(F.col("c") == F.col("center"), F.col("label"))).alias("main")).where("x != y").select("key", "main")
    rest = labelled.where("c != center").join(small(stable(mixed)), "key").join(reps.select("c", "signature"), "c")
    partners = stable(with_partner(tiled(rest), percent))
    if not partners.isEmpty():
        roots = components(links.unionByName(stable(tile_links(partners, classes, docs, k, percent))))
    return rows.drop("signature"), classes, roots


def components_of(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(fingerprint, first): the row of the least doc_id (null last) in the component of each class."""
    own = classes.join(roots, F.col("c") == F.col("node"), "left").withColumn("label", F.coalesce("root", "c")).drop("node", "root", "c")
    first = own.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first"))
    return own.join(first, "label").select("fingerprint", "first")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text; others unread).

    Documents are linked if the Jaccard similarity of their sets of ``k``-word shingles reaches
    ``percent``; component_id is the least doc_id that links reach, and kept whether it is the row's own.
    A text without words (null, empty) has an empty set and no link, and is kept. Rows are documents of
    their own: those of one doc_id are linked by their sets alone, as are rows without a doc_id, which
    are kept only where nothing else of their component has a doc_id (of such rows the one of the least
    text hash). An empty table gives an empty result.
    """
    rows, classes, roots = linked(docs, k, percent)
    found = rows.join(components_of(classes, roots), "fingerprint", "left")
    wordless = F.col("n_shingles") == 0
    component = F.when(wordless, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.col("doc_id") == component).otherwise(component.isNull() & (wordless | (F.col("h") == F.col("first.h"))))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(own, F.lit(False)).alias("kept"))


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns: one row of each component.

    That is the row of the least doc_id (null last, then by text hash). Texts without words all stay.
    Rows equal in doc_id and text are one document, of which one row stays; rows without doc_id and
    words are documents of their own. An empty table gives an empty result.
    """
    _, classes, roots = linked(docs, k, percent)
    first = components_of(classes, roots).select("first.doc_id", "first.h").distinct()
    rows = in_rows(docs, doc_id=F.col("doc_id").cast("long"), h=text_hash(), words=F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    stay = matched(rows.where("words"), first, ["doc_id", "h"], "left_semi").unionByName(rows.where("not words and doc_id is not null"))
    return without_repeats(stay, "doc_id", "h").unionByName(rows.where("not words and doc_id is null")).select("row.*")
