"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

A paragraph is a line that is not blank. Each paragraph gives a wide vector, and a document's
fingerprint is the sum of its paragraphs' vectors modulo powers of two: ``WIDE`` lanes modulo 2^62,
each fed by an xxhash64 of the paragraph under its own seed (the hash of the lane's number, which goes
in first: after the paragraph it would mix all lanes from one hash), and ``LANES`` counters modulo 2^32, fed
by the bits of the hashes of the paragraph's units (its sentences, cut every ``UNIT`` words). Order
of paragraphs does not matter; :func:`added` and :func:`removed` insert and delete paragraphs without
the rest of the text.

The wide lanes decide equality. Counter i read as ``units - 2 * counter`` is a sum of +1 and -1 over
the units, so the cosine of two documents' counters estimates the cosine of their multisets of units
with a standard error of 1 / sqrt(LANES): a likeness from the fingerprints alone.

A fingerprint is ARRAY<BIGINT>: the wide lanes, the number of units, then two counters to a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stable

#: Bytes of text in a range of doc_id, as far as documents are of even size.
RANGE_BYTES = 64 << 20
WIDE, PACKED, UNIT, SEEDS = 4, 32, 8, (42, 43)
LANES = 2 * PACKED * len(SEEDS)
WIDE_MASK = (1 << 62) - 1
PAIR = (1 << 32) | 1
UNITS = r"(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D.!?][\x20\x09]+){0,%d}[^\x20\x09-\x0D]+" % (UNIT - 1)


def _wide_added(total: Column, line: Column) -> Column:
    def lane(k: int) -> Column:
        return (F.get(total, F.lit(k)) + F.xxhash64(F.lit(k), line).bitwiseAND(F.lit(WIDE_MASK))).bitwiseAND(F.lit(WIDE_MASK))

    return F.array(*[lane(k) for k in range(WIDE)])


def _wide(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda p: p.rlike(r"[^\x20\x09-\x0D]"))
    return F.aggregate(lines, F.array(*[F.lit(0).cast("long")] * WIDE), _wide_added)


def with_fingerprint(df: DataFrame, text: str, name: str, keys: list[str]) -> DataFrame:
    """(keys, name): the fingerprint of ``text`` for each row of ``df``, which ``keys`` tell apart; null
    and blank texts have all lanes 0.

    The units become rows whose hashes' bits are summed by ``keys``: a partial and a final aggregate,
    without a shuffle of their own where ``df`` is dealt by some of the keys already.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # in a step of its own, or the lanes would be computed for every unit
    own = df.select(*keys, _wide(body).alias("_wide"), F.regexp_extract_all(body, F.lit(UNITS), F.lit(0)).alias("_units"))
    own = own.select(*keys, "_wide", F.explode_outer("_units").alias("_unit"))
    seen = F.col("_unit").isNotNull()
    own = own.select(*keys, "_wide", seen.cast("long").alias("_n"), *[F.when(seen, F.xxhash64(F.lit(s), "_unit")).otherwise(0).alias(f"_h{s}") for s in SEEDS])
    lanes = [F.sum(F.shiftrightunsigned(f"_h{s}", k).bitwiseAND(F.lit(PAIR))).alias(f"_l{s}_{k}") for s in SEEDS for k in range(PACKED)]
    summed = own.groupBy(*keys, "_wide").agg(F.sum("_n").alias("_n"), *lanes)
    return summed.select(*keys, F.concat("_wide", F.array("_n", *[f"_l{s}_{k}" for s in SEEDS for k in range(PACKED)])).alias(name))


def combined(a: Column, b: Column, sign: int) -> Column:
    def lane(x: Column, i: Column) -> Column:
        y = F.get(b, i) * sign
        return F.when(i < WIDE, (x + y).bitwiseAND(F.lit(WIDE_MASK))).otherwise(x + y)

    return F.transform(a, lane)


def added(a: Column, b: Column) -> Column:
    """The fingerprint of a document with the paragraphs of both."""
    return combined(a, b, 1)


def removed(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` without the paragraphs of ``b``, which it must hold."""
    return combined(a, b, -1)


def as_hex(a: Column) -> Column:
    return F.lower(F.concat_ws("", F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0"))))


def signed(a: Column) -> Column:
    """The counters as sums of +1 and -1."""
    n = F.get(a, F.lit(WIDE))
    packed = F.slice(a, WIDE + 2, PACKED * len(SEEDS))
    low = F.transform(packed, lambda x: (n - F.lit(2) * x.bitwiseAND(F.lit((1 << 32) - 1))).cast("double"))
    return F.concat(low, F.transform(packed, lambda x: (n - F.lit(2) * F.shiftrightunsigned(x, 32)).cast("double")))


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def likeness(a: Column, b: Column, a_signed: Column, b_signed: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, 0 where one of two is blank, else the cosine of the counters."""
    size = F.sqrt(inner(a_signed, a_signed) * inner(b_signed, b_signed))
    return F.when(a == b, 1.0).when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), inner(a_signed, b_signed) / size))).otherwise(0.0)


def ranged(rows: DataFrame, ranges: int, fan: int = 1024) -> DataFrame:
    """``rows`` with ``bucket``: about ``ranges`` ranges of ``k`` of about as many rows each.

    Ranges are found in two levels of at most ``fan`` and as many as are needed: quantiles of all rows,
    then quantiles within each of those. (They are taken of doubles, which beyond 2^53 makes ranges less
    even, not wrong.)
    """
    coarse = max(1, min(ranges, fan))
    fine = -(-ranges // coarse)

    def cuts(n: int) -> Column:
        at = [i / n for i in range(1, n)]
        return F.array_distinct(F.percentile_approx("k", F.array(*map(F.lit, at)), F.lit(10 * n))) if at else F.array().cast("array<bigint>")

    def place(bounds: Column) -> Column:
        return F.size(F.filter(F.coalesce(bounds, F.array().cast("array<bigint>")), lambda x: x <= F.col("k")))

    keys = rows.where("doc_id is not null").select("k")
    bounds = keys.agg(cuts(coarse).alias("b")).first()["b"] or []
    first = place(F.array(*map(F.lit, bounds)).cast("array<bigint>"))
    # at most ``fan`` rows of at most ``ranges / fan`` bounds
    inner = keys.withColumn("b0", first).groupBy("b0").agg(cuts(fine).alias("b1"))
    rows = rows.withColumn("b0", first).join(F.broadcast(inner), "b0", "left")
    return rows.withColumn("bucket", F.col("b0").cast("long") * fine + place(F.col("b1"))).drop("b0", "b1")


def with_next(docs: DataFrame, ranges: int, fan: int = 1024) -> tuple[DataFrame, object]:
    """(bucket, echo, k, doc_id, text) and the window in which the next row is the next document.

    Rows go by doc_id (null first, ties by text) into ranges. Each range also holds an echo of the first
    document of the next one (the last range: of the first), so the window never leaves its range and
    the texts are shuffled once.
    """
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = ranged(docs.select(k.alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text")), ranges, fan)
    window = Window.partitionBy("bucket").orderBy("echo", "k", "text")
    # one row per range
    firsts = rows.groupBy("bucket").agg(F.min("k").alias("k"))
    echo = firsts.select("k", F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy(F.lit(0)))).alias("to"))
    echoes = rows.drop("bucket").join(small(stable(echo)), "k").withColumnRenamed("to", "bucket").withColumn("echo", F.lit(True))
    return rows.withColumn("echo", F.lit(False)).unionByName(echoes), window


def fingerprints(docs: DataFrame, ranges: int | None = None, fan: int = 1024) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the
    next document's text (by doc_id; after the last one: the first). A null text counts as empty; a
    null doc_id comes first; rows of one doc_id go by text. A single document is its own next one.
    Needs doc_id and text; other columns are not read. An empty table gives an empty result.

    ``ranges``: how many ranges of doc_id tasks work on; by default one for ``RANGE_BYTES`` of text, and
    eight for each shuffle partition at least, so that partitions get about as many.
    """
    if ranges is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    rows, window = with_next(docs, ranges, fan)
    edited = F.concat(F.expr("substring(text, 1, length(text) - floor(length(text) / 2))"), F.expr("substring(next_text, 1, floor(length(text) / 2))"))
    rows = rows.withColumns({"next_text": F.lead("text").over(window), "place": F.row_number().over(window)}).withColumn("edited", edited)
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("body")))
    sha = F.when(~F.col("echo"), F.sha2(F.col("edited").cast("binary"), 256))
    rows = rows.select("bucket", "place", "echo", "doc_id", F.length("text").cast("long").alias("n_chars"), sha.alias("edited_sha256"), F.inline(sides))
    both = with_fingerprint(rows, "body", "f", ["bucket", "place", "side", "echo", "doc_id", "n_chars", "edited_sha256"])
    own = Window.partitionBy("bucket").orderBy("place", "side")
    both = both.withColumns({"e": F.lead("f", 1).over(own), "x": F.lead("f", 2).over(own)}).where("side = 0 and not echo")
    both = both.withColumns({"fs": signed(F.col("f")), "es": signed(F.col("e")), "xs": signed(F.col("x"))})
    near = lambda o: likeness(F.col("f"), F.col(o), F.col("fs"), F.col(f"{o}s"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("f")).alias("fingerprint"), as_hex(F.col("e")).alias("edited_fingerprint"), near("e").alias("near_edited"), near("x").alias("near_next")
    )
