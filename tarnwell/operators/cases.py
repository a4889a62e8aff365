"""Joining evidence into cases: tokens, links, safe payee bridges, and the cases that links make.

An item's join tokens are its entities of the kinds that identify someone, and what lies near them in the
graph, without excluded ones (hubs) and without reputable payees. It continues the case of the item that last showed one of its tokens, if
that was at most ``WINDOW`` ago, or at most ``STICKY`` ago where both are of one customer and the earlier
one is of stage S2 or later. An item that links several cases makes them one, so a case is a connected
component of such links.

A link over an account that is not the customer's own (a payee) is a bridge. Two items linked by bridges
alone stay apart unless they share two such accounts, or the account is suspicious and both items are.

Items of no more than the base rate neither open a case nor count before one is open: of each component
those before its first item above the base rate are left out.

Evidence: evidence_id, us, customer, stage, p, entities (array of tokens), own (array: the customer's accounts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import HOUR, kind
from ..sources.stable import stable
from .components import components
from .fusion import STAGES
from .graph import walk

#: Kinds that join, hours that a case stays open, and from which stage on it stays open longer.
KINDS, WINDOW, STICKY, STICKY_FROM, BRIDGES = ("cust", "acct", "dev", "ip", "phone"), 6 * HOUR, 72 * HOUR, "S2_CONTROL_TAKEOVER", 2
#: Edges that payments make. How many tokens join an item at most, the nearest ones (None: all of them).
PAYMENT: tuple[str, ...] = ("SENT", "ADDED_PAYEE")
MOST_TOKENS: int | None = None
#: Rows of a task that a join makes many times as many of.
ROWS = 50_000


def neighbours(edges: DataFrame, tokens: DataFrame, skip: DataFrame, hops: int = 2, least: float = 0.5) -> DataFrame:
    """(start, token, hops, direct) of each of ``tokens`` (token): what lies within ``hops`` over sure edges, and
    whether it does so without a payment edge. ``skip`` (token) is neither reached nor crossed."""
    starts = tokens.select(F.col("token").alias("start")).distinct()
    near = walk(edges, starts, hops, least, skip)
    direct = walk(edges.where(~F.col("edge_type").isin(*PAYMENT)), starts, hops, least, skip).select("start", "token", F.lit(True).alias("direct"))
    return near.join(direct, ["start", "token"], "left").withColumn("direct", F.coalesce("direct", F.lit(False)))


def join_tokens(evidence: DataFrame, excluded: DataFrame, reputable: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(evidence_id, us, customer, stage, p, token, bridge, shown) for each token that an item may be joined by.

    excluded: token; reputable: token. Both are joined by token, so neither has to be small. ``near`` (see
    :func:`neighbours`) adds what lies near an item's own tokens, all of it; where ``MOST_TOKENS`` is set, the nearest
    that many of an item stay (ties by token). ``shown`` says whether the item itself shows the token.
    """
    rows = evidence.select("evidence_id", "us", "customer", "stage", "p", "own", F.explode(F.array_distinct("entities")).alias("token"))
    rows = rows.where(kind(F.col("token")).isin(*KINDS)).join(excluded.select("token"), "token", "left_anti")
    bridge = (kind(F.col("token")) == "acct") & ~F.array_contains("own", F.col("token"))
    rows = rows.withColumn("bridge", bridge)
    known = reputable.select("token").distinct().withColumn("known", F.lit(True))

    def allowed(found: DataFrame) -> DataFrame:
        theirs = (kind(F.col("token")) == "acct") & ~F.array_contains("own", F.col("token"))
        return found.join(known, "token", "left").where(~theirs | F.col("known").isNull()).drop("known")

    rows = allowed(rows)

    def nearest(found: DataFrame, key: str) -> DataFrame:
        if MOST_TOKENS is None:
            return found.drop("hops")
        rank = F.row_number().over(Window.partitionBy(key).orderBy("hops", "token"))
        return found.withColumn("rank", rank).where(F.col("rank") <= MOST_TOKENS).drop("rank", "hops")

    if near is None:
        return nearest(rows.drop("own").withColumns({"hops": F.lit(0), "shown": F.lit(True)}), "evidence_id")
    # what lies near hangs on an item's tokens alone, so it is looked up once for all items that show the same, and each task has few of them
    items = rows.groupBy("evidence_id", "us", "customer", "stage", "p").agg(F.array_sort(F.collect_set(F.struct("token", "bridge"))).alias("shows"), F.array_sort(F.first("own")).alias("own"))
    items = stable(items.withColumn("like", F.min("evidence_id").over(Window.partitionBy("shows", "own"))))
    ones = items.where("evidence_id = like").select("like", "own", F.inline("shows"))
    further = _dealt(ones.withColumnRenamed("token", "start"), "start").join(near, "start").select("like", "own", "token", "hops", (F.col("bridge") | ~F.col("direct")).alias("bridge"))
    both = ones.withColumns({"hops": F.lit(0), "shown": F.lit(True)}).unionByName(allowed(further.withColumn("shown", F.lit(False))))
    found = both.groupBy("like", "token").agg(F.min("bridge").alias("bridge"), F.min("hops").alias("hops"), F.max("shown").alias("shown"))
    return _dealt(items.drop("shows", "own"), "like").join(stable(nearest(found, "like")), "like").drop("like")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` in as many tasks as their number asks for: each makes many rows when joined, which Spark does not see from their size."""
    rows = stable(rows)
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS)), key).hint("merge")


def links(tokens: DataFrame, suspicious: DataFrame, base_rate: float = 0.01) -> DataFrame:
    """(a, b): items whose cases are one, from the last item that showed each of an item's tokens.

    A token held by many makes one link per sighting, never a pair of all its holders.
    """
    order = Window.partitionBy("token").orderBy("us", "evidence_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("shown"), F.struct("evidence_id", "us", "customer", "stage", "p", "bridge")), True).over(order)
    seen = tokens.withColumn("last", before).where("last is not null")
    place = lambda c: F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col(c))
    gap = F.col("us") - F.col("last.us")
    sticky = (F.col("customer") == F.col("last.customer")) & (place("last.stage") >= STAGES.index(STICKY_FROM) + 1) & (gap <= STICKY)
    seen = seen.where((gap <= WINDOW) | sticky)
    odd = suspicious.select("token").distinct().withColumn("odd", F.lit(True))
    seen = seen.join(odd, "token", "left").withColumn("crossing", F.col("bridge") | F.col("last.bridge"))
    both = (F.col("p") > base_rate) & (F.col("last.p") > base_rate)
    pairs = seen.groupBy(F.col("last.evidence_id").alias("a"), F.col("evidence_id").alias("b")).agg(
        F.count_if(~F.col("crossing")).alias("direct"), F.count_if(F.col("crossing")).alias("bridges"), F.coalesce(F.bool_or(F.col("odd") & both), F.lit(False)).alias("odd")
    )
    return pairs.where((F.col("direct") > 0) | (F.col("bridges") >= BRIDGES) | F.col("odd")).select("a", "b")


def joined(evidence: DataFrame, found: DataFrame, base_rate: float = 0.01) -> DataFrame:
    """``evidence`` with case_id (its component's first item above the base rate) and anchor (that item's customer)."""
    label = components(found).withColumnsRenamed({"node": "evidence_id", "root": "label"})
    rows = evidence.join(label, "evidence_id", "left").withColumn("label", F.coalesce("label", "evidence_id"))
    first = F.min(F.when(F.col("p") > base_rate, F.struct("us", "evidence_id")))
    opened = rows.groupBy("label").agg(first.alias("open"), F.min_by("customer", F.when((F.col("p") > base_rate) & F.col("customer").isNotNull(), F.struct("us", "evidence_id"))).alias("anchor"))
    rows = rows.join(opened.where("open is not null"), "label").where(F.struct("us", "evidence_id") >= F.col("open"))
    return rows.withColumn("case_id", F.concat(F.lit("case:"), F.col("open.evidence_id"))).drop("label", "open")


def case_table(rows: DataFrame) -> DataFrame:
    """One row per case: anchor, opened, last, items, customers and stages seen."""
    return rows.groupBy("case_id").agg(
        F.first("anchor").alias("anchor"), F.min("us").alias("opened_us"), F.max("us").alias("last_us"), F.count("*").alias("items"), F.countDistinct("customer").alias("customers"), F.array_sort(F.collect_set("stage")).alias("stages")
    )
