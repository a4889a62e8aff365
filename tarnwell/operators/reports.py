"""Reports, comparisons and sequences over events, evidence, cases and payments: a few joins or aggregates each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import HOUR
from ..sources.bridge import back


def tokens(*columns: str) -> Column:
    """An event's entity tokens, sorted, each once, nulls left out."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*columns))))


def changed(old: DataFrame, new: DataFrame, key: str, *fields: str) -> DataFrame:
    """Rows of ``new`` that ``old`` lacks (status new) or has with other values (status changed)."""
    before = old.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    rows = new.join(before, F.col(key) == F.col("_key"), "left")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    status = F.when(F.col("_key").isNull(), "new").when(~same, "changed")
    return rows.withColumn("status", status).where("status is not null").select(key, *fields, "status")


def state_before(payments: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """Each payment (key, us, event_id) with the last state (key, us, event_id, state) before it.

    Both sides go through one window per key, so a key's rows are sorted once and no pairs are made.
    """
    rows = payments.select(key, "us", "event_id", F.lit(None).cast("string").alias("state"), F.lit(True).alias("pay"))
    rows = rows.unionByName(states.select(key, "us", "event_id", "state", F.lit(False).alias("pay")))
    before = Window.partitionBy(key).orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("state", F.last("state", True).over(before)).where("pay").select("event_id", "state")


def detection(rows: DataFrame, key: str, found: str, real: str) -> DataFrame:
    """Precision, recall and F1 by ``key``; 0 where there is nothing to divide by."""
    count = lambda c: F.count_if(F.expr(c))
    counts = rows.groupBy(key).agg(count(f"{found} and {real}").alias("tp"), count(f"{found} and not {real}").alias("fp"), count(f"not {found} and {real}").alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counts.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def nearest_rank(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The 50th, 95th and 99th percentile by nearest rank."""
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})").alias(f"p{int(100 * p)}")
    return rows.groupBy(key).agg(F.count("*").alias("n"), at(0.5), at(0.95), at(0.99))


def repeated(rows: DataFrame, key: str, span: int = HOUR, least: int = 3) -> DataFrame:
    """Events of a key within ``span`` with this one, and whether there are ``least``; ``rows`` has o."""
    over = Window.partitionBy(key).orderBy("o").rangeBetween(back(span), 0)
    return rows.select("event_id", F.count("*").over(over).alias("n")).withColumn("flagged", F.col("n") >= least)


def scaled_to_median(rows: DataFrame, key: str, value: str, to: float = 150_000.0) -> DataFrame:
    """Values scaled so that each key's median is ``to``; the medians are aggregated before they are joined."""
    middle = rows.groupBy(key).agg(F.percentile(value, F.lit(0.5)).alias("middle"))
    return rows.join(middle, key).select("event_id", F.when(F.col("middle") > 0, F.col(value) * to / F.col("middle")).otherwise(F.lit(0.0)).alias("scaled"))


def device_rings(edges: DataFrame, profile: DataFrame, hubs: DataFrame, accounts: int = 2, payers: int = 4) -> DataFrame:
    """Devices, hubs left out, whose several accounts together gained new payers."""
    used = edges.where("edge_type = 'LOGGED_IN_FROM'").select(F.col("src").alias("account"), F.col("dst").alias("device")).distinct()
    used = used.join(hubs.select(F.col("token").alias("device")), "device", "left_anti").join(profile.select("account", "new_payers_window"), "account", "left")
    rings = used.groupBy("device").agg(F.count("*").alias("accounts"), F.coalesce(F.sum("new_payers_window"), F.lit(0)).alias("new_payers"))
    return rings.where((F.col("accounts") >= accounts) & (F.col("new_payers") >= payers))


def rupees(paise: Column) -> Column:
    """Whole rupees with Indian digit groups: the last three digits, then pairs."""
    return F.regexp_replace(F.floor(paise / 100).cast("string"), r"(\d)(?=(\d\d)+\d$)", "$1,")


def credited(contributed: DataFrame, least: float = 0.5) -> DataFrame:
    """How often each detector contributed enough to be credited for a verdict on its case."""
    return contributed.groupBy("detector").agg(F.count_if(F.col("contribution") > least).alias("credited"), F.count("*").alias("items"))


def time_split(us: Column, first: Column) -> Column:
    """train (days 1 to 9), valid (10 and 11) or test of an event by its day since the first one."""
    day = F.floor((us - first) / (24 * HOUR)) + 1
    return F.when(day <= 9, "train").when(day <= 11, "valid").otherwise("test")


#: The rail's state that follows from a payment's outcome.
RAIL = {"completed": "CAPTURED", "held": "AUTHORIZED", "blocked": "VOIDED"}


def rail_state(outcome: Column) -> Column:
    return F.coalesce(*[F.when(outcome == k, F.lit(v)) for k, v in RAIL.items()], F.lit("CREATED"))


def model_quality(scores: DataFrame, part: str, bins: int = 10) -> DataFrame:
    """n, positives, pr_auc (average precision), roc_auc and ece of scores (part, p, y: 0 or 1), for each part.

    Scores are counted by value first, so the ordered windows run over distinct values, not over rows; equal
    scores stand or fall together. Parts without both kinds of label have no areas.
    """
    at = F.least(F.lit(bins - 1), F.floor(F.col("p") * bins))
    ece = scores.groupBy(part, at.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"))
    ece = ece.groupBy(part).agg((F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"))
    values = scores.groupBy(part, "p").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    falling, whole = Window.partitionBy(part).orderBy(F.desc("p")), Window.partitionBy(part)
    values = values.withColumns({
        "tp": F.sum("pos").over(falling), "seen": F.sum("n").over(falling), "all_pos": F.sum("pos").over(whole), "all_neg": F.sum(F.col("n") - F.col("pos")).over(whole),
    })
    below = F.col("all_neg") - (F.col("seen") - F.col("tp")) + (F.col("n") - F.col("pos")) / 2
    found = values.groupBy(part).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("positives"), F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), F.first("all_pos")).alias("pr_auc"),
        F.try_divide(F.sum(F.col("pos") * below), F.first("all_pos") * F.first("all_neg")).alias("roc_auc"),
    )
    return found.join(ece, part)
