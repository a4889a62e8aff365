"""Fusing evidence into an attack probability, after every item of a case, with windows only.

A family contributes its strongest item in full and each other one at half, so after any prefix it is
worth ``(sum + max) / 2`` of its items' weights: a running sum and a running maximum. That turns the
replay of all prefixes of a case into one sort of its evidence instead of a join of it with itself.

Evidence: evidence_id, case_id, us, customer, detector, family, stage, p, reliability, reasons
(array), amount and, where some are of a fallback model, degraded. Items are in order of (us, evidence_id).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import HOUR, MINUTE, band, clipped, logit, sigmoid
from .patterns import PATTERNS, STAGES, Pattern, with_hits  # noqa: F401  STAGES is read from here

#: Fixed values of the domain: families and reliability of detectors.
FAMILY = {"txn": "transaction", "behaviour": "identity", "auth": "device", "kyc": "kyc", "cyber": "cyber", "netsec": "cyber", "graph": "graph"}
RELIABILITY = {"txn": (17, 3), "behaviour": (6, 4), "auth": (7, 3), "kyc": (6, 4), "cyber": (5, 5), "netsec": (5, 5), "graph": (8, 2)}
BANDS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


@dataclass(frozen=True)
class Config:
    base_rate: float = 0.01
    low: float = -2.0
    high: float = 3.0
    medium_band: float = 0.20
    high_band: float = 0.50
    critical_band: float = 0.80
    confident: float = 0.90


def weight(p: Column, reliability: Column, config: Config = Config()) -> Column:
    return reliability * clipped(logit(p) - logit(F.lit(config.base_rate)), config.low, config.high)


def band_rank(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in BANDS]), name)


def _running(*keys: str):
    return Window.partitionBy(*keys).orderBy("us", "evidence_id").rowsBetween(Window.unboundedPreceding, 0)


def _earlier(*keys: str):
    return Window.partitionBy(*keys).orderBy("us", "evidence_id").rowsBetween(Window.unboundedPreceding, -1)


def _reason(code: str) -> Column:
    return F.array_contains("reasons", code)


def timeline(evidence: DataFrame, config: Config = Config(), patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """One row per item: the case after it (log_odds, p_attack, band, patterns, floors, amount_at_risk).

    All windows are of a case or a part of it, so the items are dealt to tasks by case, once."""
    case, family = _running("case_id"), ["case_id", "family"]
    in_order = Window.partitionBy(*family).orderBy("us", "evidence_id")
    rows = evidence.repartition("case_id").withColumn("weight", weight(F.col("p"), F.col("reliability"), config))
    worth = (F.sum("weight").over(_running(*family)) + F.max("weight").over(_running(*family))) / 2
    rows = rows.withColumn("worth", worth)
    rows = rows.withColumn("gain", F.col("worth") - F.coalesce(F.lag("worth").over(in_order), F.lit(0.0)))
    live = F.col("weight") > 0
    sure = (F.col("detector") == "txn") & (F.col("p") >= config.confident)
    if "degraded" in evidence.columns:
        sure = sure & ~F.coalesce("degraded", F.lit(False))
    at = lambda stage: F.when(live & (F.col("stage") == stage), F.col("us"))
    last = lambda c: F.max(c).over(_earlier("case_id"))
    rows = rows.withColumns({
        "live": live,
        "s2": last(at("S2_CONTROL_TAKEOVER")),
        "fresh_stage": live & (F.row_number().over(Window.partitionBy("case_id", "stage", live).orderBy("us", "evidence_id")) == 1),
        "sure_at": F.max(F.when(sure, F.col("us"))).over(case),
        "disarmed": F.max(F.when(_reason("STEP_UP_PASSED_TRUSTED"), F.col("us"))).over(case),
    })
    now = F.col("us")
    is_s5 = live & (F.col("stage") == "S5_POSITIONING")
    hit = lambda c: F.max(c.cast("int")).over(case) == 1
    stage_times = F.array_sort(F.collect_list(F.when(F.col("fresh_stage"), now)).over(case))
    rows = rows.withColumns({
        "positioned": F.max(F.when(is_s5 & (now - F.col("s2") <= 24 * HOUR), F.col("s2"))).over(case),
        "times": stage_times,
    })
    gaps = F.transform(F.sequence(F.lit(0), F.greatest(F.size("times") - 3, F.lit(0))), lambda i: F.get("times", i + 2) - F.get("times", i))
    rows = rows.withColumns({
        "denied": hit(_reason("CUSTOMER_DENIED")),
        "seed_payee": hit((F.col("detector") == "graph") & _reason("SEED_DISTANCE_0")),
        "three_stages": F.coalesce(F.exists(gaps, lambda g: g <= 30 * MINUTE), F.lit(False)),
        "txn_sure": F.coalesce(F.col("sure_at") > F.coalesce("disarmed", F.lit(-1)), F.lit(False)),
        "s2_then_payee": F.coalesce(F.col("positioned") > F.coalesce("disarmed", F.lit(-1)), F.lit(False)),
    })
    rows = with_hits(rows, patterns)
    rows = rows.withColumn("log_odds", logit(F.lit(config.base_rate)) + F.sum("gain").over(case) + F.col("bonus"))
    rows = rows.withColumn("p_attack", sigmoid(F.col("log_odds")))
    raw = band(F.col("p_attack"), config.medium_band, config.high_band, config.critical_band)
    floor = F.greatest(band_rank(raw), F.when(F.col("denied"), 4).otherwise(1), F.when(F.col("seed_payee") | F.col("s2_then_payee") | F.col("txn_sure"), 3).otherwise(1), F.when(F.col("three_stages"), 2).otherwise(1))
    named = lambda pairs: F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in pairs]))
    return rows.select(
        "case_id", "evidence_id", "us", "customer", "detector", "stage", "reasons", "weight", "gain", "log_odds", "p_attack", "amount",
        raw.alias("band_before_floors"),
        F.element_at(F.array(*[F.lit(b) for b in BANDS]), floor.cast("int")).alias("band"),
        F.col("hits.pattern").alias("patterns"),
        named([("denied", "floor_CUSTOMER_DENIED"), ("seed_payee", "floor_SEED_PAYEE"), ("three_stages", "floor_THREE_STAGES"), ("s2_then_payee", "floor_S2_THEN_NEW_PAYEE"), ("txn_sure", "floor_TXN_HIGH_CONFIDENCE")]).alias("floors"),
        F.coalesce(F.sum(F.when(F.col("stage") == "S6_MONETIZATION", F.col("amount"))).over(case), F.lit(0)).alias("amount_at_risk"),
    )


def fused(points: DataFrame) -> DataFrame:
    """The last point of each case."""
    columns = [c for c in points.columns if c != "case_id"]
    return points.groupBy("case_id").agg(F.max_by(F.struct(*columns), F.struct("us", "evidence_id")).alias("x")).select("case_id", "x.*")


def contributions(evidence: DataFrame, config: Config = Config()) -> DataFrame:
    """What each item adds to its whole case: full weight for the first of its family, else half."""
    rows = evidence.withColumn("weight", weight(F.col("p"), F.col("reliability"), config))
    rank = F.row_number().over(Window.partitionBy("case_id", "family").orderBy(F.desc("weight"), "us", "evidence_id"))
    return rows.withColumn("contribution", F.when(rank == 1, F.col("weight")).otherwise(F.col("weight") / 2))


def stage_hits(contributed: DataFrame) -> DataFrame:
    """(case_id, stage, us, evidence_id): the earliest positive item of each stage."""
    first = F.min(F.struct("us", "evidence_id")).alias("m")
    return contributed.where("contribution > 0").groupBy("case_id", "stage").agg(first).select("case_id", "stage", "m.us", "m.evidence_id")


def waterfall(contributed: DataFrame, config: Config = Config()) -> DataFrame:
    """Steps of the explanation: items in order with the running log-odds."""
    running = F.sum("contribution").over(_running("case_id"))
    return contributed.select("case_id", "evidence_id", "detector", "contribution", (logit(F.lit(config.base_rate)) + running).alias("log_odds_after"))


def siloed(evidence: DataFrame, least: float = 0.5) -> DataFrame:
    """Each detector alone: an alert from ``least``, a block only for payments."""
    alert = F.col("p") >= least
    return evidence.select("case_id", "evidence_id", "us", F.when(alert, "SILOED_ALERT").otherwise("SILOED_NONE").alias("band"), F.when(alert & (F.col("detector") == "txn"), "BLOCK_PENDING_PAYMENTS").otherwise("ALLOW").alias("action"))
