"""The star-schema ``events`` table read as bank and identity events, and readers for event files.

Bridge: purchase is a transaction, click a login that succeeds, error one that fails, view a payee
added, signup an MFA change (even k) or challenge (odd k), where k is the number in props.

Four neighbours share three devices. Sixteen neighbours pay and add each other (k of 60 or more) or one of
twenty merchants. Two kinds of events are drawn together into bursts, ``BURST`` long and ``PERIOD`` apart:
a quarter of the failed logins, from one ip, and a tenth of the payments, just under a limit, to the first
of the sixteen; who is first sends them on to the first of the next sixteen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Bursts begin at ORIGIN (2024-01-14 12:00) and every ten days before and after; a period shrinks to half an hour.
ORIGIN, PERIOD, SHRINK = 1_705_233_600_000_000, 10 * 86_400_000_000, 480
BURST = PERIOD // SHRINK


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(table(spark, sf_dir, "events"))


def typed(raw: DataFrame) -> DataFrame:
    """Typed events: event_id, k, value, us (micros), kind, customer, account, device, ip, asn, lat, lon, result,
    method, payee, amount."""
    k, user = F.regexp_extract("props", r'"k": ?(\d+)', 1).cast("long"), F.col("user_id")
    signup = F.when(k % 2 == 0, "mfa_change").otherwise("mfa_challenge")
    kinds = F.when(F.col("event_type") == "purchase", "transaction").when(F.col("event_type").isin("click", "error"), "login").when(F.col("event_type") == "view", "payee_added").otherwise(signup)
    challenge = F.when(k % 3 == 0, "failed").when(k % 3 == 1, "passed").otherwise("ignored")
    result = F.when(F.col("event_type") == "click", "success").when(F.col("event_type") == "error", "failure").when(kinds == "mfa_challenge", challenge)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    late = F.pmod(us - ORIGIN, F.lit(PERIOD))
    stuffed, funnelled = (F.col("event_type") == "error") & (k % 4 == 3), (F.col("event_type") == "purchase") & (k % 10 == 4)
    first = user - user % 16
    payee = F.when(funnelled, F.when(user == first, user + 16).otherwise(first)).when(k >= 60, first + k % 16).otherwise(9000 + k % 20)
    return raw.select(
        "event_id",
        k.alias("k"),
        "value",
        F.when(stuffed | funnelled, us - late + F.floor(late / SHRINK)).otherwise(us).alias("us"),
        kinds.alias("kind"),
        F.concat(F.lit("cust:"), user).alias("customer"),
        F.concat(F.lit("acct:"), user).alias("account"),
        F.concat(F.lit("dev:"), F.floor(user / 4) * 10 + k % 3).alias("device"),
        F.concat(F.lit("ip:"), F.when(stuffed, 3).otherwise(k % 20)).alias("ip"),
        F.concat(F.lit("AS"), k % 6).alias("asn"),
        (10 + (k % 7) * 0.37).alias("lat"),
        (70 + (user % 5) * 0.41 + (k % 7) * 0.11).alias("lon"),
        result.alias("result"),
        F.when(kinds == "mfa_challenge", F.when(k % 5 < 3, "device_push").otherwise("sms")).alias("method"),
        F.when(kinds.isin("transaction", "payee_added"), F.concat(F.lit("acct:"), payee)).alias("payee"),
        F.when(kinds == "transaction", F.when(funnelled, 9_500_000 + F.col("event_id") % 500 * 1000).otherwise(F.round(F.col("value") * 100_000))).cast("long").alias("amount"),
    )


#: Of ``o`` for each microsecond. Ranks fill its first half at most, so that a frame's far edge falls between instants.
STEP = 1 << 21


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``o``: a number in order of (us, event_id), us * STEP plus the rank among equal us.

    Range frames over ``o`` can leave out the current event and still hold earlier ones of its instant.
    With more than STEP / 2 events of one instant the query ends with an error.
    """
    tie = F.row_number().over(Window.partitionBy("us").orderBy("event_id")) - 1
    o = (F.col("us").cast("decimal(20,0)") * STEP + tie).cast("decimal(30,0)")
    return rows.withColumn("o", F.when(tie < STEP // 2, o).otherwise(F.raise_error(F.lit(f"more than {STEP // 2} events share an instant"))))


def back(span: int) -> int:
    """The start of a range frame over ``o`` that holds events from ``span`` microseconds before on."""
    reach = span * STEP + STEP // 2 - 1
    if reach >= 1 << 63:
        raise ValueError(f"a frame of {span} microseconds is too long")
    return -reach


EVENTS_SQL = """
raw0 AS (SELECT *, CAST(regexp_extract(props, '"k": ?(\\d+)', 1) AS BIGINT) AS k, epoch_us(ts) AS us0 FROM events),
raw AS (SELECT *, event_type = 'error' AND k % 4 = 3 AS stuffed, event_type = 'purchase' AND k % 10 = 4 AS funnelled, user_id - user_id % 16 AS head,
  ((us0 - 1705233600000000) % 864000000000 + 864000000000) % 864000000000 AS late FROM raw0),
kinds AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'transaction' WHEN event_type IN ('click', 'error') THEN 'login'
  WHEN event_type = 'view' THEN 'payee_added' WHEN k % 2 = 0 THEN 'mfa_change' ELSE 'mfa_challenge' END AS kind FROM raw),
ev AS (SELECT event_id, k, value, CASE WHEN stuffed OR funnelled THEN us0 - late + late // 480 ELSE us0 END AS us, kind, 'cust:' || user_id AS customer, 'acct:' || user_id AS account,
  'dev:' || ((user_id // 4) * 10 + k % 3) AS device, 'ip:' || (CASE WHEN stuffed THEN 3 ELSE k % 20 END) AS ip, 'AS' || (k % 6) AS asn,
  10 + (k % 7) * 0.37::DOUBLE AS lat, 70 + (user_id % 5) * 0.41::DOUBLE + (k % 7) * 0.11::DOUBLE AS lon,
  CASE WHEN event_type = 'click' THEN 'success' WHEN event_type = 'error' THEN 'failure'
    WHEN kind = 'mfa_challenge' THEN CASE k % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'passed' ELSE 'ignored' END END AS result,
  CASE WHEN kind = 'mfa_challenge' THEN CASE WHEN k % 5 < 3 THEN 'device_push' ELSE 'sms' END END AS method,
  CASE WHEN kind IN ('transaction', 'payee_added') THEN 'acct:' || (CASE WHEN funnelled THEN CASE WHEN user_id = head THEN user_id + 16 ELSE head END WHEN k >= 60 THEN head + k % 16 ELSE 9000 + k % 20 END) END AS payee,
  CASE WHEN kind = 'transaction' THEN CASE WHEN funnelled THEN 9500000 + event_id % 500 * 1000 ELSE CAST(round(value * 100000) AS BIGINT) END END AS amount FROM kinds)"""
