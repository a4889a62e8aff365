"""Readers of event and reference files. Each gives typed rows and, apart, the lines that are not valid.

A bad line never stops the rest: it goes to the quarantine with what is wrong with it. Files are read by
Spark's own readers, so a path may be in any store and of any number of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import asn

EVENT_TYPES = ("login", "transaction", "payee_added", "mfa_change", "mfa_challenge", "profile_change", "sim_signal", "step_up_result", "kyc_result", "network_ids_alert", "cloud_audit")
NETWORK_TYPES = ("residential", "mobile", "hosting", "vpn", "tor", "unknown")
CONTEXT = "ip string, device_id string, user_agent string, city string, lat double, lon double, asn string, session_id string, browser_timezone string, locale string, platform string, webgl_renderer string, screen string"
ENVELOPE = f"event_id string, event_type string, source string, occurred_at string, schema_version string, subject struct<customer_id:string,account_id:string>, context struct<{', '.join(c.replace(' ', ':') for c in CONTEXT.split(', '))}>, payload string"


def instant(text: Column) -> Column:
    """A timestamp with an offset, with or without a colon in it, or Z; null for anything else."""
    tidy = F.regexp_replace(F.regexp_replace(F.trim(text), "Z$", "+00:00"), r"([+-]\d\d)(\d\d)$", "$1:$2")
    return F.when(tidy.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?[+-]\d\d:\d\d$"), F.try_to_timestamp(tidy))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file) of text files, without blank lines."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")).where(F.trim("line") != "")


def parted(rows: DataFrame, wrong: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows with nothing wrong, without line and file; (file, line, errors) of the others)."""
    rows = rows.withColumn("errors", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in wrong.items()])))
    return rows.where("size(errors) = 0").drop("line", "file", "errors"), rows.where("size(errors) > 0").select("file", "line", "errors")


def event_lines(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of JSON lines (``raw``: line, file; a stream of text files too) and the lines that are none.

    An event has an id of its form, a known type, an instant with an offset and a payload.
    """
    e = F.from_json("line", ENVELOPE)
    rows = raw.withColumn("e", e)
    typed = rows.select(
        "line", "file", F.col("e.event_id").alias("event_id"), F.col("e.event_type").alias("event_type"), F.col("e.source").alias("source"), instant(F.col("e.occurred_at")).alias("occurred_at"),
        F.col("e.subject.customer_id").alias("customer_id"), F.col("e.subject.account_id").alias("account_id"), "e.context.*", F.col("e.payload").alias("payload"),
    )
    return parted(typed, {
        "event_id": ~F.col("event_id").rlike("^evt_[0-9a-zA-Z]{8,40}$"), "event_type": ~F.col("event_type").isin(*EVENT_TYPES), "occurred_at": F.col("occurred_at").isNull(), "payload": F.col("payload").isNull(),
    })


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return event_lines(lines(spark, path))


def alerts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alerts of a network sensor's JSON lines, and lines that should be alerts but lack something.

    Lines of other kinds are neither. Severity is held between 1 and 3.
    """
    shape = "timestamp string, event_type string, src_ip string, dest_ip string, dest_port int, alert struct<signature_id:long,signature:string,category:string,severity:int>"
    rows = raw.withColumn("e", F.from_json("line", shape)).where("e.event_type = 'alert' or e.event_type is null")
    typed = rows.select(
        "line", "file", instant(F.col("e.timestamp")).alias("occurred_at"), *[F.col(f"e.{c}").alias(c) for c in ("src_ip", "dest_ip", "dest_port")], *[F.col(f"e.alert.{c}").alias(c) for c in ("signature_id", "signature", "category")],
        F.greatest(F.lit(1), F.least(F.lit(3), F.when(F.col("e.alert.severity").isNotNull(), F.col("e.alert.severity")))).alias("severity"), F.col("e.alert.severity").isNull().alias("unranked"),
    )
    needed = ("occurred_at", "src_ip", "dest_ip", "dest_port", "signature_id", "signature", "category")
    good, bad = parted(typed, {**{c: F.col(c).isNull() for c in needed}, "severity": F.col("unranked")})
    return good.drop("unranked"), bad


def read_alerts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return alerts(lines(spark, path))


def ipv4(text: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    part = lambda i: F.regexp_extract(text, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("long")
    fits = (F.greatest(*[part(i) for i in (1, 2, 3, 4)]) <= 255)
    return F.when(fits, ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4))


def networks(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first, last, prefix, network_type, net_asn, zone, confidence) of ``cidr,network_type,asn,org,ip_timezone,confidence``
    lines; lines that begin with # and the header are neither good nor bad. Confidence is 0.9 where it is empty."""
    body = raw.where(~F.trim("line").startswith("#") & ~F.lower(F.trim("line")).startswith("cidr,"))
    f = F.from_csv("line", "cidr string, network_type string, asn string, org string, ip_timezone string, confidence string")
    rows = body.withColumn("e", f)
    prefix = F.coalesce(F.nullif(F.regexp_extract(F.trim("e.cidr"), r"/(\d{1,2})$", 1), F.lit("")), F.lit("32")).try_cast("int")
    size = F.pow(F.lit(2.0), 32 - F.col("prefix")).cast("long")
    base = ipv4(F.regexp_replace(F.trim("e.cidr"), r"/\d{1,2}$", ""))
    rows = rows.select("line", "file", "e", prefix.alias("prefix"), base.alias("base")).withColumn("prefix", F.when(F.col("prefix").between(0, 32), F.col("prefix")))
    kind, zone = F.lower(F.trim(F.coalesce("e.network_type", F.lit("")))), F.nullif(F.trim("e.ip_timezone"), F.lit(""))
    given = F.nullif(F.trim("e.confidence"), F.lit(""))
    typed = rows.withColumn("first", F.col("base") - F.pmod("base", size)).select(
        "line", "file", "first", (F.col("first") + size - 1).alias("last"), "prefix", kind.alias("network_type"), asn(F.col("e.asn")).alias("net_asn"), zone.alias("zone"),
        F.when(given.isNull(), 0.9).otherwise(given.try_cast("double")).alias("confidence"),
    )
    return parted(typed, {"cidr": F.col("first").isNull() | F.col("prefix").isNull(), "network_type": ~F.col("network_type").isin(*NETWORK_TYPES), "confidence": ~F.col("confidence").between(0, 1)})


def proxy_ranges(raw: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(first, last, network_type) of ``"from","to","type",...`` lines with whole-number addresses below 2^32; lines of
    types that ``kinds`` does not name and lines without numbers are left out."""
    e = F.from_csv("line", "a string, b string, kind string")
    named = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.upper(F.trim("e.kind")))
    rows = raw.withColumn("e", e).select(F.trim("e.a").try_cast("long").alias("first"), F.trim("e.b").try_cast("long").alias("last"), named.alias("network_type"))
    return rows.where(F.col("first").isNotNull() & F.col("last").between(F.col("first"), F.lit((1 << 32) - 1)) & F.col("network_type").isNotNull())


def network_list(raw: DataFrame) -> DataFrame:
    """(first, last) of one IPv4 network or address a line; text after # and blank lines are left out."""
    text = F.trim(F.regexp_replace("line", "#.*$", ""))
    prefix = F.coalesce(F.nullif(F.regexp_extract(text, r"/(\d{1,2})$", 1), F.lit("")), F.lit("32")).try_cast("int")
    size = F.pow(F.lit(2.0), 32 - F.least(prefix, F.lit(32))).cast("long")
    base = ipv4(F.regexp_replace(text, r"/\d{1,2}$", ""))
    return raw.select((base - F.pmod(base, size)).alias("first"), (base - F.pmod(base, size) + size - 1).alias("last")).where("first is not null")


def rule_configs(spark: SparkSession, path: str) -> DataFrame:
    """(rule, p, stage, thresholds: map) of JSON files, one rule an object; a rule without an id or a p in 0..1 is an error,
    as a detector must not run on half of its rules."""
    rows = spark.read.schema("rule string, p double, stage string, thresholds map<string,double>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    bad = F.col("rule").isNull() | ~F.coalesce(F.col("p").between(0, 1), F.lit(False))
    return rows.withColumn("rule", F.when(bad, F.raise_error(F.concat(F.lit("no id or p: "), F.coalesce("rule", F.lit("?"))))).otherwise(F.col("rule")))


def event_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """(line, file) of new text files in a folder, for :func:`event_lines` on a stream; where a restarted
    query goes on is kept by its own checkpoint."""
    raw = spark.readStream.schema(T.StructType([T.StructField("value", T.StringType())])).option("maxFilesPerTrigger", files_at_once).format("text").load(folder)
    return raw.select(F.col("value").alias("line"), F.lit(folder).alias("file")).where(F.trim("line") != "")
