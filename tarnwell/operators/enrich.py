"""Enrichment of raw events: platform, network, consistency of time zone and device, validation."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import asn  # noqa: F401  part of enrichment, and of readers too

#: Demo networks, most specific first by prefix (cidr, type, asn, time zone, confidence).
NETWORKS = (
    ("185.220.101.0/24", "hosting", "AS64500", "Europe/Berlin", 0.9),
    ("192.0.2.0/24", "vpn", "AS64501", "Europe/Amsterdam", 0.9),
    ("198.51.100.0/24", "tor", "AS64502", "Europe/Berlin", 0.9),
    ("203.0.113.0/24", "hosting", "AS64503", "America/New_York", 0.9),
    ("49.207.10.0/24", "mobile", "AS24560", "Asia/Kolkata", 0.8),
    ("103.21.4.0/24", "mobile", "AS55836", "Asia/Kolkata", 0.8),
)


def network_table(spark, networks: tuple = NETWORKS) -> DataFrame:
    """(first, last, prefix, network_type, asn, zone, confidence) of CIDR blocks."""
    rows = []
    for cidr, *rest in networks:
        base, prefix = cidr.split("/")
        a, b, c, d = map(int, base.split("."))
        first = ((a * 256 + b) * 256 + c) * 256 + d
        rows.append(F.struct(F.lit(first).cast("long").alias("first"), F.lit(first + 2 ** (32 - int(prefix)) - 1).cast("long").alias("last"), F.lit(int(prefix)).alias("prefix"), *[F.lit(v).cast("double" if n == "confidence" else "string").alias(n) for v, n in zip(rest, ("network_type", "net_asn", "zone", "confidence"), strict=True)]))
    return spark.range(1).select(F.inline(F.array(*rows)))


#: Blocks of addresses that are broadcast at most; more are joined by a shuffle.
MOST_BLOCKS = 500_000


def range_join(rows: DataFrame, ranges: DataFrame, bits: int = 16, fields: tuple[str, ...] = ("network_type", "net_asn", "zone", "confidence"), first: Column | None = None) -> DataFrame:
    """Each row with the most specific range that holds its ``ip_number`` (nulls where none does), or the least by ``first``.

    Ranges are gathered by blocks of 2^bits addresses, the one to prefer first, so a row finds its range in
    one join by block, without a shuffle of its own where the blocks are few.
    """
    cut = ranges.withColumn("block", F.explode(F.sequence(F.shiftright("first", bits), F.shiftright("last", bits))))
    order = -F.col("prefix") if first is None else first
    blocks = cut.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(order.alias("order"), "first", "last", *fields))).alias("held"))
    if blocks.count() <= MOST_BLOCKS:
        blocks = F.broadcast(blocks)
    found = rows.withColumn("block", F.shiftright("ip_number", bits)).join(blocks, "block", "left")
    hit = F.get(F.filter("held", lambda r: F.col("ip_number").between(r["first"], r["last"])), F.lit(0))
    return found.withColumn("hit", hit).select(*[F.col(c) for c in rows.columns], *[F.col(f"hit.{f}").alias(f) for f in fields])


#: IPv4 blocks that are no one's address on the public network (as the registries list them).
SPECIAL = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")
#: How sure each source is of what it says, where a range does not say so itself.
SURE = {"demo_list": 0.9, "ip2proxy": 0.8, "cgnat_list": 0.6, "asn_map": 0.4, "special": 0.3, "none": 0.0}
#: Sources in the order in which they are asked; an operator's number is asked between the last two.
SOURCES = ("demo_list", "ip2proxy", "cgnat_list", "special")


def networks_known(rows: DataFrame, ranges: dict[str, DataFrame], asn_types: dict[str, str]) -> DataFrame:
    """``rows`` (ip_number, net_hint: the operator as the sender gives it) with network_type, network_source, confidence, zone and
    net_asn of the first source that knows.

    ``ranges``: by name of SOURCES, (first, last) and, where the source has them, prefix, network_type, net_asn, zone,
    confidence; a source that is not given knows nothing. Within a source the most specific range counts (of
    ranges without a prefix the shortest). All sources are one table of ranges, so a row takes one join whatever
    their number. A null or other ip_number is of an unknown network, of source none, even with a hint."""
    spark, parts = rows.sparkSession, []
    given = {**ranges, "special": network_table(spark, tuple((cidr, "unknown", None, None, SURE["special"]) for cidr in SPECIAL))}
    if not set(given) <= set(SOURCES):
        raise ValueError(f"sources are {SOURCES}")
    for name, held in given.items():
        have = lambda c, t, or_=None, held=held: (F.col(c) if c in held.columns else F.lit(None)).cast(t) if or_ is None else F.coalesce((F.col(c) if c in held.columns else F.lit(None)).cast(t), F.lit(or_))
        kind = have("network_type", "string", "mobile" if name == "cgnat_list" else "unknown")
        rank = F.struct(F.lit(SOURCES.index(name)).alias("source"), (F.col("last") - F.col("first")).alias("size"))
        parts.append(held.select("first", "last", rank.alias("rank"), kind.alias("network_type"), have("net_asn", "string").alias("net_asn"), have("zone", "string").alias("zone"), have("confidence", "double", SURE[name]).alias("confidence"), F.lit(name).alias("network_source")))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    found = range_join(rows, table, fields=("network_type", "net_asn", "zone", "confidence", "network_source"), first=F.col("rank"))
    hint = asn(F.col("net_hint"))
    by_hint = F.element_at(F.create_map(*[F.lit(x) for kv in asn_types.items() for x in kv]), hint) if asn_types else F.lit(None).cast("string")
    told = F.col("ip_number").isNotNull() & by_hint.isNotNull() & (F.coalesce("network_source", F.lit("special")) == "special")
    return found.withColumns({
        "network_type": F.when(told, by_hint).otherwise(F.coalesce("network_type", F.lit("unknown"))),
        "net_asn": F.when(told, hint).otherwise(F.col("net_asn")),
        "confidence": F.when(told, SURE["asn_map"]).otherwise(F.coalesce("confidence", F.lit(SURE["none"]))),
        "network_source": F.when(told, "asn_map").otherwise(F.coalesce("network_source", F.lit("none"))),
    })


#: Words in an operator's name that tell its kind, anonymisers first.
ORG_WORDS = {
    "vpn": ("vpn", "proxy", "anonym", "privacy"),
    "hosting": ("hosting", "hostco", "cloud", "datacenter", "data center", "digitalocean", "ovh", "hetzner", "amazon", "google llc", "microsoft", "linode", "akamai", "vultr", "choopa", "leaseweb", "contabo", "m247", "colocation", "server"),
    "mobile": ("mobile", "cellular", "wireless", "telecom", "airtel", "jio", "vodafone"),
}


def classify_org(org: Column) -> Column:
    """The kind of network that an operator's name speaks of, null if of none."""
    low, out = F.lower(org), F.lit(None).cast("string")
    for kind in reversed(list(ORG_WORDS)):
        out = F.when(low.rlike("|".join(ORG_WORDS[kind])), kind).otherwise(out)
    return out


#: How far a location of a kind of network is to be trusted; an unknown one of low confidence less.
GEO = {"tor": 0.2, "vpn": 0.3, "hosting": 0.3, "residential": 1.0, "mobile": 1.0, "unknown": 1.0}
GEO_LOW, GEO_DOUBT = 0.3, 0.7


def geo_confidence(network_type: Column, confidence: Column) -> Column:
    """How far a location is to be trusted: 1 where the event was not enriched."""
    factor = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in GEO.items() for x in kv]), network_type), F.lit(1.0))
    return F.when(network_type.isNull(), 1.0).when((network_type == "unknown") & (F.coalesce(confidence, F.lit(0.0)) < GEO_LOW), GEO_DOUBT).otherwise(factor)


def platform(agent: Column) -> Column:
    low = F.lower(agent)
    return F.concat(F.lit("ua:"), F.when(low.contains("android"), "android").when(low.contains("iphone") | low.contains("ipad"), "ios").when(low.contains("windows"), "windows").when(low.contains("mac"), "macos").when(low.contains("linux"), "linux").otherwise("other"))


#: Names of time zones that Spark knows too: regions, and UTC; others are compared by name.
ZONES = sorted(z for z in available_timezones() if "/" in z and not z.startswith(("Etc/", "SystemV/")) or z == "UTC")


def zone_mismatch(us: Column, browser: Column, network: Column) -> Column:
    """Whether two zones have different offsets at the instant; where one of them is no known zone, whether their
    names differ. Null and empty zones never differ."""
    at, known = F.timestamp_micros(us), browser.isin(*ZONES) & network.isin(*ZONES)
    # an unknown name would end the query, so it comes to the conversion as null
    local = lambda zone: F.from_utc_timestamp(at, F.when(zone.isin(*ZONES), zone))
    named = (F.trim(browser) != "") & (F.trim(network) != "")
    differ = F.when(known, local(browser) != local(network)).otherwise(F.lower(F.trim(browser)) != F.lower(F.trim(network)))
    return F.coalesce(named & differ, F.lit(False))


def device_mask(platform: Column, pointer: Column, gpu: Column, short_side: Column, first_platform: Column) -> Column:
    """Six bits of inconsistency between what a device says and what it shows."""
    mobile = F.lower(platform).rlike("android|ios|iphone|ipad")
    desktop = ~mobile & F.lower(platform).rlike("win|mac|linux")
    bits = [mobile & (pointer == "mouse"), desktop & F.lower(gpu).rlike("adreno|mali|apple gpu"), mobile & F.lower(gpu).rlike("nvidia|radeon|intel"), F.lower(gpu).rlike("swiftshader|llvmpipe"), mobile & (short_side > 1600), platform != first_platform]
    return sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))


def errors(rows: DataFrame) -> DataFrame:
    """``rows`` with the list of what is wrong with each; an empty list means it is accepted."""
    checks = {
        "event_id": F.col("event_id").isNull(),
        "us": F.col("us").isNull(),
        "amount": (F.col("kind") == "transaction") & (F.coalesce(F.col("amount"), F.lit(0)) <= 0),
        "payee": F.col("kind").isin("transaction", "payee_added") & F.col("payee").isNull(),
        "result": (F.col("kind") == "login") & ~F.coalesce(F.col("result").isin("success", "failure"), F.lit(False)),
        "self": F.col("payee") == F.col("account"),
    }
    return rows.withColumn("errors", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])))
