"""Scalar functions of the engine as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000
#: Fixed value: "no recent occurrence" in minutes (seven days).
NONE_RECENT = 10_080.0


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # least() skips nulls, and an unknown place has no distance
    return F.when(a.isNotNull(), 2 * 6371.0088 * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def ist_hour(us: Column) -> Column:
    """Hour of the day at +05:30, in fractions (to the second) of an hour."""
    return F.floor(F.pmod(us + 330 * MINUTE, F.lit(DAY)) / 1_000_000) / 3600


def circular_hours(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(24.0))
    return F.least(d, 24 - d)


def minutes_since(now: Column, then: Column) -> Column:
    recent = then.isNotNull() & (now - then <= 7 * DAY)
    return F.when(recent, F.greatest(F.lit(0.0), (now - then) / MINUTE)).otherwise(NONE_RECENT)


def near_limit(amount: Column, limits: tuple[int, ...], fraction: float = 0.95) -> Column:
    """The smallest limit L with fraction * L <= amount < L, or null."""
    return F.coalesce(*[F.when((amount >= fraction * limit) & (amount < limit), F.lit(limit).cast("long")) for limit in sorted(limits)])


def band(p: Column, medium: float = 0.20, high: float = 0.50, critical: float = 0.80) -> Column:
    return F.when(p >= critical, "CRITICAL").when(p >= high, "HIGH").when(p >= medium, "MEDIUM").otherwise("LOW")


def kind(token: Column) -> Column:
    return F.substring_index(token, ":", 1)


def token(kind: str, raw: Column, key: bytes) -> Column:
    """``kind:`` and 16 base-32 letters of the HMAC-SHA256 of the normalised raw value, without a UDF."""
    value = F.trim(raw)
    if kind == "email":
        value = F.lower(value)
    elif kind == "phone":
        value = F.right(F.regexp_replace(value, r"\D", ""), F.lit(10))
    elif kind == "ip":
        value = F.regexp_replace(value, r"^(\d+\.\d+\.\d+)\.\d+$", "$1.0/24")
    elif kind in ("acct", "cust"):
        value = F.replace(F.upper(value), F.lit(" "), F.lit(""))
    key = key.ljust(64, b"\0")
    pads = [F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C)]
    inner = F.unhex(F.sha2(F.concat(pads[0], F.concat(F.lit(f"{kind}:"), value).cast("binary")), 256))
    digest = F.sha2(F.concat(pads[1], inner), 256)
    halves = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(2)]
    letters = F.translate(F.lower(F.concat(*halves)), "0123456789abcdefghijklmnopqrstuv", "abcdefghijklmnopqrstuvwxyz234567")
    return F.concat(F.lit(f"{kind}:"), letters)


def asn(text: Column) -> Column:
    digits = F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)AS(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"^\s*(\d+)\s*$", 1), F.lit("")))
    return F.when(digits.isNotNull(), F.concat(F.lit("AS"), digits.cast("long").cast("string")))
