"""The entity graph as edge tables: derivation, merging, hubs, bounded walks and account flow.

Edges are (src, dst, edge_type, confidence, first_seen, last_seen, count, ids). Walks are unrolled
joins, one per hop, with excluded nodes taken out at every hop; no graph is held in memory.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DAY, HOUR, MINUTE, kind
from ..sources.stable import stable
from .features import with_trailing

#: Edge confidence by type, and how many customers make a hub.
CONFIDENCE = {"LOGGED_IN_FROM": 0.9, "CONNECTED_VIA": 0.5, "OWNS": 1.0, "RESET": 0.9, "HAS_PHONE": 1.0, "ADDED_PAYEE": 0.9, "SENT": 1.0, "SHARES_DEVICE": 0.9}
HUB, MOST_IDS = 21, 50


def observations(events: DataFrame) -> DataFrame:
    """One row per edge that an event shows: src, dst, edge_type, confidence, us, event_id."""

    def edge(when: Column, src: str, dst: str, edge_type: str) -> Column:
        real = when & F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))
        return F.when(real, F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(edge_type).alias("edge_type"), F.lit(CONFIDENCE[edge_type]).alias("confidence")))

    login = F.col("kind") == "login"
    found = F.array_compact(F.array(
        edge(login & (F.col("result") == "success"), "account", "device", "LOGGED_IN_FROM"),
        edge(login, "device", "ip", "CONNECTED_VIA"),
        edge(login, "customer", "account", "OWNS"),
        edge(F.col("kind") == "payee_added", "account", "payee", "ADDED_PAYEE"),
        edge(F.col("kind") == "transaction", "account", "payee", "SENT"),
    ))
    return events.select("us", "event_id", F.inline(found))


def merged(seen: DataFrame) -> DataFrame:
    """Observations of one edge as one row; the first ``MOST_IDS`` event ids stay."""
    ids = F.transform(F.sort_array(F.collect_list(F.when(F.col("place") <= MOST_IDS, F.struct("us", "event_id")))), lambda x: x["event_id"])
    edge = ["src", "dst", "edge_type"]
    place = F.row_number().over(Window.partitionBy(*edge).orderBy("us", "event_id"))
    return seen.withColumn("place", place).groupBy(*edge).agg(
        F.max("confidence").alias("confidence"), F.min("us").alias("first_seen"), F.max("us").alias("last_seen"), F.count("*").alias("count"), ids.alias("ids")
    )


def shared_devices(edges: DataFrame, now: int, days: int = 30) -> DataFrame:
    """Pairs of customers whose accounts logged in from a device in the last days, hubs left out."""
    used = edges.where("edge_type = 'LOGGED_IN_FROM'").where(F.col("last_seen") >= now - days * DAY).select(F.col("src").alias("account"), F.col("dst").alias("device"))
    owners = edges.where("edge_type = 'OWNS'").select(F.col("src").alias("customer"), F.col("dst").alias("account"))
    held = used.join(owners, "account").select("device", "customer").distinct()
    few = held.groupBy("device").count().where(F.col("count").between(2, HUB - 1)).select("device")
    held = held.join(few, "device", "left_semi")
    # at most HUB - 1 customers a device, so pairs are bounded
    pairs = held.select("device", F.col("customer").alias("src")).join(held.select("device", F.col("customer").alias("dst")), "device").where("src < dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("devices"))


def linked_customers(edges: DataFrame) -> DataFrame:
    """(token, customers): distinct customers that each account, device and ip links to."""
    owners = edges.where("edge_type = 'OWNS'").select(F.col("src").alias("customer"), F.col("dst").alias("account"))
    money = edges.where("edge_type in ('SENT', 'ADDED_PAYEE')").select("src", "dst")
    both = money.unionByName(money.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    by_account = both.join(owners.withColumnRenamed("account", "src"), "src").select(F.col("dst").alias("token"), "customer")
    by_account = by_account.unionByName(owners.select(F.col("account").alias("token"), "customer"))
    by_device = edges.where("edge_type = 'LOGGED_IN_FROM'").select(F.col("src").alias("account"), F.col("dst").alias("token")).join(owners, "account").select("token", "customer")
    via = edges.where("edge_type = 'CONNECTED_VIA'").select(F.col("src").alias("token"), F.col("dst").alias("ip"))
    by_ip = via.join(by_device, "token").select(F.col("ip").alias("token"), "customer")
    return by_account.unionByName(by_device).unionByName(by_ip).groupBy("token").agg(F.countDistinct("customer").alias("customers"))


def excluded(edges: DataFrame) -> DataFrame:
    """Tokens that walks neither reach nor cross: hubs, merchants and cloud identities."""
    hubs = linked_customers(edges).where(F.col("customers") >= HUB).select("token")
    ends = edges.select(F.col("src").alias("token")).unionByName(edges.select(F.col("dst").alias("token")))
    return hubs.unionByName(ends.where(kind(F.col("token")).isin("mer", "cid"))).distinct()


def steps(edges: DataFrame, least: float) -> DataFrame:
    """(src, dst): both ways over edges of at least this confidence (strictly above 0)."""
    solid = edges.where((F.col("confidence") >= least) & (F.col("confidence") > 0)).select("src", "dst")
    return stable(solid.unionByName(solid.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())


def walk(edges: DataFrame, starts: DataFrame, hops: int, least: float, skip: DataFrame) -> DataFrame:
    """(start, token, hops): nodes within ``hops`` over edges of at least this confidence (strictly above 0).

    The steps and each hop's front are computed once.
    """
    step = stable(steps(edges, least).join(skip.select(F.col("token").alias("dst")), "dst", "left_anti"))
    reached = front = stable(starts.select("start", F.col("start").alias("token"), F.lit(0).alias("hops")))
    for hop in range(1, hops + 1):
        front = front.join(step, front["token"] == step["src"]).select("start", F.col("dst").alias("token")).distinct()
        front = stable(front.join(reached.drop("hops"), ["start", "token"], "left_anti").withColumn("hops", F.lit(hop)))
        reached = reached.unionByName(front)
    return reached.where("hops > 0")


def seed_distance(edges: DataFrame, starts: DataFrame, seeds: DataFrame, skip: DataFrame, hops: int = 3) -> DataFrame:
    """(start, hops, seed): the nearest seed of each start, 0 for a seed itself; ties by token.

    Seeds are few, so the walk goes from them: steps lead both ways, and a node that walks may not cross
    is reached (as a start) but not left.
    """
    step, skip = steps(edges, 0.0), stable(skip.select("token").distinct())
    own = seeds.select("seed", F.col("seed").alias("token"), F.lit(0).alias("hops"))
    reached = stable(own.join(skip, "token", "left_anti").select("seed", "token", "hops"))
    front = reached
    for hop in range(1, hops + 1):
        front = front.join(step, front["token"] == step["src"]).select("seed", F.col("dst").alias("token")).distinct()
        front = stable(front.join(reached.drop("hops"), ["seed", "token"], "left_anti").withColumn("hops", F.lit(hop)))
        reached = reached.unionByName(front)
        front = front.join(skip, "token", "left_anti")
    near = reached.where("hops > 0").unionByName(own).join(starts.select(F.col("start").alias("token")), "token")
    return near.groupBy(F.col("token").alias("start")).agg(F.min(F.struct("hops", "seed")).alias("m")).select("start", "m.hops", "m.seed")


def flow_profile(edges: DataFrame, now: int, window_h: int = 24, half_life_h: float = 72.0) -> DataFrame:
    """Payers, new payers, beneficiaries and decayed fan-in of each account at ``now``."""
    edges = edges.where(F.col("first_seen") <= now)
    cut = now - window_h * HOUR
    last = F.when(F.col("last_seen") <= now, F.col("last_seen")).otherwise(F.col("first_seen"))
    weight = F.col("confidence") * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), (now - last) / HOUR) / half_life_h)
    between = edges.where((kind(F.col("src")) == "acct") & (kind(F.col("dst")) == "acct") & F.col("edge_type").isin("SENT", "ADDED_PAYEE"))
    sent = F.col("edge_type") == "SENT"
    payer = between.groupBy(F.col("dst").alias("account"), "src").agg(F.min("first_seen").alias("first"), F.max(last).alias("last"), F.min(F.when(sent, F.col("first_seen"))).alias("money"), F.max(weight).alias("weight"))
    into = payer.groupBy("account").agg(
        F.count("*").alias("payers"), F.count_if(F.col("last") >= cut).alias("unique_payers_window"), F.count_if(F.col("first") >= cut).alias("new_payers_window"), F.count_if(F.col("money") >= cut).alias("new_money_payers_window"), F.sum("weight").alias("decayed_fan_in")
    )
    out = between.where(sent).groupBy(F.col("src").alias("account")).agg(F.count("*").alias("beneficiaries"), F.count_if(F.col("first_seen") >= cut).alias("new_beneficiaries_window"))
    ends = [edges.select(F.col(c).alias("account"), "first_seen") for c in ("src", "dst")]
    age = ends[0].unionByName(ends[1]).where(kind(F.col("account")) == "acct").groupBy("account").agg(((now - F.min("first_seen")) / DAY).alias("account_age_days"))
    counts = [c for df in (into, out) for c in df.columns if c != "account"]
    whole = age.join(into, "account", "left").join(out, "account", "left")
    return whole.select("account", "account_age_days", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def pass_through(edges: DataFrame, now: int, window_h: int = 24) -> DataFrame:
    """(account, pass_through_min): the shortest time from money in to money out within the window.

    Activity is known by an edge's first and last sighting; the last time in before each time out is
    taken by one window per account."""
    cut = now - window_h * HOUR
    sent = edges.where("edge_type = 'SENT'").where(F.col("first_seen") <= now)
    times = sent.select("src", "dst", F.explode(F.array("first_seen", "last_seen")).alias("us")).where(F.col("us").between(cut, now))
    legs = times.select(F.col("dst").alias("account"), "us", F.lit(0).alias("out")).unionByName(times.select(F.col("src").alias("account"), "us", F.lit(1).alias("out")))
    before = Window.partitionBy("account").orderBy("us", "out").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("out") == 0, F.col("us")), True).over(before)
    gaps = legs.withColumn("gap", (F.col("us") - last) / MINUTE).where("out = 1 and gap is not null")
    return gaps.groupBy("account").agg(F.min("gap").alias("pass_through_min"))


def dormant(edges: DataFrame, now: int, window_h: int = 24, days: int = 30) -> DataFrame:
    """Accounts older than ``days`` without activity from then to the window's start."""
    edges, cut, start = edges.where(F.col("first_seen") <= now), now - days * DAY, now - window_h * HOUR
    last = F.when(F.col("last_seen") <= now, F.col("last_seen")).otherwise(F.col("first_seen"))
    ends = [edges.select(F.col(c).alias("account"), "first_seen", last.alias("last")) for c in ("src", "dst")]
    seen = ends[0].unionByName(ends[1]).where(kind(F.col("account")) == "acct")
    between = lambda c: (F.col(c) > cut) & (F.col(c) < start)
    found = seen.groupBy("account").agg(F.min("first_seen").alias("oldest"), F.bool_or(between("first_seen") | between("last")).alias("awake"))
    return found.where((F.col("oldest") <= cut) & ~F.col("awake")).select("account")


@dataclass(frozen=True)
class Mule:
    """When the flow of an account is that of a mule."""

    window_h: int = 24
    young_days: float = 7.0
    least_new_payers: int = 3
    passing_minutes: float = 180.0
    passing_payers: int = 2
    fan_out: int = 3
    dormant_days: int = 30
    dormant_payers: int = 3
    hop_minutes: int = 240
    ring_accounts: int = 2
    ring_payers: int = 4


MULE_P = {"MULE_RING": 0.08, "MULE_PASS_THROUGH": 0.06, "MULE_RAPID_HOPS": 0.06, "MULE_FAN_OUT": 0.05, "MULE_DORMANT_ACTIVATED": 0.05, "MULE_FAN_IN_NEW_ACCOUNT": 0.03}


def rings(edges: DataFrame, paid: DataFrame, skip: DataFrame, now: int) -> DataFrame:
    """(account, members, payers_ring) of accounts with new payers (``paid``: account, fresh) that log in from one
    device with others that have some; each account and sibling counts once.

    Devices of hubs are out, so a device has few accounts and pairs stay few.
    """
    logged = edges.where("edge_type = 'LOGGED_IN_FROM'").where(F.col("first_seen") <= now).select(F.col("src").alias("account"), F.col("dst").alias("device"))
    logged = logged.join(skip.select(F.col("token").alias("device")), "device", "left_anti").join(paid.where("fresh >= 1"), "account")
    other = logged.select("device", F.col("account").alias("sibling"), F.col("fresh").alias("others"))
    pairs = logged.join(other, "device").where("account <> sibling").select("account", "fresh", "sibling", "others").distinct()
    return pairs.groupBy("account").agg((F.count("*") + 1).alias("members"), (F.first("fresh") + F.sum("others")).alias("payers_ring"))


def mule_signals(edges: DataFrame, now: int, skip: DataFrame, config: Mule = Mule()) -> DataFrame:
    """(account, codes): why each account looks like a mule at ``now``, strongest first; hubs have none."""
    edges = stable(edges)
    own = flow_profile(edges, now, config.window_h).join(pass_through(edges, now, config.window_h), "account", "left")
    own = stable(own.join(skip.select(F.col("token").alias("account")), "account", "left_anti"))
    fresh = F.col("new_money_payers_window")
    passing = (fresh >= config.passing_payers) & F.coalesce(F.col("pass_through_min") <= config.passing_minutes, F.lit(False))
    idle = dormant(edges, now, config.window_h, config.dormant_days).withColumn("idle", F.lit(True))
    recent = edges.where("edge_type = 'SENT'").where(F.col("first_seen").between(now - config.hop_minutes * MINUTE, now))
    fed = recent.join(own.where(passing).select(F.col("account").alias("src")), "src", "left_semi").select(F.col("dst").alias("account"), F.lit(True).alias("fed")).distinct()
    ring = rings(edges, own.select("account", fresh.alias("fresh")), skip, now)
    rows = own.join(idle, "account", "left").join(fed, "account", "left").join(ring, "account", "left")
    when = {
        "MULE_RING": (F.col("members") >= config.ring_accounts) & (F.col("payers_ring") >= config.ring_payers),
        "MULE_PASS_THROUGH": passing,
        "MULE_RAPID_HOPS": F.col("fed"),
        "MULE_FAN_OUT": (F.col("new_beneficiaries_window") >= config.fan_out) & (fresh >= 1),
        "MULE_DORMANT_ACTIVATED": F.col("idle") & (fresh >= config.dormant_payers),
        "MULE_FAN_IN_NEW_ACCOUNT": (F.col("account_age_days") < config.young_days) & (fresh >= config.least_new_payers),
    }
    codes = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in when.items()]))
    return rows.select("account", codes.alias("codes")).where("size(codes) > 0")


def reputation(edges: DataFrame, now: int, tenure_days: int = 7, recent_h: int = 24, age_days: float = 30.0, least: int = 3) -> DataFrame:
    """Payee standing at ``now``: payers, tenured and new ones, new outbound edges, and whether reputable
    (seeds aside)."""
    edges = edges.where(F.col("first_seen") <= now)
    recent = now - recent_h * HOUR
    paid = edges.where("edge_type in ('SENT', 'ADDED_PAYEE')").where(kind(F.col("src")) == "acct")
    payers = paid.groupBy(F.col("dst").alias("account"), "src").agg(F.min("first_seen").alias("first")).groupBy("account").agg(
        F.count("*").alias("payers"), F.count_if(F.col("first") <= now - tenure_days * DAY).alias("tenured"), F.count_if(F.col("first") >= recent).alias("fresh")
    )
    out = edges.where("edge_type = 'SENT'").groupBy(F.col("src").alias("account")).agg(F.count_if(F.col("first_seen") >= recent).alias("outbound"))
    ends = [edges.select(F.col(c).alias("account"), "first_seen") for c in ("src", "dst")]
    age = ends[0].unionByName(ends[1]).groupBy("account").agg(((now - F.min("first_seen")) / DAY).alias("age_days"))
    rows = payers.join(age, "account").join(out, "account", "left").withColumn("outbound", F.coalesce("outbound", F.lit(0)))
    good = (F.col("age_days") >= age_days) & (F.col("tenured") >= least) & (F.col("tenured") >= 0.5 * F.col("payers")) & (F.col("fresh") <= 0.5 * F.col("payers")) & ~((F.col("outbound") > 0) & (F.col("fresh") > 0))
    return rows.withColumn("reputable", good)


def shared_ips(events: DataFrame, hours: int = 24, devices: int = 8, accounts: int = 6) -> DataFrame:
    """For each login whether its ip is shared: many devices or (on logins that succeed) accounts in the window."""
    logins = events.where("kind = 'login'").select("event_id", "us", "o", "ip", "device", "account", "result")
    members = {"ip_devices": F.col("device"), "ip_accounts": F.when(F.col("result") == "success", F.col("account"))}
    rows = with_trailing(logins, "ip", hours * HOUR, members).select("event_id", *members)
    return rows.withColumn("shared_ip", (F.col("ip_devices") >= devices) | (F.col("ip_accounts") >= accounts))
