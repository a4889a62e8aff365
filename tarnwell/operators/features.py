"""As-of feature windows: what was known just before each event, in event time.

Each function takes events with ``o`` (see :func:`tarnwell.sources.bridge.ordered`) and returns one row
per event it describes. Frames are ranges of ``o``, so Spark sorts each key once and streams over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DAY, HOUR, MINUTE, circular_hours, haversine_km, ist_hour, minutes_since, near_limit
from ..sources.bridge import STEP, back

#: Transfer limits in paise.
LIMITS = (10_000_000, 20_000_000, 50_000_000)


def window(keys: list[str], span: int | None, upto: int = -1):
    """Events of a key within ``span`` microseconds before this one; upto=0 with this one."""
    low = Window.unboundedPreceding if span is None else back(span)
    return Window.partitionBy(*keys).orderBy("o").rangeBetween(low, upto)


def count_if(condition: Column, over) -> Column:
    return F.coalesce(F.sum(condition.cast("long")).over(over), F.lit(0))


def total(value: Column, over) -> Column:
    return F.coalesce(F.sum(value).over(over), F.lit(0))


def with_trailing(rows: DataFrame, key: str, span: int, distinct: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` (with us and o) with what the rows of ``key`` showed within ``span`` microseconds, this row included: how many
    ``distinct`` values (nulls aside), and ``sums`` of whole numbers (0 without any).

    Rows of one place see each other. Each row makes a step up at its place, and a step down where it leaves the span, for a distinct value only where
    no other sighting holds it. The steps are summed up in one order, so no row meets the rows of its frame.
    """
    distinct, sums, columns = distinct or {}, sums or {}, rows.columns
    names = [*distinct, *sums]
    rows = rows.withColumns({f"_{n}": c for n, c in (distinct | sums).items()})
    for n in distinct:
        own, held = Window.partitionBy(key, f"_{n}").orderBy("o"), F.col(f"_{n}").isNotNull()
        before, after = F.col("us") - F.lag("us").over(own), F.lead("us").over(own) - F.col("us")
        rows = rows.withColumns({f"_up_{n}": (held & F.coalesce(before > span, F.lit(True))).cast("long"), f"_down_{n}": (held & F.coalesce(after > span, F.lit(True))).cast("long")})
    worth = {n: F.coalesce(F.col(f"_{n}").cast("long"), F.lit(0)) for n in sums}
    up = [(F.col(f"_up_{n}") if n in distinct else worth[n]).alias(n) for n in names]
    down = [-(F.col(f"_down_{n}") if n in distinct else worth[n]) for n in names]
    # after all events that the span still holds, before the next microsecond
    end = ((F.col("us") + span).cast("decimal(20,0)") * STEP + STEP // 2).cast("decimal(30,0)")
    steps = F.struct(F.struct(*columns).alias("row"), F.col("o").alias("at"), *up)
    leaves = F.greatest(*[F.abs(c) for c in down], F.lit(0)) > 0
    ends = F.when(leaves, F.struct(F.lit(None).alias("row"), end.alias("at"), *[c.alias(n) for c, n in zip(down, names, strict=True)]))
    both = rows.select(F.col(key).alias("_key"), F.explode(F.array_compact(F.array(steps, ends))).alias("x")).select("_key", "x.*")
    over = Window.partitionBy("_key").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    found = both.select("row", *[F.sum(n).over(over).alias(n) for n in names]).where("row is not null")
    return found.select("row.*", *names)


def amounts(events: DataFrame) -> DataFrame:
    """Log amount, amount to the prior 30-day median, count in 1 h and sum in 24 h of the customer."""
    key = ["customer"]
    median = F.percentile("amount", F.lit(0.5)).over(window(key, 30 * DAY))
    return events.where("kind = 'transaction'").select(
        "event_id",
        F.log1p(F.col("amount") / 100).alias("log_amount"),
        F.when(median > 0, F.col("amount") / median).otherwise(1.0).alias("amount_to_median_30d"),
        F.count("amount").over(window(key, HOUR)).alias("txn_count_1h"),
        total(F.col("amount"), window(key, DAY)).alias("txn_sum_24h_paise"),
    )


def payees(events: DataFrame) -> DataFrame:
    """When the payee was added, who else paid it in 24 h, what passed through it, and what this customer paid it."""
    pair, moves = ["customer", "payee"], events.where("kind in ('transaction', 'payee_added')")
    added = F.last(F.when(F.col("kind") == "payee_added", F.col("us")), True).over(Window.partitionBy(*pair).orderBy("o").rowsBetween(Window.unboundedPreceding, -1))
    near = near_limit(F.col("amount"), LIMITS).isNotNull()
    paid = F.col("kind") == "transaction"
    sent = moves.withColumns({"added": added, "payee_sum_24h_paise": total(F.col("amount"), window(pair, DAY)), "near_limit_count_24h": count_if(paid & near, window(pair, DAY, 0))}).where(paid)
    fan_in = with_trailing(sent, "payee", DAY, {"payers": F.col("customer")})
    # this payment's own customer is among the payers
    fan_in = fan_in.withColumn("payee_fan_in_24h", F.col("payers") - F.col("customer").isNotNull().cast("long"))
    none = F.lit(0).cast("long")
    into = fan_in.select("*", F.col("payee").alias("leg"), F.col("amount").alias("inbound"), none.alias("outbound"), F.lit(True).alias("into"))
    out = events.where("kind = 'transaction'").select("us", "o", F.col("account").alias("leg"), none.alias("inbound"), F.col("amount").alias("outbound"), F.lit(False).alias("into"))
    legs = into.unionByName(out, allowMissingColumns=True)
    flow = with_trailing(legs, "leg", DAY, sums={"i": F.col("inbound"), "u": F.col("outbound")}).where("into")
    # the payment itself is not before itself, nor is what its payee paid at its place: itself, paid to oneself
    flow = flow.withColumns({"i": F.col("i") - F.coalesce("inbound", none), "u": F.col("u") - F.when(F.col("payee") == F.col("account"), F.coalesce("amount", none)).otherwise(0)})
    return flow.select(
        "event_id",
        minutes_since(F.col("us"), F.col("added")).alias("minutes_since_payee_added"),
        F.coalesce(F.col("us") - F.col("added") < DAY, F.lit(False)).alias("payee_is_new"),
        "payee_fan_in_24h",
        F.when(F.col("i") > 0, F.col("u") / F.col("i")).otherwise(0.0).alias("payee_passthrough_24h"),
        "payee_sum_24h_paise",
        "near_limit_count_24h",
    )


def logins(events: DataFrame) -> DataFrame:
    """History of the customer before each login: hours, home, travel speed and recent failures."""
    key = ["customer"]
    month, hour = window(key, 30 * DAY), window(key, HOUR)
    good = F.col("result") == "success"
    place = F.struct(F.bround("lat", 2).alias("lat"), F.bround("lon", 2).alias("lon"))
    # the last login whose place is known
    known = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("us", "lat", "lon"))
    last = F.last(known, True).over(Window.partitionBy("customer").orderBy("o").rowsBetween(Window.unboundedPreceding, -1))
    rows = events.where("kind = 'login'").select(
        "*",
        F.count(F.when(good, F.lit(1))).over(month).alias("past_logins_30d"),
        F.percentile(F.when(good, ist_hour(F.col("us"))), F.lit(0.5)).over(month).alias("usual"),
        F.collect_list(F.when(good, place)).over(month).alias("places"),
        count_if(F.col("result") == "failure", hour).alias("failed_logins_1h"),
        last.alias("last"),
    )
    # the most frequent place; of equally frequent ones the first seen
    seen = F.array_distinct("places")
    counts = F.transform(seen, lambda d: F.size(F.filter("places", lambda p: p == d)))
    rows = rows.withColumn("home", F.get(seen, F.array_position(counts, F.array_max(counts)).cast("int") - 1))
    hours = F.greatest(F.lit(1 / 60), (F.col("us") - F.col("last.us")) / HOUR)
    return rows.select(
        "event_id",
        "past_logins_30d",
        F.coalesce(circular_hours(ist_hour(F.col("us")), F.col("usual")), F.lit(0.0)).alias("hour_deviation"),
        F.coalesce(haversine_km(F.col("lat"), F.col("lon"), F.col("home.lat"), F.col("home.lon")), F.lit(0.0)).alias("km_from_home"),
        F.coalesce(haversine_km(F.col("lat"), F.col("lon"), F.col("last.lat"), F.col("last.lon")) / hours, F.lit(0.0)).alias("travel_speed_kmh"),
        "failed_logins_1h",
    )


def devices(events: DataFrame) -> DataFrame:
    """Whether device and ASN are new to the customer, minutes since a new device and an MFA change."""
    rows = events
    for c in ("device", "asn"):
        last = F.lag("us").over(Window.partitionBy("customer", c).orderBy("o"))
        rows = rows.withColumn(f"{c}_new", last.isNull() | (F.col("us") - last > 30 * DAY))
    prior = Window.partitionBy("customer").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "new_at": F.last(F.when(F.col("device_new"), F.col("us")), True).over(prior),
        "mfa_at": F.last(F.when(F.col("kind") == "mfa_change", F.col("us")), True).over(prior),
    })
    return rows.select(
        "event_id",
        F.col("device_new").alias("device_first_seen"),
        F.col("asn_new").alias("asn_first_seen"),
        F.when(F.col("device_new"), 0.0).otherwise(minutes_since(F.col("us"), F.col("new_at"))).alias("minutes_since_new_device"),
        minutes_since(F.col("us"), F.col("mfa_at")).alias("minutes_since_mfa_change"),
    )


def ip_failures(events: DataFrame, span: int = HOUR) -> DataFrame:
    """Distinct customers with a failed login from the ip, this one's included."""
    failed = F.when(F.col("result") == "failure", F.col("customer"))
    logins = events.where("kind = 'login'").select("event_id", "us", "o", "ip", "result", "customer")
    return with_trailing(logins, "ip", span, {"ip_failed_customers_1h": failed}).select("event_id", "ip_failed_customers_1h")


def challenges(events: DataFrame) -> DataFrame:
    """Failed challenges in 15 min before, and rejected pushes in 10 min with this one."""
    rejected = (F.col("method") == "device_push") & F.col("result").isin("failed", "ignored")
    return events.where("kind = 'mfa_challenge'").select(
        "event_id",
        count_if(F.col("result") == "failed", window(["customer"], 15 * MINUTE)).alias("mfa_fails_15m"),
        count_if(rejected, window(["customer"], 10 * MINUTE, 0)).alias("push_rejects_10m"),
    )


def transfer_windows(events: DataFrame, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """The pair's transfers in 24 h with this one, and those just under a limit."""
    pair = ["customer", "payee"]
    day = window(pair, DAY, 0)
    near = near_limit(F.col("amount"), limits)
    rows = events.where("kind = 'transaction'").dropDuplicates(["event_id"]).withColumn("near", near)
    counts = [count_if(F.col("near") == limit, day) for limit in sorted(limits)]
    most = F.greatest(*counts)
    limit = F.coalesce(*[F.when((c == most) & (most > 0), F.lit(x).cast("long")) for c, x in zip(counts, sorted(limits), strict=True)], F.lit(0))
    first = F.min(F.when(F.col("near").isNotNull(), F.col("us"))).over(day)
    n = count_if(F.col("near").isNotNull(), day)
    rows = rows.select(
        "event_id",
        F.count("amount").over(day).alias("tw_pair_count_24h"),
        F.sum("amount").over(day).alias("tw_pair_sum_24h_paise"),
        F.count("amount").over(window(pair, HOUR, 0)).alias("tw_pair_count_1h"),
        n.alias("tw_near_limit_count_24h"),
        total(F.when(F.col("near").isNotNull(), F.col("amount")), day).alias("tw_near_limit_sum_24h_paise"),
        most.alias("tw_near_limit_same_limit_max_24h"),
        limit.alias("tw_near_limit_limit_paise"),
        ((F.col("us") - first) / HOUR).alias("span"),
    )
    rate = F.when(F.col("tw_near_limit_count_24h") > 0, F.col("tw_near_limit_count_24h") / F.greatest(F.lit(1.0), "span")).otherwise(0.0)
    return rows.withColumn("tw_near_limit_rate_per_h", rate).drop("span")


def account_failures(events: DataFrame) -> DataFrame:
    """Failed logins of the account (by number and source) and attempts of the device, this one included."""
    failed = F.col("result") == "failure"
    hour, day, own = window(["account"], HOUR, 0), window(["account"], DAY, 0), window(["device"], HOUR, 0)
    ips = F.collect_list(F.when(failed, F.col("ip"))).over(day)
    rows = events.where("kind = 'login'").select(
        "event_id",
        count_if(failed, hour).alias("acct_fail_1h"),
        (F.size(F.collect_set(F.when(failed, F.col("ip"))).over(hour)) + F.size(F.collect_set(F.when(failed, F.col("device"))).over(hour))).cast("long").alias("acct_fail_sources_1h"),
        ips.alias("ips"),
        F.size(F.collect_set("account").over(own)).cast("long").alias("dev_accounts_1h"),
        count_if(failed, own).alias("dev_fail_1h"),
    )
    per_ip = F.transform(F.array_distinct("ips"), lambda d: F.size(F.filter("ips", lambda x: x == d)))
    return rows.withColumns({
        "acct_fail_24h": F.size("ips").cast("long"),
        "acct_fail_ips_24h": F.size(F.array_distinct("ips")).cast("long"),
        "acct_max_fail_per_ip_24h": F.coalesce(F.array_max(per_ip), F.lit(0)).cast("long"),
    }).drop("ips")


def global_failures(events: DataFrame, ratio: float = 5.0, least: int = 30) -> DataFrame:
    """All failed logins in this minute and the nine before (with this one) against the 24 h before them.

    Minutes are aggregated first; the window over all of them is as long as the history has minutes,
    whatever the number of events.
    """
    logins = events.where("kind = 'login'").withColumn("minute", F.floor(F.col("us") / MINUTE))
    failed = (F.col("result") == "failure").cast("long")
    by_minute = logins.groupBy("minute").agg(F.sum(failed).alias("n"))
    full = Window.orderBy("minute")
    by_minute = by_minute.select(
        "minute",
        F.coalesce(F.sum("n").over(full.rangeBetween(-9, -1)), F.lit(0)).alias("recent"),
        F.coalesce(F.sum("n").over(full.rangeBetween(-9 - 1440, -10)), F.lit(0)).alias("base"),
    )
    inside = F.sum(failed).over(Window.partitionBy("minute").orderBy("o").rowsBetween(Window.unboundedPreceding, 0))
    rows = logins.withColumn("inside", inside).join(by_minute, "minute")
    n, base = F.col("recent") + F.col("inside"), F.col("base") / 144
    return rows.select("event_id", n.alias("global_fail_10m"), base.alias("global_fail_baseline_10m"), ((n >= least) & (n >= ratio * base)).alias("global_spike"))


def usual_device(events: DataFrame) -> DataFrame:
    """Each customer's most used device; of equals the first by name."""
    used = events.groupBy("customer", "device").count()
    rank = F.row_number().over(Window.partitionBy("customer").orderBy(F.desc("count"), "device"))
    return used.withColumn("rank", rank).where("rank = 1").select("customer", "device", F.col("count").alias("events"))


def staff_reads(acts: DataFrame, span: int = HOUR) -> DataFrame:
    """Distinct customers that each act's staff identity touched within ``span``, this act's included."""
    own = acts.select("event_id", "us", "o", "staff", "customer")
    return with_trailing(own, "staff", span, {"customers_60m": F.col("customer")}).select("event_id", "customers_60m")


def new_device_logins(acts: DataFrame, logins: DataFrame, fresh: int = 2 * HOUR, established: int = DAY) -> DataFrame:
    """(event_id, new_device_login): whether the customer of an act had logged in from a device first seen
    within ``fresh``, and from one first seen ``established`` ago or earlier.

    First sightings (one row per account and device) and acts are put in one order, so no act meets all
    sightings of its customer.
    """
    first = logins.groupBy("customer", "account", "device").agg(F.min("us").alias("us"))
    both = acts.select("customer", "us", "event_id").unionByName(first.select("customer", "us", F.lit(None).cast("long").alias("event_id")))
    order = Window.partitionBy("customer").orderBy("us")
    seen = F.when(F.col("event_id").isNull(), 1)
    new = F.count(seen).over(order.rangeBetween(-fresh, 0)) > 0
    old = F.count(seen).over(order.rangeBetween(Window.unboundedPreceding, -established)) > 0
    return both.withColumn("new_device_login", new & old).where("event_id is not null").select("event_id", "new_device_login")
