"""Upserts, summaries, outcomes and local graphs: joins and aggregates over cases, payments and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import HOUR, kind
from ..sources.stable import stable
from .fusion import STAGES
from .graph import MOST_IDS, dormant, flow_profile, pass_through

#: What a payment's state means for its outcome, and seconds between a payment and what comes before it.
OUTCOME = {"normal": "completed", "held": "held", "blocked": "blocked"}
LOGIN_BEFORE, PAYEE_BEFORE = 2_000_000, 1_000_000


def latest(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The row of the highest version of each key: what repeated upserts leave, in whatever order they came."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("x")).select(*key, "x.*")


def upserted(edges: DataFrame, fresh: DataFrame) -> DataFrame:
    """Merged edges after a batch of newly merged ones: the strongest confidence, the first and last sighting, the
    sum of counts and the first ids. Applying batches one by one gives what merging all at once gives."""
    both = edges.withColumn("turn", F.lit(0)).unionByName(fresh.withColumn("turn", F.lit(1)))
    parts = F.sort_array(F.collect_list(F.struct("turn", "ids")))  # two at most
    return both.groupBy("src", "dst", "edge_type").agg(
        F.max("confidence").alias("confidence"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("count").alias("count"),
        F.slice(F.flatten(F.transform(parts, lambda x: x["ids"])), 1, MOST_IDS).alias("ids"),
    )


def from_payments(payments: DataFrame, with_login: bool = False) -> DataFrame:
    """(kind, us, customer, payee, amount, fraud): payments as events. A payee is added a second before the first
    payment to it, and, if asked for, each payment has a login two seconds before it."""
    pair = Window.partitionBy("customer", "payee").orderBy("us", "event_id")
    columns = ["kind", "us", "customer", "payee", "amount", "fraud"]
    sent = payments.withColumns({"kind": F.lit("transaction"), "nth": F.row_number().over(pair)})
    added = sent.where("nth = 1").withColumns({"kind": F.lit("payee_added"), "us": F.col("us") - PAYEE_BEFORE, "amount": F.lit(None).cast("long"), "fraud": F.lit(None).cast("boolean")})
    out = sent.select(columns).unionByName(added.select(columns))
    if with_login:
        out = out.unionByName(sent.withColumns({"kind": F.lit("login"), "us": F.col("us") - LOGIN_BEFORE, "payee": F.lit(None).cast("string"), "amount": F.lit(None).cast("long"), "fraud": F.lit(None).cast("boolean")}).select(columns))
    return out


def account_features(edges: DataFrame, now: int) -> DataFrame:
    """The ten features of an account's flow for a model; -1 minutes where nothing passed through."""
    flow = flow_profile(edges, now)
    idle = dormant(edges, now).withColumn("idle", F.lit(True))
    rows = flow.join(pass_through(edges, now), "account", "left").join(idle, "account", "left")
    ratio = F.when(F.col("unique_payers_window") > 0, F.col("new_beneficiaries_window") / F.col("unique_payers_window")).otherwise(0.0)
    return rows.select(
        "account", "account_age_days", "payers", F.col("unique_payers_window").alias("unique_payers_24h"), F.col("new_payers_window").alias("new_payers_24h"), "beneficiaries", F.col("new_beneficiaries_window").alias("new_beneficiaries_24h"),
        ratio.alias("inflow_outflow_ratio"), F.coalesce("pass_through_min", F.lit(-1.0)).alias("pass_through_min"), F.when(F.col("idle") & (F.col("new_money_payers_window") >= 3), 1.0).otherwise(0.0).alias("dormant_activated"), "decayed_fan_in",
    )


def outcomes(decided: DataFrame) -> DataFrame:
    """(event_id, outcome, case_id) of each payment: the first of its cases whose state is not normal, else completed in
    the last. Needs event_id, case_id, nth (order of the cases within the event) and payment_state."""
    state = F.element_at(F.create_map(*[F.lit(x) for kv in OUTCOME.items() for x in kv]), F.col("payment_state"))
    rows = decided.withColumn("outcome", F.coalesce(state, F.lit("completed")))
    stopped = F.min_by(F.struct("outcome", "case_id"), F.when(F.col("outcome") != "completed", F.col("nth")))
    return rows.groupBy("event_id").agg(F.coalesce(stopped, F.max_by(F.struct("outcome", "case_id"), "nth")).alias("x")).select("event_id", "x.*")


def live_figures(cases: DataFrame, evidence: DataFrame, paid: DataFrame, least: float = 0.05) -> DataFrame:
    """One row: open cases, critical ones, alerts per open case, and the money of payments held or blocked in cases
    that were not found to be false alarms. paid: event_id, case_id, outcome, amount."""
    live = cases.where(F.col("status").isin("OPEN", "INVESTIGATING"))
    none = F.lit(0).cast("long")
    counted = live.select(F.lit(1).cast("long").alias("open"), (F.col("band") == "CRITICAL").cast("long").alias("critical"), none.alias("alerts"), none.alias("money"))
    alerts = evidence.where(F.col("p") >= least).join(live.select("case_id"), "case_id", "left_semi").select(none.alias("open"), none.alias("critical"), F.lit(1).cast("long").alias("alerts"), none.alias("money"))
    stopped = paid.where(F.col("outcome").isin("held", "blocked")).join(cases.select("case_id", "status"), "case_id", "left").where("coalesce(status, '') <> 'FALSE_POSITIVE'")
    money = stopped.select(none.alias("open"), none.alias("critical"), none.alias("alerts"), F.col("amount").alias("money"))
    total = counted.unionByName(alerts).unionByName(money).agg(*[F.coalesce(F.sum(c), none).alias(c) for c in ("open", "critical", "alerts", "money")])
    compression = F.when(F.col("open") > 0, F.round(F.col("alerts") / F.col("open"), 4)).otherwise(0.0)
    return total.select(F.col("open").alias("cases_open"), F.col("critical").alias("critical_open"), compression.alias("alert_compression"), F.col("money").alias("money_protected"))


def summaries(cases: DataFrame) -> DataFrame:
    """``cases`` (with stages: array) with stages_reached in their order and the furthest one."""
    reached = F.filter(F.array(*[F.lit(s) for s in STAGES]), lambda s: F.array_contains("stages", s))
    return cases.withColumn("stages_reached", reached).withColumn("current_stage", F.try_element_at("stages_reached", F.size("stages_reached"))).drop("stages")


def queue(cases: DataFrame, status: list[str] | None = None, band: list[str] | None = None) -> DataFrame:
    """The cases of these states and bands, where given."""
    for column, wanted in (("status", status), ("band", band)):
        cases = cases.where(F.col(column).isin(wanted)) if wanted else cases
    return cases


def merged_cases(cases: DataFrame, into: DataFrame) -> DataFrame:
    """Cases after merging (``into``: case_id, keep): all tokens, the first sighting of each stage, the whole span.

    Tokens and stages are sets already made, so a group holds as many arrays as cases were merged.
    """
    rows = cases.join(into, "case_id", "left").withColumn("keep", F.coalesce("keep", "case_id"))
    stages = rows.select("keep", F.explode("stages").alias("stage", "us")).groupBy("keep", "stage").agg(F.min("us").alias("us")).groupBy("keep").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "us")))).alias("stages"))
    tokens = rows.select("keep", F.explode("tokens").alias("token")).distinct().groupBy("keep").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    span = rows.groupBy("keep").agg(F.min("opened_us").alias("opened_us"), F.max("last_us").alias("last_us"))
    return span.join(tokens, "keep", "left").join(stages, "keep", "left").withColumnRenamed("keep", "case_id")


def live_shared(pairs: DataFrame, logins: DataFrame, skip: DataFrame) -> DataFrame:
    """Those of ``pairs`` (src, dst: accounts) that still log in from a common device which is no hub."""
    used = logins.join(skip.select(F.col("token").alias("device")), "device", "left_anti").select("account", "device").distinct()
    both = pairs.join(used.withColumnRenamed("account", "src"), "src").join(used.withColumnRenamed("account", "dst"), ["dst", "device"])
    return pairs.join(both.select("src", "dst").distinct(), ["src", "dst"], "left_semi")


def subgraph(edges: DataFrame, starts: DataFrame, hops: int, skip: DataFrame, most: int = 300) -> DataFrame:
    """(start, src, dst, edge_type) to show of each start: nodes within ``hops``, excluded ones shown but not left,
    the nearest ``most`` of each start (ties by token), and the edges between them."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    step = stable(both.join(skip.select(F.col("token").alias("src")), "src", "left_anti"))
    reached = front = stable(starts.select("start", F.col("start").alias("token"), F.lit(0).alias("hops")))
    for hop in range(1, hops + 1):
        front = front.join(step, front["token"] == step["src"]).select("start", F.col("dst").alias("token")).distinct()
        front = stable(front.join(reached.drop("hops"), ["start", "token"], "left_anti").withColumn("hops", F.lit(hop)))
        reached = reached.unionByName(front)
    near = F.row_number().over(Window.partitionBy("start").orderBy("hops", "token"))
    nodes = stable(reached.withColumn("near", near).where(F.col("near") <= most).select("start", "token"))
    ends = [nodes.withColumnRenamed("token", c) for c in ("src", "dst")]
    return edges.select("src", "dst", "edge_type").join(ends[0], "src").join(ends[1], ["start", "dst"]).select("start", "src", "dst", "edge_type")


def proximity(weights: DataFrame, restarts: DataFrame, rounds: int = 20, alpha: float = 0.85) -> DataFrame:
    """(node, score): PageRank that restarts at ``restarts`` (node), over undirected weighted edges (a, b, weight).

    A round is one join and one aggregate; the mass of nodes without an edge goes back to the restarts.
    """
    both = weights.select("a", "b", "weight").unionByName(weights.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    step = stable(both.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("a"))).select("a", "b", "share"))
    home = stable(restarts.select("node").distinct())
    home = home.withColumn("home", F.lit(1.0 / max(1, home.count())))
    score = stable(home.select("node", F.col("home").alias("score")))
    for _ in range(rounds):
        moved = score.join(step, score["node"] == step["a"]).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("in"))
        kept = moved.agg(F.coalesce(F.sum("in"), F.lit(0.0)).alias("m")).first()["m"]
        score = stable(moved.join(home, "node", "full").select("node", (alpha * F.coalesce("in", F.lit(0.0)) + (1 - alpha + alpha * (1 - kept)) * F.coalesce("home", F.lit(0.0))).alias("score")))
    return score


def feedback(verdicts: DataFrame, credited: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What analysts' verdicts change: ((case_id, detector, us, d_alpha, d_beta), (token) new seeds).

    verdicts: case_id, verdict, us, tokens. credited: case_id, detector, contribution, reasons. own: case_id, account
    of the case's customer. A detector is credited for a contribution above a half unless the customer denied it;
    a confirmed case makes seeds of its devices and of accounts that are not its customer's.
    """
    earned = credited.where((F.col("contribution") > 0.5) & ~F.array_contains("reasons", "CUSTOMER_DENIED")).select("case_id", "detector").distinct()
    judged = verdicts.where(F.col("verdict").isin("CONFIRMED_FRAUD", "FALSE_POSITIVE")).join(earned, "case_id")
    steps = judged.select("case_id", "detector", "us", (F.col("verdict") == "CONFIRMED_FRAUD").cast("double").alias("d_alpha"), (F.col("verdict") == "FALSE_POSITIVE").cast("double").alias("d_beta"))
    tokens = verdicts.where("verdict = 'CONFIRMED_FRAUD'").select("case_id", F.explode("tokens").alias("token")).where(kind(F.col("token")).isin("dev", "acct"))
    seeds = tokens.join(own.select("case_id", F.col("account").alias("token")), ["case_id", "token"], "left_anti").select("token").distinct()
    return steps, seeds


def challenges(steps: DataFrame, now: int, ttl: dict[str, int] | None = None, attempts: int = 3, trusted_hours: int = 72) -> DataFrame:
    """(challenge, state, factor_trusted) of step-up challenges at ``now`` from their log (challenge, method, us, action,
    factor_age_h): sent, then answered right or wrong. A right answer in time passes, the last allowed wrong one
    fails, and what is not answered in time is timed out; answers after that count no more."""
    ttl = ttl or {"otp": HOUR // 12, "push": HOUR // 2}
    life = F.element_at(F.create_map(*[F.lit(x) for kv in ttl.items() for x in kv]), F.col("method"))
    sent = steps.where("action = 'sent'").groupBy("challenge").agg(F.min("us").alias("sent_us"), F.min_by(life, "us").alias("life"), F.min_by("factor_age_h", "us").alias("age"))
    tries = steps.where("action in ('right', 'wrong')").join(sent, "challenge").where(F.col("us").between(F.col("sent_us"), F.col("sent_us") + F.col("life")))
    order = Window.partitionBy("challenge").orderBy("us", "action")
    wrong = F.coalesce(F.sum(F.when(F.col("action") == "wrong", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = tries.withColumn("before", wrong).where(F.col("before") < attempts)
    result = counted.groupBy("challenge").agg(F.bool_or(F.col("action") == "right").alias("passed"), F.count_if(F.col("action") == "wrong").alias("wrong"))
    rows = sent.join(result, "challenge", "left")
    state = F.when(F.coalesce("passed", F.lit(False)), "passed").when(F.coalesce("wrong", F.lit(0)) >= attempts, "failed").when(F.col("sent_us") + F.col("life") < now, "timeout").otherwise("pending")
    return rows.select("challenge", state.alias("state"), F.coalesce(F.col("age") >= trusted_hours, F.lit(False)).alias("factor_trusted"))


#: Sentences by stage, and words for some reasons; other codes are read as they are.
SENTENCES = {
    "S0_RECON": "At %s %s was seen [%s].", "S1_INITIAL_ACCESS": "At %s a login succeeded from %s [%s].", "S2_CONTROL_TAKEOVER": "At %s %s [%s].", "S3_IDENTITY_MANIPULATION": "At %s a KYC check returned %s [%s].",
    "S4_ESCALATION": "At %s %s [%s].", "S5_POSITIONING": "At %s a payee was added that %s [%s].", "S6_MONETIZATION": "At %s a transfer was attempted (%s) [%s].",
}
WORDS = {"CREDENTIAL_STUFFING_IP": "credential stuffing against many customers", "IMPOSSIBLE_TRAVEL": "an impossible-travel location", "PUSH_SPAM": "repeated push challenges were rejected or ignored", "PAYEE_NAME_MISMATCH": "does not match the payee's name", "MULE_FLOW": "shows mule-like money flow"}


def joined_words(words: Column) -> Column:
    """a; a and b; a, b and c."""
    n = F.size(words)
    return F.when(n <= 1, F.array_join(words, "")).otherwise(F.concat(F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.try_element_at(words, n)))


def narrative(evidence: DataFrame) -> DataFrame:
    """(case_id, evidence_id, sentence) in Indian time, a sentence for each item."""
    named = F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv])
    words = F.transform("reasons", lambda r: F.coalesce(F.try_element_at(named, r), F.replace(F.lower(r), F.lit("_"), F.lit(" "))))
    at = F.date_format(F.from_utc_timestamp(F.timestamp_micros("us"), "Asia/Kolkata"), "HH:mm")
    out = F.lit(None).cast("string")
    for stage, sentence in SENTENCES.items():
        out = F.when(F.col("stage") == stage, F.format_string(sentence, at, joined_words(words), F.col("evidence_id").cast("string"))).otherwise(out)
    return evidence.select("case_id", "evidence_id", out.alias("sentence"))
