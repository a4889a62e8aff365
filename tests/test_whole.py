"""Roles that events have in queries hold for every event, whatever its number in props."""

from tarnwell.plans import queries as plans


def table_of(spark, path, rows):
    """(event_id, time, user_id, event_type, k) as an events table."""
    df = spark.createDataFrame([(i, at, u, kind, 1.0, f'{{"k": {k}}}') for i, at, u, kind, k in rows], "event_id long, at string, user_id long, event_type string, value double, props string")
    df.selectExpr("event_id", "cast(at as timestamp_ntz) ts", "user_id", "event_type", "value", "props").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_roles_hold_for_every_k(spark, tmp_path):
    path = table_of(spark, tmp_path, [
        (1, "2024-01-02 00:00:00", 1, "purchase", 3), (2, "2024-01-02 01:00:00", 2, "purchase", 3), (3, "2024-01-02 02:00:00", 3, "purchase", 7),
        (4, "2024-01-02 03:00:00", 1, "signup", 30), (5, "2034-01-02 00:00:00", 3, "purchase", 77),
    ])
    found = lambda name: sorted(r["customer"] for r in plans.queries()[name](spark, path).collect())
    assert found("j7_shared_token_cases") == ["cust:1", "cust:2"]  # ip:3 alone
    assert found("u_new_customers") == ["cust:2", "cust:3"]
    assert [(r["customer"], r["n"], r["status"]) for r in plans.queries()["j5_snk5_baseline_diff"](spark, path).collect()] == [("cust:3", 2, "changed")]
    # a case's number is its customer's, then that of its days
    labelled = {(f"cust:{int(r['case_id'][5:]) // 100_000}", r["label"]) for r in plans.queries()["j1_labelled_evidence"](spark, path).select("case_id", "label").collect()}
    assert labelled == {("cust:1", "LEGIT"), ("cust:1", "FRAUD"), ("cust:2", "LEGIT"), ("cust:3", "LEGIT")}
