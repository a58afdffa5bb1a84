"""Edges of the finance reports on a small hand-made ledger."""

import csv
import glob
from datetime import datetime

from pyspark.sql import functions as F

from ledgerlens.operators.state import apply_corrections, current_state, latest_per_key
from ledgerlens.operators.validate import audit_keys, check_contract, manual_entries, missing_columns
from ledgerlens.plans import finance, insights
from ledgerlens.plans.scoring import apply_verdicts
from ledgerlens.sources.evolving import scratch_folder

AS_OF = datetime(2025, 4, 20)
SCHEMA = "txn_id long, user_id long, ts timestamp_ntz, payee string, category string, amount double, is_fraud boolean, fraud_score double, alert_level string"


def ledger(spark, *rows):
    """(user, day text, category, amount[, fraud[, payee]])"""
    full = []
    for i, (u, day, cat, amount, *rest) in enumerate(rows):
        fraud = rest[0] if rest else False
        full.append((i, u, datetime.fromisoformat(day), rest[1] if len(rest) > 1 else f"P{i}", cat, amount, fraud, 0.5, "low"))
    return spark.createDataFrame(full, SCHEMA)


def one(df, user=1):
    return df.filter(F.col("user_id") == user).first()


def test_month_edges_are_half_open(spark):
    df = ledger(spark, (1, "2025-04-01", "Food", 10.0), (1, "2025-03-31 23:59:59", "Food", 5.0), (1, "2025-04-20", "Food", 100.0), (1, "2025-03-01", "Food", 1.0))
    r = one(finance.month_over_month(df, AS_OF))
    assert (r.this_month, r.last_month, r.trend) == (10.0, 6.0, "UP")
    assert one(finance.total_spent_month(df, AS_OF)).total == 110.0


def test_fraud_counts_in_one_total_only(spark):
    df = ledger(spark, (1, "2025-04-02", "Food", 10.0), (1, "2025-04-03", "Food", 7.0, True), (1, "2025-04-03", "Income", 50.0), (2, "2024-01-01", "Food", 1.0))
    assert one(finance.total_spent_month(df, AS_OF)).total == 17.0
    assert one(finance.total_spend_between(df, datetime(2025, 4, 1))).total == 10.0
    assert one(finance.total_spend_between(df, datetime(2025, 4, 1)), 2).total == 0.0
    r = one(finance.finance_overview(df, AS_OF))
    assert (r.earnings, r.spend, r.net, r.avg_daily, r.top_category) == (50.0, 10.0, 40.0, 0.5, "Food")


def test_trends_without_a_base(spark):
    df = ledger(spark, (1, "2025-04-02", "Food", 10.0), (2, "2025-03-02", "Food", 10.0), (3, "2025-04-02", "Food", 5.0), (3, "2025-03-02", "Food", 5.0))
    got = {r.user_id: (r.trend, r.pct_change) for r in finance.month_over_month(df, AS_OF).collect()}
    assert got == {1: ("NO_DATA", 0.0), 2: ("DOWN", -100.0), 3: ("FLAT", 0.0)}
    assert {r.user_id: r.status for r in finance.spending_pace(df, AS_OF).collect()} == {1: "NO_DATA", 2: "ON_TRACK", 3: "OVER_PACE"}


def test_budget_status(spark):
    rows = [("A", 100.0), ("B", 70.0), ("C", 69.0), ("D", 5.0)]
    df = ledger(spark, *[(1, "2025-04-02", c, a) for c, a in rows])
    budgets = spark.createDataFrame([(1, c, 100.0) for c in "ABCE"], "user_id long, category string, monthly_limit double")
    progress = finance.budget_progress(df, budgets, AS_OF)
    # 0.70 in single precision is a little below 0.7.
    assert {r.category: r.status for r in progress.collect()} == {"A": "OVER", "B": "WARNING", "C": "OK", "D": "NONE"}
    r = finance.budget_surplus(progress).first()
    assert (r.surplus, r.over_count) == (61.0, 1)


def test_top_merchants_take_the_latest_category(spark):
    df = ledger(spark, (1, "2025-04-02", "Food", 10.0, False, "X"), (1, "2025-04-05", "Travel", 1.0, False, "X"), *[(1, "2025-04-03", "Food", float(i), False, f"M{i}") for i in range(1, 8)])
    got = finance.top_merchants(df, datetime(2025, 4, 1), 3).orderBy("rank").collect()
    assert [(r.payee, r.total, r.category) for r in got] == [("X", 11.0, "Travel"), ("M7", 7.0, "Food"), ("M6", 6.0, "Food")]


def test_goals(spark):
    schema = "user_id long, goal_id long, target_amount double, saved_amount double, is_completed boolean, deadline timestamp_ntz, created_at timestamp_ntz"
    d = lambda day: datetime(2025, 4, day)
    rows = [(1, 1, 100.0, 90.0, False, d(19), d(2)), (1, 2, 100.0, 0.0, False, datetime(2025, 4, 20, 23), d(1)), (2, 3, 0.0, 50.0, False, d(25), d(1)), (2, 4, 100.0, 300.0, True, datetime(2025, 6, 1), d(1)), (2, 5, 10.0, 0.0, False, None, d(3))]
    goals = spark.createDataFrame(rows, schema)
    got = {r.goal_id: (r.pct_complete, r.remaining, r.deadline_text) for r in finance.goal_progress(goals, AS_OF).collect()}
    assert got == {1: (90.0, 10.0, "Overdue by 1 days"), 2: (0.0, 100.0, "Due today!"), 3: (0.0, 0.0, "5 days left"), 4: (100.0, 0.0, "By 1 Jun 2025"), 5: (0.0, 10.0, None)}
    paid = spark.createDataFrame([(1, 5.0), (1, 50.0), (5, 3.0)], "goal_id long, amount double")
    got = {r.goal_id: (r.saved_amount, r.is_completed) for r in finance.contribute(goals, paid).collect()}
    assert got == {1: (100.0, True), 2: (0.0, False), 3: (50.0, False), 4: (300.0, True), 5: (3.0, False)}
    surplus = spark.createDataFrame([(1, 40.0), (2, 0.0)], "user_id long, surplus double")
    got = {r.goal_id: r.saved_amount for r in finance.surplus_to_goal(goals, surplus).collect()}
    assert got == {1: 90.0, 2: 40.0, 3: 50.0, 4: 300.0, 5: 0.0}


def test_weekly_texts(spark):
    df = ledger(spark, (1, "2025-04-14", "Food", 130.0), (1, "2025-04-10", "Food", 100.0), (2, "2025-04-15", "Rent", 80.0), (2, "2025-04-15", "Rent", 1.0, True), (2, "2025-04-08", "Rent", 100.0), (3, "2025-04-15", "Travel", 5.0))
    got = {r.user_id: r for r in insights.weekly_insight(df, AS_OF).collect()}
    assert got[1].savings_tip.startswith("Spending spiked 30% this week. Try cooking") and got[1].budget_status.startswith("⚑ Spending up 30%")
    assert got[2].savings_tip == "Your top spend is Rent at 100% of total." and "down 20%" in got[2].budget_status and got[2].fraud_alerts == 1
    assert got[3].vs_last_week_pct == 0.0 and got[3].budget_status.startswith("~")


def test_summary_without_spend(spark):
    r = insights.spending_summary(ledger(spark, (1, "2025-04-02", "Income", 10.0, True)), AS_OF).first()
    assert (r.total_spent, r.top_category, r.fraud_count, r.limit_used_pct) == (0.0, "Uncategorized", 1, 0)


def test_report_sections(spark):
    df = ledger(spark, *[(1, "2025-04-02", f"C{i:02d}", 1.0 + i, False, f"M{i}") for i in range(15)])
    budgets = spark.createDataFrame([], "user_id long, category string, monthly_limit double")
    got = finance.monthly_report(df, budgets, AS_OF).groupBy("section").count().collect()
    assert {r.section: r["count"] for r in got} == {"summary": 4, "category": 12, "merchant": 5}


def test_export_quotes_and_order(spark):
    df = ledger(spark, (1, "2025-04-02 15:04:00", "Food", 1234.5, False, 'A "B", C'), (1, "2025-04-03", "Food", 2.0), (1, "2025-04-03", "Food", 3.0, True))
    folder = scratch_folder(spark, "export")
    finance.write_export(finance.export_rows(df, datetime(2025, 4, 1), AS_OF), folder, folder_per_user=True)
    text = [r for f in sorted(glob.glob(f"{folder}/user_id=1/*.csv")) for r in csv.reader(open(f, newline=""))]
    assert [r for i, r in enumerate(text) if i == 0 or r[0] != "Date"] == [
        ["Date", "Payee", "Category", "Amount (INR)", "Fraud Score", "Alert Level"],
        ["03 Apr 2025, 12:00 AM", "P1", "Food", "2.00", "0.5000", "low"],
        ["02 Apr 2025, 03:04 PM", 'A "B", C', "Food", "1234.50", "0.5000", "low"],
    ]


def test_filters_reach_the_scan(views):
    df = finance.month_over_month(views.ledger, AS_OF)
    plan = views.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThan(o_orderdate" in pushed
    read = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    assert "o_orderstatus" not in read


def test_state(spark):
    log = spark.createDataFrame([("a", 1, "upsert", "x"), ("a", 3, "delete", None), ("b", 2, "upsert", "y"), ("b", 5, "upsert", "z"), ("a", 2, "upsert", "w")], "k string, seq long, op string, v string")
    assert {r.k: r.v for r in latest_per_key(log, ["k"], ["seq"]).collect()} == {"a": None, "b": "z"}
    assert [(r.k, r.v) for r in current_state(log, ["k"]).collect()] == [("b", "z")]
    plan = latest_per_key(log, ["k"], ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_corrections_and_verdicts(spark):
    df = ledger(spark, (1, "2025-04-02", "Food", 1.0), (1, "2025-04-02", "Food", 2.0))
    log = spark.createDataFrame([], "payee_name string, category string, source string, confidence double, seq long, op string")
    fix = spark.createDataFrame([(0, " Dad ", "Family", 1), (0, " Dad ", "Rent", 2)], "txn_id long, payee string, category string, seq long")
    rows, new_log = apply_corrections(df, log, fix)
    assert {r.txn_id: r.category for r in rows.collect()} == {0: "Rent", 1: "Food"}
    assert [(r.payee_name, r.category, r.source) for r in current_state(new_log, ["payee_name"]).collect()] == [("dad", "Rent", "user")]
    verdicts = spark.createDataFrame([(1, 0.9, True, "high")], "txn_id long, fraud_score double, is_fraud boolean, alert_level string")
    assert {r.txn_id: (r.fraud_score, r.is_fraud, r.alert_level) for r in apply_verdicts(df, verdicts).collect()} == {0: (0.5, False, "low"), 1: (0.9, True, "high")}


def test_contracts(spark):
    df = spark.createDataFrame([(1, 0), (1, 2), (2, None)], "k int, y int")
    assert missing_columns(df, ["k", "z"]) == ["z"]
    assert check_contract(df, {"binary": F.col("y").isin(0, 1)}).first().violations == 2
    assert [(r.key, r.n) for r in audit_keys(df, "k").collect()] == [("1", 2)]


def test_manual_entries(spark):
    rows = [(" Dad ", "12.5", "", "GPay", AS_OF), ("", "1", "3", "GPay", AS_OF), ("X", "0", "3", "GPay", AS_OF), ("X", "1", "24", "GPay", AS_OF), ("X", "abc", "3", "GPay", AS_OF)]
    got = manual_entries(spark.createDataFrame(rows, "payee string, amount_text string, hour_text string, app string, ts timestamp_ntz")).collect()
    assert [(r.payee, r.amount, r.hour_of_day, r.sender, r.date) for r in got] == [("Dad", 12.5, 12, "AD-GPAY", "20-Apr-25")]
