"""Finance reports over the ledger, and what follows from them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerlens.functions import fixed
from ledgerlens.functions.scores import alert_level
from ledgerlens.functions.text import format_inr
from ledgerlens.plans import finance, insights
from ledgerlens.plans.catalog.registry import query, rounded
from ledgerlens.plans.fixtures import LEDGER_AS_OF as AS_OF
from ledgerlens.plans.fixtures import Views

MONTH, LAST = datetime(2001, 7, 1), datetime(2001, 6, 1)
HALF_YEAR = AS_OF - timedelta(days=180)
START, END = datetime(2000, 1, 1), datetime(2001, 1, 1)


def ledger(v: Views):
    return v.ledger


def goals(v: Views):
    """Goals with dates counted from the fixed clock."""
    day = F.make_dt_interval(F.col("due_in_days"))
    clock = F.lit(str(AS_OF)).cast("timestamp_ntz")
    return v.goals.withColumns(
        {
            "deadline": F.when(F.col("due_in_days").isNotNull(), clock + day),
            "created_at": F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(F.col("created_order")),
        }
    ).drop("due_in_days", "created_order")


SPEND = "category NOT IN ('Income', 'Refund')"


@query("total_spent_month", f"""
SELECT u.user_id, round(coalesce(sum(CASE WHEN ts >= TIMESTAMP '2001-07-01' AND {SPEND} THEN amount END), 0.0), 2) AS total
FROM v_users u LEFT JOIN v_ledger l ON u.user_id = l.user_id GROUP BY u.user_id""")
def _(v: Views):
    return rounded(finance.total_spent_month(v.ledger, AS_OF, v.users), 2, "total")


@query("total_spend_between", f"""
SELECT user_id, round(coalesce(sum(CASE WHEN ts >= TIMESTAMP '2000-01-01' AND ts < TIMESTAMP '2001-01-01'
       AND NOT is_fraud AND {SPEND} THEN amount END), 0.0), 2) AS total
FROM v_ledger GROUP BY user_id""")
def _(v: Views):
    return rounded(finance.total_spend_between(v.ledger, START, END), 2, "total")


@query("category_spend", f"""
SELECT user_id, category, round(sum(amount), 2) AS total, count(*) AS txn_count, 'since' AS period
FROM v_ledger WHERE ts >= TIMESTAMP '2001-07-01' AND NOT is_fraud GROUP BY user_id, category
UNION ALL
SELECT user_id, category, round(sum(amount), 2), count(*), 'between'
FROM v_ledger WHERE ts >= TIMESTAMP '2000-01-01' AND ts < TIMESTAMP '2001-01-01' AND NOT is_fraud AND {SPEND}
GROUP BY user_id, category""")
def _(v: Views):
    since = finance.category_spend(v.ledger, MONTH, include_income=True)
    between = finance.category_spend(v.ledger, START, END)
    both = since.withColumn("period", F.lit("since")).unionByName(
        between.withColumn("period", F.lit("between"))
    )
    return rounded(both, 2, "total")


@query("monthly_spend", f"""
SELECT user_id, strftime(ts, '%Y-%m') AS month, round(sum(amount), 2) AS total, count(*) AS txn_count
FROM v_ledger WHERE ts >= TIMESTAMP '2001-01-21' AND NOT is_fraud AND {SPEND} GROUP BY 1, 2""")
def _(v: Views):
    return rounded(finance.monthly_spend(v.ledger, HALF_YEAR), 2, "total")


@query("monthly_cash_flow", f"""
SELECT user_id, strftime(ts, '%Y-%m') AS month,
       round(sum(CASE WHEN {SPEND} THEN 0.0 ELSE amount END), 2) AS income,
       round(sum(CASE WHEN {SPEND} THEN amount ELSE 0.0 END), 2) AS expense
FROM v_ledger WHERE ts >= TIMESTAMP '2001-01-21' AND NOT is_fraud GROUP BY 1, 2""")
def _(v: Views):
    return rounded(finance.monthly_cash_flow(v.ledger, HALF_YEAR), 2, "income", "expense")


@query("ledger_stats", """
SELECT user_id, round(avg(amount) FILTER (WHERE ts >= TIMESTAMP '2000-01-01'), 8) AS avg_amount,
       count(*) FILTER (WHERE ts >= TIMESTAMP '2000-01-01') AS txn_count_since, count(*) AS txn_count
FROM v_ledger GROUP BY user_id""")
def _(v: Views):
    return rounded(finance.ledger_stats(v.ledger, START), 8, "avg_amount")


@query("dashboard_stats", f"""
SELECT user_id, round(coalesce(sum(amount) FILTER (WHERE ts >= TIMESTAMP '2001-07-01' AND {SPEND}), 0.0), 2) AS total_spent,
       count(*) FILTER (WHERE ts >= TIMESTAMP '2001-07-01' AND {SPEND}) AS monthly_txn_count,
       count(*) FILTER (WHERE is_fraud) AS fraud_count
FROM v_ledger GROUP BY user_id""")
def _(v: Views):
    return rounded(finance.dashboard_stats(v.ledger, AS_OF), 2, "total_spent")


@query("finance_overview", f"""
WITH c AS (SELECT user_id, category, sum(amount) AS total FROM v_ledger
           WHERE ts >= TIMESTAMP '2001-07-01' AND NOT is_fraud GROUP BY 1, 2),
t AS (SELECT user_id, category AS top_category FROM c WHERE {SPEND}
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY total DESC, category DESC) = 1),
s AS (SELECT user_id, coalesce(sum(total) FILTER (WHERE NOT ({SPEND})), 0.0) AS earnings,
             coalesce(sum(total) FILTER (WHERE {SPEND}), 0.0) AS spend FROM c GROUP BY 1)
SELECT s.user_id, round(earnings, 2) AS earnings, round(spend, 2) AS spend, round(earnings - spend, 2) AS net,
       round(spend / 20, 8) AS avg_daily, coalesce(top_category, '—') AS top_category
FROM s LEFT JOIN t ON s.user_id = t.user_id""")
def _(v: Views):
    df = rounded(finance.finance_overview(v.ledger, AS_OF), 2, "earnings", "spend", "net")
    return rounded(df, 8, "avg_daily")


SHARE_LIST = ["Food", "Travel", "Shopping", "Utilities", "Uncategorized"]


@query("category_share", """
WITH cats AS (SELECT * FROM (VALUES ('Food'), ('Travel'), ('Shopping'), ('Utilities'), ('Uncategorized')) AS c(category)),
t AS (SELECT user_id, sum(amount) AS total FROM v_ledger WHERE NOT is_fraud GROUP BY 1),
s AS (SELECT user_id, category, sum(amount) AS spent FROM v_ledger WHERE NOT is_fraud GROUP BY 1, 2)
SELECT t.user_id, cats.category, round(coalesce(spent, 0.0), 2) AS spent,
       round(coalesce(spent, 0.0) / total * 100, 8) AS pct, round(least(100.0, total / 3000000.0 * 100), 8) AS limit_used,
       CASE WHEN total / 3000000.0 * 100 > 90 THEN 'danger' WHEN total / 3000000.0 * 100 > 70 THEN 'warning' ELSE 'success' END AS band
FROM t CROSS JOIN cats LEFT JOIN s ON s.user_id = t.user_id AND s.category = cats.category""")
def _(v: Views):
    df = finance.category_share(v.ledger, SHARE_LIST, 3_000_000.0)
    return rounded(rounded(df, 8, "pct", "limit_used"), 2, "spent")


TWO_MONTHS = f"""
    sum(CASE WHEN ts >= TIMESTAMP '2001-07-01' THEN amount ELSE 0.0 END) AS this_month,
    sum(CASE WHEN ts < TIMESTAMP '2001-07-01' THEN amount ELSE 0.0 END) AS last_month
  FROM v_ledger WHERE ts >= TIMESTAMP '2001-06-01' AND ts < TIMESTAMP '2001-07-20' AND NOT is_fraud AND {SPEND}"""
CHANGE = """round(this_month, 2) AS this_month, round(last_month, 2) AS last_month, round(this_month - last_month, 2) AS delta,
       round(CASE WHEN last_month > 0 THEN (this_month - last_month) / last_month * 100 ELSE 0.0 END, 8) AS pct_change"""


def _round_change(df):
    return rounded(rounded(df, 2, "this_month", "last_month", "delta"), 8, "pct_change")


@query("month_over_month", f"""
WITH m AS (SELECT user_id, {TWO_MONTHS} GROUP BY 1)
SELECT user_id, {CHANGE},
       CASE WHEN last_month = 0 THEN 'NO_DATA' WHEN this_month < last_month THEN 'DOWN'
            WHEN this_month > last_month THEN 'UP' ELSE 'FLAT' END AS trend FROM m""")
def _(v: Views):
    return _round_change(finance.month_over_month(v.ledger, AS_OF))


@query("category_mom", f"""
WITH m AS (SELECT user_id, category, {TWO_MONTHS} GROUP BY 1, 2) SELECT user_id, category, {CHANGE} FROM m""")
def _(v: Views):
    return _round_change(finance.category_mom(v.ledger, AS_OF))


@query("top_category_changes", f"""
WITH m AS (SELECT user_id, category, {TWO_MONTHS} GROUP BY 1, 2)
SELECT user_id, category, {CHANGE},
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY abs(this_month - last_month) DESC, category) AS INT) AS rank
FROM m WHERE last_month > 0 OR this_month > 0
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(this_month - last_month) DESC, category) <= 3""")
def _(v: Views):
    return _round_change(finance.top_category_changes(v.ledger, AS_OF))


@query("spending_pace", f"""
WITH m AS (SELECT user_id,
    sum(CASE WHEN ts >= TIMESTAMP '2001-07-01' THEN amount ELSE 0.0 END) AS spent,
    sum(CASE WHEN ts < TIMESTAMP '2001-07-01' THEN amount ELSE 0.0 END) AS last_month
  FROM v_ledger WHERE ts >= TIMESTAMP '2001-06-01' AND NOT is_fraud AND {SPEND} GROUP BY 1),
p AS (SELECT *, spent / 20 AS daily_rate, spent / 20 * 31 AS projected FROM m)
SELECT user_id, round(spent, 2) AS spent, round(projected, 8) AS projected, round(daily_rate, 8) AS daily_rate,
       CAST(20 AS INT) AS day, CAST(31 AS INT) AS days,
       CASE WHEN last_month = 0 THEN 'NO_DATA' WHEN projected <= last_month * 0.9 THEN 'ON_TRACK'
            WHEN projected <= last_month * 1.1 THEN 'NEUTRAL' ELSE 'OVER_PACE' END AS status FROM p""")
def _(v: Views):
    df = rounded(finance.spending_pace(v.ledger, AS_OF), 2, "spent")
    return rounded(df, 8, "projected", "daily_rate")


TOP_MERCHANTS = f"""
SELECT user_id, payee, round(sum(amount), 2) AS total, count(*) AS txn_count,
       arg_max(category, (ts, txn_id)) AS category,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY sum(amount) DESC, payee) AS INT) AS rank
FROM v_ledger WHERE ts >= TIMESTAMP '{{start}}' AND NOT is_fraud AND {SPEND} GROUP BY user_id, payee
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sum(amount) DESC, payee) <= 5"""


@query("top_merchants", TOP_MERCHANTS.format(start="2000-01-01"))
def _(v: Views):
    return rounded(finance.top_merchants(v.ledger, START), 2, "total")


PROGRESS = f"""
s AS (SELECT user_id, category, sum(amount) AS total, count(*) AS txn_count FROM v_ledger
      WHERE ts >= TIMESTAMP '2001-07-01' AND NOT is_fraud AND {SPEND} GROUP BY 1, 2),
p AS (SELECT s.user_id, s.category, total, txn_count, monthly_limit,
             CASE WHEN monthly_limit IS NOT NULL THEN greatest(total / monthly_limit * 100, 0.0) END AS pct_used,
             CASE WHEN monthly_limit IS NULL THEN 'NONE' WHEN total >= monthly_limit THEN 'OVER'
                  WHEN total >= monthly_limit * CAST(CAST(0.70 AS FLOAT) AS DOUBLE) THEN 'WARNING' ELSE 'OK' END AS status
      FROM s LEFT JOIN v_budgets b ON s.user_id = b.user_id AND s.category = b.category)"""


@query("budget_progress", f"""
WITH {PROGRESS}
SELECT user_id, category, round(total, 2) AS total, txn_count, monthly_limit, round(pct_used, 8) AS pct_used, status FROM p""")
def _(v: Views):
    df = rounded(finance.budget_progress(v.ledger, v.budgets, AS_OF), 2, "total")
    return rounded(df, 8, "pct_used")


SURPLUS = """
u AS (SELECT user_id,
        coalesce(sum(CASE WHEN monthly_limit IS NOT NULL AND status <> 'OVER' THEN greatest(monthly_limit - total, 0.0) END), 0.0) AS surplus,
        count(*) FILTER (WHERE status = 'OVER') AS over_count FROM p GROUP BY 1)"""


@query("budget_surplus", f"""
WITH {PROGRESS}, {SURPLUS} SELECT user_id, round(surplus, 2) AS surplus, over_count FROM u""")
def _(v: Views):
    surplus = finance.budget_surplus(finance.budget_progress(v.ledger, v.budgets, AS_OF))
    return rounded(surplus, 2, "surplus")


@query("goal_progress", """
SELECT user_id, goal_id, name, target_amount, round(saved_amount, 2) AS saved_amount,
       CASE WHEN target_amount > 0 THEN round(least(greatest(saved_amount / target_amount * 100, 0.0), 100.0), 8) ELSE 0.0 END AS pct_complete,
       round(greatest(target_amount - saved_amount, 0.0), 2) AS remaining, CAST(due_in_days AS DOUBLE) AS days_left,
       CASE WHEN due_in_days < 0 THEN concat('Overdue by ', -due_in_days, ' days') WHEN due_in_days = 0 THEN 'Due today!'
            WHEN due_in_days <= 7 THEN concat(due_in_days, ' days left')
            WHEN due_in_days > 7 THEN concat('By ', strftime(DATE '2001-07-20' + due_in_days, '%-d %b %Y')) END AS deadline_text
FROM v_goals""")
def _(v: Views):
    df = finance.goal_progress(goals(v), AS_OF).select(
        "user_id", "goal_id", "name", "target_amount", "saved_amount", "pct_complete", "remaining",
        "days_left", "deadline_text",
    )
    df = df.withColumn("days_left", F.col("days_left").cast("double"))
    return rounded(rounded(df, 2, "saved_amount", "remaining"), 8, "pct_complete")


@query("goal_contributions", """
WITH c AS (SELECT user_id * 10 + 1 + txn_id % 2 AS goal_id, sum(amount) / 1e3 AS added FROM v_ledger
           WHERE category = 'Income' GROUP BY 1),
g AS (SELECT g.*, added, CASE WHEN added IS NULL THEN saved_amount ELSE least(saved_amount + added, target_amount) END AS total
      FROM v_goals g LEFT JOIN c ON g.goal_id = c.goal_id)
SELECT user_id, goal_id, target_amount, round(total, 6) AS saved_amount,
       is_completed OR (added IS NOT NULL AND total >= target_amount) AS is_completed,
       CAST(created_order AS INT) AS created_order FROM g""")
def _(v: Views):
    paid = v.ledger.filter(F.col("category") == "Income").select(
        (F.col("user_id") * 10 + 1 + F.col("txn_id") % 2).alias("goal_id"),
        (F.col("amount") / 1e3).alias("amount"),
    )
    df = finance.contribute(v.goals, paid).select(
        "user_id", "goal_id", "target_amount", "saved_amount", "is_completed", "created_order"
    )
    return rounded(df, 6, "saved_amount")


@query("surplus_to_goal", f"""
WITH {PROGRESS}, {SURPLUS},
f AS (SELECT user_id, goal_id FROM v_goals WHERE NOT is_completed
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_order, goal_id) = 1),
o AS (SELECT goal_id, surplus FROM f JOIN u ON f.user_id = u.user_id WHERE surplus > 0),
g AS (SELECT g.*, surplus, CASE WHEN surplus IS NULL THEN saved_amount ELSE least(saved_amount + surplus, target_amount) END AS total
      FROM v_goals g LEFT JOIN o ON g.goal_id = o.goal_id)
SELECT user_id, goal_id, round(total, 2) AS saved_amount,
       is_completed OR (surplus IS NOT NULL AND total >= target_amount) AS is_completed FROM g""")
def _(v: Views):
    surplus = finance.budget_surplus(finance.budget_progress(v.ledger, v.budgets, AS_OF))
    df = finance.surplus_to_goal(goals(v), surplus)
    return rounded(df.select("user_id", "goal_id", "saved_amount", "is_completed"), 2, "saved_amount")


@query("export_rows", """
SELECT user_id, txn_id, strftime(ts, '%d %b %Y, %I:%M %p') AS date, payee, category,
       printf('%.2f', amount) AS amount, printf('%.4f', fraud_score) AS fraud_score,
       CASE WHEN fraud_score >= 0.7 THEN 'high' WHEN fraud_score >= 0.4 THEN 'medium' WHEN fraud_score >= 0.2 THEN 'low' ELSE 'none' END AS alert_level
FROM v_ledger WHERE ts >= TIMESTAMP '2001-07-01' AND ts < TIMESTAMP '2001-07-20' AND NOT is_fraud""")
def _(v: Views):
    levelled = v.ledger.withColumn("alert_level", alert_level("fraud_score"))
    return finance.export_rows(levelled, MONTH, AS_OF).drop("ts")


@query("monthly_report", f"""
WITH {PROGRESS},
m AS (SELECT user_id,
    sum(CASE WHEN ts >= TIMESTAMP '2001-07-01' THEN amount ELSE 0.0 END) AS spent,
    sum(CASE WHEN ts >= TIMESTAMP '2001-07-01' AND ts < TIMESTAMP '2001-07-20' THEN amount ELSE 0.0 END) AS so_far,
    count(*) FILTER (WHERE ts < TIMESTAMP '2001-07-20') AS n,
    sum(CASE WHEN ts < TIMESTAMP '2001-07-01' THEN amount ELSE 0.0 END) AS last_month
  FROM v_ledger WHERE ts >= TIMESTAMP '2001-06-01' AND NOT is_fraud AND {SPEND} GROUP BY 1),
t AS ({TOP_MERCHANTS.format(start="2001-07-01")}),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, category) AS rank,
             sum(total) OVER (PARTITION BY user_id) AS everything FROM p)
SELECT user_id, 'summary' AS section, CAST(1 AS INT) AS rank, 'Total spent' AS label, round(spent, 6) AS value, CAST(NULL AS DOUBLE) AS pct, CAST(NULL AS STRING) AS detail FROM m
UNION ALL SELECT user_id, 'summary', 2, 'Average per day', round(spent / 20, 6), NULL, NULL FROM m
UNION ALL SELECT user_id, 'summary', 3, 'Month over month', NULL,
       CASE WHEN n = 0 THEN NULL ELSE round(CASE WHEN last_month > 0 THEN (so_far - last_month) / last_month * 100 ELSE 0.0 END, 4) END,
       CASE WHEN n = 0 THEN NULL WHEN last_month = 0 THEN 'NO_DATA' WHEN so_far < last_month THEN 'DOWN' WHEN so_far > last_month THEN 'UP' ELSE 'FLAT' END FROM m
UNION ALL SELECT user_id, 'summary', 4, 'Projected month-end', round(spent / 20 * 31, 6), NULL,
       CASE WHEN last_month = 0 THEN 'NO_DATA' WHEN spent / 20 * 31 <= last_month * 0.9 THEN 'ON_TRACK'
            WHEN spent / 20 * 31 <= last_month * 1.1 THEN 'NEUTRAL' ELSE 'OVER_PACE' END FROM m
UNION ALL SELECT user_id, 'category', CAST(rank AS INT), category, round(total, 6), round(total / everything * 100, 4),
       CASE status WHEN 'OVER' THEN 'OVER' WHEN 'NONE' THEN 'No budget' ELSE concat(CAST(round(pct_used) AS INT), '% used') END FROM c WHERE rank <= 12
UNION ALL SELECT user_id, 'merchant', rank, payee, total, NULL, concat(txn_count, ' visits · ', category) FROM t""")
def _(v: Views):
    df = finance.monthly_report(v.ledger, v.budgets, AS_OF)
    return rounded(rounded(df, 6, "value"), 4, "pct")


WEEK = """
c AS (SELECT user_id, category,
        sum(CASE WHEN NOT is_fraud AND category NOT IN ('Income', 'Refund') AND ts >= TIMESTAMP '2001-07-13' THEN amount END) AS cur,
        sum(CASE WHEN NOT is_fraud AND category NOT IN ('Income', 'Refund') AND ts < TIMESTAMP '2001-07-13' THEN amount END) AS prev,
        count(*) FILTER (WHERE is_fraud AND ts >= TIMESTAMP '2001-07-13') AS alerts
      FROM v_ledger WHERE ts >= TIMESTAMP '2001-07-06' AND ts < TIMESTAMP '2001-07-20' GROUP BY 1, 2),
t AS (SELECT user_id, category, cur FROM c WHERE cur IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY cur DESC, category DESC) = 1),
s AS (SELECT user_id, coalesce(sum(cur), 0.0) AS cur, coalesce(sum(prev), 0.0) AS prev, CAST(sum(alerts) AS BIGINT) AS alerts FROM c GROUP BY 1),
w AS (SELECT s.user_id, s.cur, alerts, coalesce(category, 'Uncategorized') AS category,
        CASE WHEN s.cur > 0 THEN coalesce(t.cur, 0.0) / s.cur * 100 ELSE 0.0 END AS pct,
        CASE WHEN prev > 0 THEN (s.cur - prev) / prev * 100 ELSE 0.0 END AS change
      FROM s LEFT JOIN t ON s.user_id = t.user_id)"""
TIP_CASES = " ".join(f"WHEN '{k}' THEN '{text}'" for k, text in fixed.TIPS.items())


@query("weekly_insight", f"""
WITH {WEEK},
x AS (SELECT *, CASE category {TIP_CASES}
        ELSE concat('Your top spend is ', category, ' at ', CAST(round_even(pct, 0) AS BIGINT), '% of total.') END AS tip FROM w)
SELECT user_id, 'This week' AS period, round(cur, 2) AS total_spent, category AS top_category, round(pct, 1) AS top_category_pct,
       alerts AS fraud_alerts, round(change, 4) AS vs_last_week_pct,
       CASE WHEN change > 20 THEN concat('Spending spiked ', CAST(round_even(change, 0) AS BIGINT), '% this week. ', tip) ELSE tip END AS savings_tip,
       CASE WHEN change > 20 THEN concat('⚑ Spending up ', CAST(round_even(change, 0) AS BIGINT), '% vs last week — review budget')
            WHEN change < -10 THEN concat('✓ Great — spending down ', CAST(round_even(abs(change), 0) AS BIGINT), '% vs last week')
            ELSE '~ On track with last week''s pace' END AS budget_status
FROM x""")
def _(v: Views):
    return insights.weekly_insight(v.ledger, AS_OF)


@query("spending_summary", f"""
WITH c AS (SELECT user_id, category, sum(amount) AS total FROM v_ledger
           WHERE ts >= TIMESTAMP '2001-07-01' AND {SPEND} AND NOT is_fraud GROUP BY 1, 2),
t AS (SELECT user_id, category, total FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY total DESC, category DESC) = 1),
s AS (SELECT user_id, coalesce(sum(CASE WHEN ts >= TIMESTAMP '2001-07-01' AND {SPEND} THEN amount END), 0.0) AS spent,
             count(*) FILTER (WHERE is_fraud) AS hits FROM v_ledger GROUP BY 1)
SELECT s.user_id, round(spent, 2) AS total_spent, coalesce(category, 'Uncategorized') AS top_category,
       round(coalesce(total, 0.0), 2) AS top_category_spent, hits AS fraud_count,
       CAST(trunc(spent / 15000.0 * 100) AS BIGINT) AS limit_used_pct
FROM s LEFT JOIN t ON s.user_id = t.user_id""")
def _(v: Views):
    return rounded(insights.spending_summary(v.ledger, AS_OF), 2, "total_spent", "top_category_spent")


@query("format_inr", """
WITH d AS (SELECT txn_id, printf('%.2f', amount) AS t FROM v_ledger),
p AS (SELECT txn_id, split_part(t, '.', 1) AS whole, split_part(t, '.', 2) AS part FROM d),
h AS (SELECT *, left(whole, greatest(length(whole) - 3, 0)) AS head, right(whole, 3) AS tail FROM p)
SELECT txn_id, concat('₹', CASE WHEN length(head) > 2 THEN concat(left(head, length(head) - 2), ',', right(head, 2), ',', tail)
       WHEN length(head) > 0 THEN concat(head, ',', tail) ELSE tail END, '.', part) AS text FROM h""")
def _(v: Views):
    return v.ledger.select("txn_id", format_inr(F.col("amount")).alias("text"))
