"""Personal-finance reports over a ledger keyed by user.

Ledger columns: user_id, txn_id, payee, amount, category, ts, is_fraud, fraud_score.
Each report is one pass with conditional sums and partial aggregation, so a user with
very many rows costs no more than the same rows spread over many users.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import fixed
from ledgerlens.functions.times import (
    at, days_in_month, last_month_start, month_key, month_start, since,
)


def is_spend() -> Column:
    return ~F.col("category").isin(fixed.NON_SPEND)


def clean(ledger: DataFrame) -> DataFrame:
    return ledger.filter(~F.col("is_fraud"))


def spend_filter(ledger: DataFrame, start: datetime, end: datetime | None = None) -> DataFrame:
    """Non-fraud spend in the half-open period."""
    return clean(ledger).filter(since("ts", start, end) & is_spend())


def _sum_when(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("amount"))), F.lit(0.0))


# --- totals ---------------------------------------------------------------------------

def _total_per_user(ledger: DataFrame, inside: Column, users: DataFrame | None) -> DataFrame:
    if users is None:
        return ledger.groupBy("user_id").agg(_sum_when(inside).alias("total"))
    sums = ledger.filter(inside).groupBy("user_id").agg(F.sum("amount").alias("total"))
    return (
        users.select("user_id")
        .join(sums, "user_id", "left")
        .withColumn("total", F.coalesce("total", F.lit(0.0)))
    )


def total_spent_month(
    ledger: DataFrame, as_of: datetime, users: DataFrame | None = None
) -> DataFrame:
    """Spend since the month began, fraud included; users without any show 0.

    With `users` given, only the month is read; without, the ledger says who the users are.
    """
    return _total_per_user(ledger, since("ts", month_start(as_of)) & is_spend(), users)


def total_spend_between(
    ledger: DataFrame, start: datetime, end: datetime | None = None, users: DataFrame | None = None
) -> DataFrame:
    """Non-fraud spend from `start` (to `end`); users without any show 0."""
    inside = since("ts", start, end) & is_spend() & ~F.col("is_fraud")
    return _total_per_user(ledger, inside, users)


def category_spend(
    ledger: DataFrame, start: datetime, end: datetime | None = None, include_income: bool = False
) -> DataFrame:
    rows = clean(ledger).filter(since("ts", start, end))
    if not include_income:
        rows = rows.filter(is_spend())
    return rows.groupBy("user_id", "category").agg(
        F.sum("amount").alias("total"), F.count("*").alias("txn_count")
    )


def monthly_spend(ledger: DataFrame, start: datetime) -> DataFrame:
    return (
        spend_filter(ledger, start)
        .groupBy("user_id", month_key("ts").alias("month"))
        .agg(F.sum("amount").alias("total"), F.count("*").alias("txn_count"))
    )


def monthly_cash_flow(ledger: DataFrame, start: datetime) -> DataFrame:
    return (
        clean(ledger)
        .filter(since("ts", start))
        .groupBy("user_id", month_key("ts").alias("month"))
        .agg(_sum_when(~is_spend()).alias("income"), _sum_when(is_spend()).alias("expense"))
    )


def ledger_stats(ledger: DataFrame, start: datetime) -> DataFrame:
    """Mean and count since `start` (mean null when there are none) and the count of all."""
    inside = since("ts", start)
    return ledger.groupBy("user_id").agg(
        F.avg(F.when(inside, F.col("amount"))).alias("avg_amount"),
        F.count_if(inside).alias("txn_count_since"),
        F.count("*").alias("txn_count"),
    )


def dashboard_stats(ledger: DataFrame, as_of: datetime) -> DataFrame:
    inside = since("ts", month_start(as_of)) & is_spend()
    return ledger.groupBy("user_id").agg(
        _sum_when(inside).alias("total_spent"),
        F.count_if(inside).alias("monthly_txn_count"),
        F.count_if("is_fraud").alias("fraud_count"),
    )


def finance_overview(ledger: DataFrame, as_of: datetime) -> DataFrame:
    """Earnings, spend, net, mean spend per day so far and the largest category."""
    by_category = category_spend(ledger, month_start(as_of), include_income=True)
    spend, earn = F.when(is_spend(), F.col("total")), F.when(~is_spend(), F.col("total"))
    zero = F.lit(0.0)
    return (
        by_category.groupBy("user_id")
        .agg(
            F.coalesce(F.sum(earn), zero).alias("earnings"),
            F.coalesce(F.sum(spend), zero).alias("spend"),
            F.max_by(
                F.when(is_spend(), F.col("category")),
                F.when(is_spend(), F.struct("total", "category")),
            ).alias("top_category"),
        )
        .select(
            "user_id",
            "earnings",
            "spend",
            (F.col("earnings") - F.col("spend")).alias("net"),
            (F.col("spend") / as_of.day).alias("avg_daily"),
            F.coalesce("top_category", F.lit("—")).alias("top_category"),
        )
    )


def category_share(ledger: DataFrame, categories: list[str], limit: float) -> DataFrame:
    """Share of each listed category in all non-fraud amounts, zeros kept, and use of a limit.

    One row per user and listed category; amounts outside the list count in the total only.
    """
    by_user = (
        clean(ledger)
        .groupBy("user_id")
        .agg(
            F.sum("amount").alias("total"),
            *[_sum_when(F.col("category") == c).alias(f"__{i}") for i, c in enumerate(categories)],
        )
    )
    parts = F.array(
        *[
            F.struct(F.lit(c).alias("category"), F.col(f"__{i}").alias("spent"))
            for i, c in enumerate(categories)
        ]
    )
    used = F.least(F.lit(100.0), F.col("total") / limit * 100)
    return (
        by_user.select("user_id", "total", F.inline(parts))
        .select(
            "user_id",
            "category",
            "spent",
            F.when(F.col("total") > 0, F.col("spent") / F.col("total") * 100)
            .otherwise(0.0)
            .alias("pct"),
            used.alias("limit_used"),
            F.when(used > 90, "danger").when(used > 70, "warning").otherwise("success").alias("band"),
        )
    )


# --- this month against the last ------------------------------------------------------

def _two_months(ledger: DataFrame, as_of: datetime, *keys: str) -> DataFrame:
    this, last = month_start(as_of), last_month_start(as_of)
    return (
        spend_filter(ledger, last, as_of)
        .groupBy(*keys)
        .agg(
            _sum_when(since("ts", this, as_of)).alias("this_month"),
            _sum_when(since("ts", last, this)).alias("last_month"),
        )
    )


def _change(df: DataFrame) -> DataFrame:
    delta = F.col("this_month") - F.col("last_month")
    return df.withColumn("delta", delta).withColumn(
        "pct_change",
        F.when(F.col("last_month") > 0, delta / F.col("last_month") * 100).otherwise(0.0),
    )


def month_over_month(ledger: DataFrame, as_of: datetime) -> DataFrame:
    trend = (
        F.when(F.col("last_month") == 0, "NO_DATA")
        .when(F.col("delta") < 0, "DOWN")
        .when(F.col("delta") > 0, "UP")
        .otherwise("FLAT")
    )
    return _change(_two_months(ledger, as_of, "user_id")).withColumn("trend", trend)


def category_mom(ledger: DataFrame, as_of: datetime) -> DataFrame:
    """Every category seen in either month; a missing month counts as 0."""
    return _change(_two_months(ledger, as_of, "user_id", "category"))


def top_category_changes(ledger: DataFrame, as_of: datetime, k: int = 3) -> DataFrame:
    by_change = Window.partitionBy("user_id").orderBy(F.abs("delta").desc(), "category")
    return (
        category_mom(ledger, as_of)
        .filter((F.col("last_month") > 0) | (F.col("this_month") > 0))
        .withColumn("rank", F.row_number().over(by_change))
        .filter(F.col("rank") <= k)
    )


def spending_pace(ledger: DataFrame, as_of: datetime) -> DataFrame:
    """Spend so far projected to the month's end against last month's total."""
    this, last = month_start(as_of), last_month_start(as_of)
    last_total = F.col("last_month")
    status = (
        F.when(last_total == 0, "NO_DATA")
        .when(F.col("projected") <= last_total * 0.90, "ON_TRACK")
        .when(F.col("projected") <= last_total * 1.10, "NEUTRAL")
        .otherwise("OVER_PACE")
    )
    return (
        spend_filter(ledger, last)
        .groupBy("user_id")
        .agg(
            _sum_when(since("ts", this)).alias("spent"),
            _sum_when(since("ts", last, this)).alias("last_month"),
        )
        .withColumn("daily_rate", F.col("spent") / as_of.day)
        .withColumn("projected", F.col("daily_rate") * days_in_month(as_of))
        .select(
            "user_id", "spent", "projected", "daily_rate",
            F.lit(as_of.day).alias("day"), F.lit(days_in_month(as_of)).alias("days"),
            status.alias("status"),
        )
    )


def top_merchants(ledger: DataFrame, start: datetime, n: int = 5) -> DataFrame:
    """Largest payees per user, with the category of the payee's latest transaction."""
    ranked = Window.partitionBy("user_id").orderBy(F.col("total").desc(), "payee")
    return (
        spend_filter(ledger, start)
        .groupBy("user_id", "payee")
        .agg(
            F.sum("amount").alias("total"),
            F.count("*").alias("txn_count"),
            F.max_by("category", F.struct("ts", "txn_id")).alias("category"),
        )
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= n)
    )


# --- budgets and goals ----------------------------------------------------------------

def budget_progress(ledger: DataFrame, budgets: DataFrame, as_of: datetime) -> DataFrame:
    """Spend per category this month against its budget, if it has one."""
    limit = F.col("monthly_limit")
    status = (
        F.when(limit.isNull(), "NONE")
        .when(F.col("total") >= limit, "OVER")
        .when(F.col("total") >= limit * F.lit(0.70).cast("float").cast("double"), "WARNING")
        .otherwise("OK")
    )
    return (
        category_spend(ledger, month_start(as_of))
        .join(budgets.select("user_id", "category", "monthly_limit"), ["user_id", "category"], "left")
        .withColumn("pct_used", F.greatest(F.try_divide(F.col("total"), limit) * 100, F.lit(0.0)))
        .withColumn("pct_used", F.when(limit.isNotNull(), F.col("pct_used")))
        .withColumn("status", status)
    )


def budget_surplus(progress: DataFrame) -> DataFrame:
    """What is left in categories with spend that are under budget, per user."""
    left = F.greatest(F.col("monthly_limit") - F.col("total"), F.lit(0.0))
    counted = F.col("monthly_limit").isNotNull() & (F.col("status") != "OVER")
    return progress.groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(counted, left)), F.lit(0.0)).alias("surplus"),
        F.count_if(F.col("status") == "OVER").alias("over_count"),
    )


def goal_progress(goals: DataFrame, as_of: datetime) -> DataFrame:
    """Share reached, amount left and how close the `deadline` is."""
    target, saved = F.col("target_amount"), F.col("saved_amount")
    pct = F.when(
        target > 0, F.least(F.greatest(saved / target * 100, F.lit(0.0)), F.lit(100.0))
    ).otherwise(0.0)
    day = 24 * 60 * 60 * 1_000_000
    now = F.unix_micros(at(as_of).cast("timestamp"))
    # Whole days, cut toward zero.
    days = ((F.unix_micros(F.col("deadline").cast("timestamp")) - now) / day).cast("int")
    text = (
        F.when(days < 0, F.concat(F.lit("Overdue by "), (-days).cast("string"), F.lit(" days")))
        .when(days == 0, "Due today!")
        .when(days <= 7, F.concat(days.cast("string"), F.lit(" days left")))
        .when(days > 7, F.concat(F.lit("By "), F.date_format("deadline", "d MMM yyyy")))
    )
    return goals.select(
        "*",
        pct.alias("pct_complete"),
        F.greatest(target - saved, F.lit(0.0)).alias("remaining"),
        days.alias("days_left"),
        text.alias("deadline_text"),
    )


def contribute(goals: DataFrame, contributions: DataFrame) -> DataFrame:
    """Add non-negative contributions, capped at the target; a reached goal is completed."""
    added = contributions.groupBy("goal_id").agg(F.sum("amount").alias("__added"))
    total = F.least(F.col("saved_amount") + F.col("__added"), F.col("target_amount"))
    touched = F.col("__added").isNotNull()
    return (
        goals.join(added, "goal_id", "left")
        .withColumn("saved_amount", F.when(touched, total).otherwise(F.col("saved_amount")))
        .withColumn(
            "is_completed",
            F.col("is_completed")
            | (touched & (F.col("saved_amount") >= F.col("target_amount"))),
        )
        .drop("__added")
    )


def surplus_to_goal(goals: DataFrame, surplus: DataFrame) -> DataFrame:
    """Put each user's surplus into the oldest goal that is still active."""
    first = (
        goals.filter(~F.col("is_completed"))
        .groupBy("user_id")
        .agg(F.min_by("goal_id", F.struct("created_at", "goal_id")).alias("goal_id"))
    )
    offered = first.join(surplus.filter(F.col("surplus") > 0), "user_id").select(
        "goal_id", F.col("surplus").alias("amount")
    )
    return contribute(goals, offered)


# --- exports and reports --------------------------------------------------------------

def export_rows(ledger: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Formatted columns of non-fraud rows in a period; order by `ts` descending to list."""
    return clean(ledger).filter(since("ts", start, end)).select(
        "user_id",
        "txn_id",
        "ts",
        F.date_format("ts", "dd MMM yyyy, hh:mm a").alias("date"),
        "payee",
        "category",
        F.format_string("%.2f", "amount").alias("amount"),
        F.format_string("%.4f", "fraud_score").alias("fraud_score"),
        "alert_level",
    )


EXPORT_HEADER = {
    "date": "Date", "payee": "Payee", "category": "Category", "amount": "Amount (INR)",
    "fraud_score": "Fraud Score", "alert_level": "Alert Level",
}


def write_export(rows: DataFrame, path: str, folder_per_user: bool = False) -> None:
    """RFC-4180 CSV, each user's rows together and newest first.

    Files are cut by ranges of (user, time), so a user with very many rows spans several.
    With `folder_per_user`, for few users, each user's files hold the six columns only.
    """
    named = rows.select(
        "user_id", "ts", "txn_id", *[F.col(c).alias(h) for c, h in EXPORT_HEADER.items()]
    )
    order = ["user_id", F.col("ts").desc(), "txn_id"]
    writer = named.repartitionByRange(*order).sortWithinPartitions(*order).drop("ts", "txn_id").write
    if folder_per_user:
        writer = writer.partitionBy("user_id")
    writer.option("header", True).option("escape", '"').mode("errorifexists").csv(path)


def monthly_report(ledger: DataFrame, budgets: DataFrame, as_of: datetime) -> DataFrame:
    """Summary, category (at most 12) and merchant (at most 5) sections in one long frame."""
    start = month_start(as_of)
    progress = budget_progress(ledger, budgets, as_of)
    share = Window.partitionBy("user_id")
    largest = Window.partitionBy("user_id").orderBy(F.col("total").desc(), "category")
    badge = (
        F.when(F.col("status") == "OVER", "OVER")
        .when(F.col("status") == "NONE", "No budget")
        .otherwise(F.concat(F.format_string("%.0f", F.round("pct_used")), F.lit("% used")))
    )
    categories = (
        progress.withColumn("rank", F.row_number().over(largest))
        .withColumn("__all", F.sum("total").over(share))
        .filter(F.col("rank") <= 12)
        .select(
            "user_id",
            F.lit("category").alias("section"),
            "rank",
            F.col("category").alias("label"),
            F.col("total").alias("value"),
            F.coalesce(F.try_divide(F.col("total"), F.col("__all")) * 100, F.lit(0.0)).alias("pct"),
            badge.alias("detail"),
        )
    )
    merchants = top_merchants(ledger, start, 5).select(
        "user_id",
        F.lit("merchant").alias("section"),
        "rank",
        F.col("payee").alias("label"),
        F.col("total").alias("value"),
        F.lit(None).cast("double").alias("pct"),
        F.concat(F.col("txn_count").cast("string"), F.lit(" visits · "), F.col("category")).alias("detail"),
    )
    # One row per user reaches this projection; the four summary lines are unfolded from it.
    totals = spending_pace(ledger, as_of).join(
        month_over_month(ledger, as_of).select("user_id", "pct_change", "trend"), "user_id", "left"
    )
    line = lambda rank, label, value, pct, detail: F.struct(
        F.lit(rank).alias("rank"), F.lit(label).alias("label"), value.alias("value"),
        pct.cast("double").alias("pct"), detail.cast("string").alias("detail"),
    )
    none = F.lit(None)
    summary = totals.select(
        "user_id",
        F.lit("summary").alias("section"),
        F.inline(
            F.array(
                line(1, "Total spent", F.col("spent"), none, none),
                line(2, "Average per day", F.col("daily_rate"), none, none),
                line(3, "Month over month", none.cast("double"), F.col("pct_change"), F.col("trend")),
                line(4, "Projected month-end", F.col("projected"), none, F.col("status")),
            )
        ),
    )
    return summary.unionByName(categories).unionByName(merchants)
