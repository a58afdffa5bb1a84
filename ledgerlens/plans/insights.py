"""Weekly insight and spending summary."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import fixed
from ledgerlens.functions.times import month_start, since
from ledgerlens.plans.finance import is_spend


def _pct_text(value: Column) -> Column:
    # Whole percent, ties to even, as the tips are worded.
    return F.bround(value, 0).cast("long").cast("string")


def savings_tip(category: Column, pct: Column, change: Column) -> Column:
    tip = F.concat(
        F.lit("Your top spend is "), category, F.lit(" at "), _pct_text(pct), F.lit("% of total.")
    )
    for name, text in fixed.TIPS.items():
        tip = F.when(category == name, text).otherwise(tip)
    spiked = F.concat(F.lit("Spending spiked "), _pct_text(change), F.lit("% this week. "), tip)
    return F.when(change > 20, spiked).otherwise(tip)


def budget_status(change: Column) -> Column:
    up = F.concat(
        F.lit("⚑ Spending up "), _pct_text(change), F.lit("% vs last week — review budget")
    )
    down = F.concat(
        F.lit("✓ Great — spending down "), _pct_text(F.abs(change)), F.lit("% vs last week")
    )
    return (
        F.when(change > 20, up)
        .when(change < -10, down)
        .otherwise("~ On track with last week's pace")
    )


def weekly_insight(ledger: DataFrame, as_of: datetime) -> DataFrame:
    """This week's spend, largest category, fraud alerts and change, with a tip, per user."""
    this, last = as_of - timedelta(days=7), as_of - timedelta(days=14)
    counted = is_spend() & ~F.col("is_fraud")
    in_this, in_last = since("ts", this, as_of), since("ts", last, this)
    by_category = (
        ledger.filter(since("ts", last, as_of))
        .groupBy("user_id", "category")
        .agg(
            F.sum(F.when(counted & in_this, F.col("amount"))).alias("now"),
            F.sum(F.when(counted & in_last, F.col("amount"))).alias("before"),
            F.count_if(F.col("is_fraud") & in_this).alias("alerts"),
        )
    )
    per_user = by_category.groupBy("user_id").agg(
        F.coalesce(F.sum("now"), F.lit(0.0)).alias("__now"),
        F.coalesce(F.sum("before"), F.lit(0.0)).alias("__before"),
        F.max_by(
            F.struct("category", "now"),
            F.when(F.col("now").isNotNull(), F.struct("now", "category")),
        ).alias("__top"),
        F.sum("alerts").alias("fraud_alerts"),
    )
    category = F.coalesce(F.col("__top.category"), F.lit("Uncategorized"))
    pct = F.coalesce(F.try_divide(F.col("__top.now"), F.col("__now")) * 100, F.lit(0.0))
    change = F.coalesce(
        F.try_divide(F.col("__now") - F.col("__before"), F.col("__before")) * 100, F.lit(0.0)
    )
    return per_user.select(
        "user_id",
        F.lit("This week").alias("period"),
        F.round("__now", 2).alias("total_spent"),
        category.alias("top_category"),
        F.round(pct, 1).alias("top_category_pct"),
        "fraud_alerts",
        F.round(change, 4).alias("vs_last_week_pct"),
        savings_tip(category, pct, change).alias("savings_tip"),
        budget_status(change).alias("budget_status"),
    )


def spending_summary(ledger: DataFrame, as_of: datetime, limit: float = 15000.0) -> DataFrame:
    """Month spend (fraud included), largest non-fraud category of the month, all fraud hits."""
    month = since("ts", month_start(as_of)) & is_spend()
    per_user = (
        ledger.groupBy("user_id", "category")
        .agg(
            F.sum(F.when(month, F.col("amount"))).alias("all"),
            F.sum(F.when(month & ~F.col("is_fraud"), F.col("amount"))).alias("clean"),
            F.count_if("is_fraud").alias("hits"),
        )
        .groupBy("user_id")
        .agg(
            F.coalesce(F.sum("all"), F.lit(0.0)).alias("total_spent"),
            F.max_by(
                F.struct("category", "clean"),
                F.when(F.col("clean") > 0, F.struct("clean", "category")),
            ).alias("__top"),
            F.sum("hits").alias("fraud_count"),
        )
    )
    return per_user.select(
        "user_id",
        "total_spent",
        F.coalesce("__top.category", F.lit("Uncategorized")).alias("top_category"),
        F.coalesce("__top.clean", F.lit(0.0)).alias("top_category_spent"),
        "fraud_count",
        (F.col("total_spent") / limit * 100).cast("long").alias("limit_used_pct"),
    )
