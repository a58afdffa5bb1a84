"""Record rules that report every reason, contracts and key audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import fixed
from ledgerlens.functions.text import clean_key

Rules = dict[str, Column]
"""Reason -> condition that must hold; a null condition counts as broken."""


def _within(name: str, low: float | None, high: float | None = None, optional: bool = False) -> Column:
    col = F.col(name)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (col >= low)
    if high is not None:
        ok = ok & (col <= high)
    return col.isNull() | ok if optional else ok & col.isNotNull()


def record_rules() -> Rules:
    """Rules of a scoring record."""
    rules: Rules = {
        f"{name}: not an allowed value": F.col(name).isin(values)
        for name, values in fixed.VOCABULARIES.items()
    }
    rules["mrc_size: person-to-person needs P2P"] = (F.col("receiver_type") != "User") | (
        F.col("mrc_size") == "P2P"
    )
    rules["mrc_size: P2P needs receiver User"] = (F.col("receiver_type") != "Merchant") | (
        F.col("mrc_size") != "P2P"
    )
    rules["upi_id: not a payment address"] = F.col("upi_id").isNull() | F.col("upi_id").rlike(
        fixed.ADDRESS_PATTERN
    )
    for name in ["amount", "user_avg_monthly_txn", "user_avg_txn_value",
                 "usr_avg_monthly_txn_profile", "usr_avg_txn_value_profile"]:
        rules[f"{name}: must be above 0"] = F.col(name) > 0
    ranges = {
        "hour_of_day": (0, 23), "day_of_week": (0, 6), "user_loyalty_score": (0, 1),
        "user_city_tier": (1, 3), "usr_home_city_tier": (1, 3),
        "transaction_velocity": (0, None), "failed_attempts_last_24h": (0, None),
        "transaction_frequency_score": (0, None), "usr_account_age_days": (0, None),
        "usr_linked_bank_count": (1, None), "mrc_avg_daily_txn": (0, None),
        "time_since_last_txn_min": (None, None), "amount_deviation_score": (None, None),
        "balance_after_transaction": (None, None),
    }
    for name in ["is_weekend", "is_night_transaction", "recurring_payment_flag", "new_device_flag",
                 "ip_location_mismatch", "txn_success_flag", "kyc_verified_flag",
                 "usr_is_high_risk", "mrc_is_registered"]:
        ranges[name] = (0, 1)
    for name, (low, high) in ranges.items():
        rules[f"{name}: missing or out of range"] = _within(name, low, high)
    for name, high in {"mrc_rating": 5, "device_risk_score": 1, "ip_risk_score": 1}.items():
        rules[f"{name}: out of range"] = _within(name, 0, high, optional=True)
    return rules


def validate(df: DataFrame, rules: Rules) -> DataFrame:
    """Add `reasons`: every broken rule, empty for a valid record."""
    broken = [
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in rules.items()
    ]
    return df.withColumn("reasons", F.array_compact(F.array(*broken)))


def split_valid(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    checked = validate(df, rules)
    empty = F.size("reasons") == 0
    return checked.filter(empty).drop("reasons"), checked.filter(~empty)


def manual_rules() -> Rules:
    amount = F.col("amount_text").try_cast("double")
    hour = F.coalesce(F.trim("hour_text").try_cast("int"), F.lit(12))
    return {
        "payee and amount are needed": (clean_key("payee") != "") & (F.trim("amount_text") != ""),
        "amount must be above 0": amount > 0,
        "hour must be 0 to 23": hour.between(0, 23),
    }


def manual_entries(entries: DataFrame) -> DataFrame:
    """Typed-in transactions as message rows; entries that break a rule are left out.

    Columns: payee, amount_text, hour_text, app, ts. An unreadable hour becomes 12.
    """
    valid, _ = split_valid(entries, manual_rules())
    amount = F.col("amount_text").try_cast("double")
    payee = F.regexp_replace("payee", r"^\s+|\s+$", "")
    millis = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("string")
    return valid.withColumns(
        {
            "sender": F.concat(F.lit("AD-"), F.upper("app")),
            "amount": amount,
            "payee": payee,
            "txn_id": F.concat(F.lit("TXN"), millis),
            "date": F.date_format("ts", "dd-MMM-yy"),
            "hour_of_day": F.coalesce(F.trim("hour_text").try_cast("int"), F.lit(12)),
            "body": F.concat(
                F.lit("Manually entered transaction of ₹"), amount.cast("string"),
                F.lit(" to "), payee, F.lit(" via "), F.col("app"),
            ),
        }
    ).drop("amount_text", "hour_text")


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def check_contract(df: DataFrame, rules: Rules) -> DataFrame:
    """One row per rule with the number of rows that break it, from a single pass."""
    reasons = list(rules)
    counts = df.agg(
        *[F.count_if(~F.coalesce(rules[r], F.lit(False))).alias(f"__{i}") for i, r in enumerate(reasons)]
    )
    lines = [
        F.struct(F.lit(r).alias("rule"), F.col(f"__{i}").alias("violations"))
        for i, r in enumerate(reasons)
    ]
    return counts.select(F.inline(F.array(*lines)))


def binary_target(name: str) -> Rules:
    return {f"{name} is 0 or 1": F.col(name).isin(0, 1)}


def audit_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys of a dimension that occur more than once; a join on them would add rows."""
    return (
        df.groupBy(F.col(key).cast("string").alias("key"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > 1)
    )
