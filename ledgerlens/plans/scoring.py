"""The scoring record and the batch scoring flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import fixed
from ledgerlens.functions.scores import (
    alert_action, alert_level, ensemble_columns, light_lr_score, rules_score,
)
from ledgerlens.functions.text import payment_app
from ledgerlens.functions.times import calendar_columns
from ledgerlens.operators.baseline import with_baseline
from ledgerlens.operators.state import latest_per_key
from ledgerlens.operators.validate import Rules, validate

# What the record holds where the live client knows nothing better.
REQUEST_DEFAULTS = {
    "device_type": "Android", "usr_age_group": "25-34", "usr_preferred_device": "Android",
    "time_since_last_txn_min": 60.0, "transaction_velocity": 0.1,
    "failed_attempts_last_24h": 0.0, "recurring_payment_flag": 0,
    "new_device_flag": 0, "ip_location_mismatch": 0,
    "user_city_tier": 2, "user_avg_monthly_txn": 30.0, "user_loyalty_score": 0.6,
    "balance_after_transaction": 10000.0, "txn_success_flag": 1, "kyc_verified_flag": 1,
    "usr_home_city_tier": 2, "usr_account_age_days": 365.0, "usr_linked_bank_count": 1.0,
    "usr_is_high_risk": 0, "mrc_is_registered": 1,
}
MERCHANT_SIZE, MERCHANT_DAILY, MERCHANT_RATING = "Medium", 50.0, 4.0
NEW_DEVICE_RISK, IP_MISMATCH_RISK = 0.9, 0.95


def request_features(df: DataFrame) -> DataFrame:
    """Add the 40 model columns to rows that carry payee, sender, amount, ts, category and
    the baseline columns of `with_baseline`. Columns already present are kept where they
    are not null; the rest come from the payee, the baseline and the defaults."""
    present = set(df.columns)

    def known(name: str, otherwise: Column) -> Column:
        return F.coalesce(F.col(name), otherwise) if name in present else otherwise

    is_address = F.coalesce(F.col("payee").contains("@"), F.lit(False))
    app = payment_app("sender") if "sender" in present else F.lit("GPay")
    own_mean = F.when(F.col("is_cold_start"), F.col("amount")).otherwise(F.col("mean"))
    first = {
        "receiver_type": F.when(is_address, "Merchant").otherwise("User"),
        "payment_app": app,
        "usr_preferred_app": app,
        **calendar_columns("ts"),
        "amount_deviation_score": F.col("z_amount"),
        "transaction_frequency_score": F.col("z_hour"),
        "user_avg_txn_value": own_mean,
        "usr_avg_monthly_txn_profile": own_mean,
        "usr_avg_txn_value_profile": own_mean,
        **{name: F.lit(value) for name, value in REQUEST_DEFAULTS.items()},
    }
    base = df.withColumns({name: known(name, value) for name, value in first.items()})
    person = F.col("receiver_type") == "User"
    second = {
        "transaction_type": F.when(person, "P2P").otherwise("P2M"),
        "mrc_category": F.when(person, "P2P Transfer").otherwise(F.col("category")),
        "mrc_size": F.when(person, "P2P").otherwise(MERCHANT_SIZE),
        "mrc_avg_daily_txn": F.when(person, 0.0).otherwise(MERCHANT_DAILY),
        "mrc_rating": F.when(~person, MERCHANT_RATING),
        "device_risk_score": F.when(F.col("new_device_flag") == 1, NEW_DEVICE_RISK),
        "ip_risk_score": F.when(F.col("ip_location_mismatch") == 1, IP_MISMATCH_RISK),
    }
    return base.withColumns({name: known(name, value) for name, value in second.items()})


def ensemble(
    df: DataFrame, threshold: float = 0.5, tree_score: str | None = None, light_trained: bool = False
) -> DataFrame:
    """Add the scorers, their weighted mean, the verdict, the alert level and its action.

    The logistic score is always a column, but it carries weight only when its
    coefficients were trained.
    """
    tree = F.col(tree_score) if tree_score else F.lit(None).cast("double")
    scored = df.withColumns(
        {"rules_score": rules_score(), "light_lr_score": light_lr_score(), "tree_score": tree}
    ).withColumn(
        "__light", F.col("light_lr_score") if light_trained else F.lit(None).cast("double")
    )
    columns = ensemble_columns(
        threshold, {"rules": "rules_score", "tree": "tree_score", "light_lr": "__light"}
    )
    level = alert_level("ensemble_score")
    return (
        scored.withColumns(columns)
        .withColumns({"alert_level": level, "action": alert_action(level)})
        .drop("__light")
    )


def score_batch(
    txn: DataFrame,
    rules: Rules | None = None,
    threshold: float = 0.5,
    tree_score: str | None = None,
    light_trained: bool = False,
) -> DataFrame:
    """Measure each user's own baseline, build the record, validate it, score, set the alert.

    Rows that break a rule keep their reasons and get no score.
    """
    record = request_features(with_baseline(txn))
    checked = validate(record, rules or {"amount must be above 0": F.col("amount") > 0})
    scored = ensemble(checked, threshold, tree_score, light_trained)
    valid = F.size("reasons") == 0
    outputs = ["rules_score", "light_lr_score", "ensemble_score", "is_fraud", "alert_level", "action"]
    return scored.withColumns({c: F.when(valid, F.col(c)) for c in outputs})


def apply_verdicts(ledger: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Write score, verdict and level back by user, where both sides name one, and transaction id.

    Of several verdicts for one transaction the highest score counts; the rest is unchanged.
    """
    names = ["fraud_score", "is_fraud", "alert_level"]
    keys = [k for k in ("user_id", "txn_id") if k in ledger.columns and k in verdicts.columns]
    one = latest_per_key(verdicts.select(*keys, *names), keys, names)
    new = one.select(*keys, *[F.col(c).alias(f"__{c}") for c in names])
    return (
        ledger.join(new, keys, "left")
        .withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in names})
        .drop(*[f"__{c}" for c in names])
    )


def to_payload(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A record as JSON text, nulls written out."""
    return F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"})


def from_payload(payload: str, schema) -> Column:
    return F.from_json(payload, schema)
