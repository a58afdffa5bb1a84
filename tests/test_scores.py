"""Scores, levels and validation of one legitimate and one fraudulent record."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import fixed, scores
from ledgerlens.operators.validate import record_rules, split_valid, validate
from ledgerlens.plans.scoring import ensemble, from_payload, to_payload

LEGITIMATE = dict(
    receiver_type="Merchant", transaction_type="P2M", payment_app="GPay", device_type="Android",
    usr_age_group="25-34", usr_preferred_app="GPay", usr_preferred_device="Android", mrc_category="Food",
    mrc_size="Medium", amount=250.0, hour_of_day=13, day_of_week=2, is_weekend=0, is_night_transaction=0,
    time_since_last_txn_min=60.0, transaction_velocity=0.10, amount_deviation_score=0.4,
    failed_attempts_last_24h=0.0, recurring_payment_flag=0, transaction_frequency_score=0.45,
    new_device_flag=0, ip_location_mismatch=0, user_city_tier=2, user_avg_monthly_txn=32.0,
    user_avg_txn_value=850.0, user_loyalty_score=0.75, balance_after_transaction=15000.0,
    txn_success_flag=1, kyc_verified_flag=1, usr_home_city_tier=2, usr_account_age_days=730.0,
    usr_linked_bank_count=2.0, usr_avg_monthly_txn_profile=32.0, usr_avg_txn_value_profile=850.0,
    usr_is_high_risk=0, mrc_avg_daily_txn=120.0, mrc_is_registered=1, mrc_rating=4.2,
    device_risk_score=0.05, ip_risk_score=0.03,
)
FRAUD = {**LEGITIMATE, **dict(
    amount=15000.0, hour_of_day=2, is_night_transaction=1, transaction_velocity=0.95,
    amount_deviation_score=5.5, failed_attempts_last_24h=3.0, new_device_flag=1, ip_location_mismatch=1,
    kyc_verified_flag=0, usr_account_age_days=14.0, usr_is_high_risk=1, device_risk_score=0.91, ip_risk_score=0.87,
)}
TYPES = {c: "string" if isinstance(v, str) else "int" if isinstance(v, int) else "double" for c, v in LEGITIMATE.items()}
SCHEMA = ", ".join(f"{c} {t}" for c, t in {**TYPES, "upi_id": "string"}.items())


def frame(spark, *records):
    rows = [tuple({"upi_id": None, **r}[c] for c in [*TYPES, "upi_id"]) for r in records]
    return spark.createDataFrame(rows, SCHEMA)


def test_features_are_forty():
    assert list(LEGITIMATE) == fixed.MODEL_FEATURES and len(LEGITIMATE) == 40


def test_rules_only(spark):
    a, b = ensemble(frame(spark, LEGITIMATE, FRAUD)).select("rules_score", "ensemble_score", "alert_level", "is_fraud", "action").collect()
    assert (a.rules_score, a.ensemble_score, a.alert_level, a.is_fraud) == (0.02, 0.02, "none", False)
    assert (b.rules_score, b.ensemble_score, b.alert_level, b.is_fraud) == (0.98, 0.98, "high", True)
    assert b.action == "block and notify"


def test_new_device_raises_and_night_does_not_lower(spark):
    base, device, night = (
        r.s for r in frame(spark, LEGITIMATE, {**LEGITIMATE, "new_device_flag": 1}, {**LEGITIMATE, "is_night_transaction": 1})
        .select(scores.rules_score().alias("s")).collect()
    )
    assert device > base and night >= base


def test_nulls(spark):
    missing = {**LEGITIMATE, "kyc_verified_flag": None, "amount_deviation_score": None}
    young = {**LEGITIMATE, "usr_account_age_days": 0.0, "amount": 9000.0}
    got = [r.s for r in frame(spark, missing, young).select(scores.rules_score().alias("s")).collect()]
    assert got == [0.17, 0.02]  # unknown KYC counts, an age of 0 is unknown


@pytest.mark.parametrize("score,level", [(0.0, "none"), (0.1999, "none"), (0.20, "low"), (0.40, "medium"), (0.6999, "medium"), (0.70, "high")])
def test_levels(spark, score, level):
    assert spark.range(1).select(scores.alert_level(F.lit(score)).alias("l")).first().l == level


def test_weights_sum_to_one(spark):
    rows = [(0.5, None, None), (0.5, 0.9, None), (0.5, None, 0.1), (0.5, 0.9, 0.1)]
    df = spark.createDataFrame(rows, "rules_score double, tree_score double, light_lr_score double")
    got = df.select("*", *[c.alias(n) for n, c in scores.ensemble_columns().items()]).collect()
    weights = [dict(r.weights_used) for r in got]
    assert weights == [
        {"rules": 1.0}, {"rules": 0.2, "tree": 0.8}, {"rules": 0.375, "light_lr": 0.625},
        {"rules": 0.15, "tree": 0.6, "light_lr": 0.25},
    ]
    assert got[3].ensemble_score == pytest.approx(0.15 * 0.5 + 0.6 * 0.9 + 0.25 * 0.1)
    assert [r.active_scorers for r in got][1] == ["rules", "tree"]


def test_light_score(spark):
    got = frame(spark, FRAUD).select(scores.light_lr_score().alias("s")).first().s
    z = -3.5 + 0.85 * 5.5 + 1.6 + 1.2 + 0.95 * 0.95 + 0.7 * 3
    assert got == pytest.approx(1 / (1 + 2.718281828459045 ** -z))


def reasons(spark, **changes):
    return validate(frame(spark, {**LEGITIMATE, **changes}), record_rules()).first().reasons


def test_valid_records(spark):
    assert reasons(spark) == []
    for good in ["user@oksbi", "first.last@ybl", "test-user@paytm"]:
        assert reasons(spark, upi_id=good) == []
    for empty in ["mrc_rating", "device_risk_score", "ip_risk_score"]:
        assert reasons(spark, **{empty: None}) == []


def test_invalid_records(spark):
    for bad in ["notavpa", "@nopsp", "user@", "a"]:
        assert reasons(spark, upi_id=bad) == ["upi_id: not a payment address"]
    assert reasons(spark, receiver_type="User") == ["mrc_size: person-to-person needs P2P"]
    assert reasons(spark, mrc_size="P2P") == ["mrc_size: P2P needs receiver User"]
    assert len(reasons(spark, amount=-1.0, hour_of_day=24, usr_age_group="26")) == 3
    assert reasons(spark, balance_after_transaction=None) == ["balance_after_transaction: missing or out of range"]


def test_split(spark):
    good, bad = split_valid(frame(spark, LEGITIMATE, {**FRAUD, "amount": 0.0}), record_rules())
    assert good.count() == 1 and bad.first().reasons == ["amount: must be above 0"]


def test_payload_keeps_nulls(spark):
    df = frame(spark, {**LEGITIMATE, "mrc_rating": None})
    packed = df.select(to_payload(df).alias("p"))
    assert '"mrc_rating":null' in packed.first().p
    assert packed.select(from_payload("p", df.schema).alias("r")).select("r.*").collect() == df.collect()


def test_repeated_verdicts_do_not_multiply_the_ledger(spark):
    from ledgerlens.plans.scoring import apply_verdicts

    ledger = spark.createDataFrame([(1, "a", 0.0, False, "none"), (2, "a", 0.0, False, "none")],
                                   "user_id long, txn_id string, fraud_score double, is_fraud boolean, alert_level string")
    verdicts = spark.createDataFrame([(1, "a", 0.3, False, "low"), (1, "a", 0.8, True, "high")], ledger.schema)
    rows = {r.user_id: (r.fraud_score, r.alert_level) for r in apply_verdicts(ledger, verdicts).collect()}
    assert rows == {1: (0.8, "high"), 2: (0.0, "none")} and apply_verdicts(ledger, verdicts).count() == 2


def test_shared_folder_is_demanded_on_a_cluster(monkeypatch):
    import pytest
    from ledgerlens.session import shared_folder

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077", "applicationId": "x"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Fake())
    Fake.conf["spark.checkpoint.dir"] = "file:///shared/"
    assert shared_folder(Fake()) == "file:///shared"
