"""Baselines, features and scores over event transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import fixed
from ledgerlens.functions.scores import (
    alert_action, alert_level, fallback_score, light_lr_score, offline_verdict, rules_score,
)
from ledgerlens.functions.times import calendar_columns
from ledgerlens.operators.baseline import with_baseline, with_velocity
from ledgerlens.operators.validate import record_rules, validate
from ledgerlens.plans import scoring
from ledgerlens.plans.catalog.registry import query, r, rounded
from ledgerlens.plans.fixtures import Views

TRAIL = "RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"
BASE_SQL = f"""
b AS (SELECT *, count(amount) OVER w AS n, avg(amount) OVER w AS m, stddev_pop(amount) OVER w AS s,
             count(hour_of_day) OVER w AS hn, avg(hour_of_day) OVER w AS hm, stddev_pop(hour_of_day) OVER w AS hs
      FROM v_event_txn WINDOW w AS (PARTITION BY user_id ORDER BY ts {TRAIL})),
z AS (SELECT *, n < 5 AS is_cold_start,
             CASE WHEN n < 5 THEN 0.0 ELSE m END AS mean, CASE WHEN n < 5 THEN 1.0 ELSE greatest(s, 1.0) END AS std,
             CASE WHEN n < 5 OR hn < 5 THEN 12.0 ELSE hm END AS mean_hour,
             CASE WHEN n < 5 OR hn < 5 THEN 6.0 ELSE greatest(hs, 0.5) END AS std_hour FROM b),
y AS (SELECT *, CASE WHEN is_cold_start THEN 0.0 ELSE (amount - mean) / std END AS z_amount,
             CASE WHEN is_cold_start THEN 0.0 ELSE abs(hour_of_day - mean_hour) / std_hour END AS z_hour FROM z)"""


@query("amount_zscore", f"""
WITH {BASE_SQL}
SELECT txn_id, user_id, n, is_cold_start, round(mean, 8) AS mean, round(std, 8) AS std, round(z_amount, 8) AS z_amount FROM y""")
def _(v: Views):
    df = with_baseline(v.event_txn)
    return df.select("txn_id", "user_id", "n", "is_cold_start", *[r(c, 8).alias(c) for c in ("mean", "std", "z_amount")])


@query("hour_zscore", f"""
WITH {BASE_SQL}
SELECT txn_id, user_id, n, round(mean_hour, 8) AS mean_hour, round(std_hour, 8) AS std_hour, round(z_hour, 8) AS z_hour FROM y""")
def _(v: Views):
    df = with_baseline(v.event_txn)
    return df.select("txn_id", "user_id", "n", *[r(c, 8).alias(c) for c in ("mean_hour", "std_hour", "z_hour")])


VELOCITY_SQL = """
a AS (SELECT txn_id, user_id, ts, failed, event_type AS payee, CAST(k AS DOUBLE) AS bill FROM v_event_txn),
q AS (SELECT *, date_diff('microsecond', lag(ts) OVER u, ts) / 60e6 AS gap,
        count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS velocity,
        coalesce(sum(failed) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0) AS failures,
        count(*) OVER (PARTITION BY user_id, payee, bill ORDER BY ts RANGE BETWEEN INTERVAL 35 DAYS PRECEDING AND INTERVAL '25 days 1 microsecond' PRECEDING) AS repeats
      FROM a WINDOW u AS (PARTITION BY user_id ORDER BY ts))"""


@query("velocity_features", f"""
WITH {VELOCITY_SQL}
SELECT txn_id, round(gap, 8) AS time_since_last_txn_min, velocity AS transaction_velocity,
       CAST(failures AS BIGINT) AS failed_attempts_last_24h, CAST(repeats > 0 AS INT) AS recurring_payment_flag FROM q""")
def _(v: Views):
    named = v.event_txn.select(
        "txn_id", "user_id", "ts", "failed", F.col("event_type").alias("payee"), F.col("k").cast("double").alias("bill")
    )
    return with_velocity(named, amount="bill").select(
        "txn_id",
        r("time_since_last_txn_min", 8).alias("time_since_last_txn_min"),
        "transaction_velocity",
        "failed_attempts_last_24h",
        "recurring_payment_flag",
    )


def record(v: Views) -> DataFrame:
    """Event transactions with the fields a record takes from elsewhere, without windows."""
    return v.event_txn.withColumns(
        {
            "amount_deviation_score": (F.col("amount") - 100) / 50,
            "is_night_transaction": ((F.col("hour_of_day") < 6) | (F.col("hour_of_day") >= 22)).cast("int"),
            "usr_is_high_risk": (F.col("user_id") % 11 == 0).cast("int"),
            "usr_account_age_days": (F.col("user_id") * 37 % 2000).cast("double"),
            "failed_attempts_last_24h": (F.col("k") % 5).cast("double"),
            "transaction_velocity": F.col("k") / 100.0,
            "amount": F.col("amount") * 40,
        }
    )


RECORD_SQL = """
rec AS (SELECT txn_id, user_id, ts, k, hour_of_day, event_type, new_device_flag, ip_location_mismatch, kyc_verified_flag, is_fraud,
       (amount - 100) / 50 AS dev, CAST(hour_of_day < 6 OR hour_of_day >= 22 AS INT) AS night,
       CAST(user_id % 11 = 0 AS INT) AS high, CAST(user_id * 37 % 2000 AS DOUBLE) AS age,
       CAST(k % 5 AS DOUBLE) AS failures, k / 100.0e0 AS velocity, amount * 40 AS amount FROM v_event_txn)"""
RULES_SQL = """least(round(0.02e0 + CASE WHEN new_device_flag = 1 THEN 0.35e0 ELSE 0 END + CASE WHEN ip_location_mismatch = 1 THEN 0.2e0 ELSE 0 END
       + CASE WHEN kyc_verified_flag = 0 THEN 0.15e0 ELSE 0 END + CASE WHEN high = 1 THEN 0.12e0 ELSE 0 END
       + CASE WHEN dev > 4 THEN 0.2e0 WHEN dev > 2 THEN 0.1e0 WHEN dev > 1 THEN 0.03e0 ELSE 0 END
       + CASE WHEN night = 1 THEN 0.05e0 ELSE 0 END + CASE WHEN failures > 2 THEN 0.08e0 ELSE 0 END
       + CASE WHEN (CASE WHEN age = 0 THEN 999 ELSE age END) < 30 AND amount > 5000 THEN 0.08e0 ELSE 0 END, 4), 0.98e0)"""
LIGHT_SQL = "1 / (1 + exp(-(-3.5e0 + dev * 0.85e0 + new_device_flag * 1.6e0 + ip_location_mismatch * 1.2e0 + velocity * 0.95e0 + failures * 0.7e0)))"


@query("rules_score", f"WITH {RECORD_SQL} SELECT txn_id, {RULES_SQL} AS rules_score FROM rec")
def _(v: Views):
    return record(v).select("txn_id", rules_score().alias("rules_score"))


@query("light_lr_score", f"WITH {RECORD_SQL} SELECT txn_id, round({LIGHT_SQL}, 8) AS light_lr_score FROM rec")
def _(v: Views):
    return record(v).select("txn_id", r(light_lr_score(), 8).alias("light_lr_score"))


LEVEL_SQL = "CASE WHEN {s} >= 0.7 THEN 'high' WHEN {s} >= 0.4 THEN 'medium' WHEN {s} >= 0.2 THEN 'low' ELSE 'none' END"
ACTION_SQL = "CASE {l} WHEN 'high' THEN 'block and notify' WHEN 'medium' THEN 'PIN re-entry' WHEN 'low' THEN 'silent flag' ELSE 'log' END"


@query("alert_level", f"""
SELECT *, {ACTION_SQL.format(l='alert_level')} AS action
FROM (SELECT txn_id, score, {LEVEL_SQL.format(s='score')} AS alert_level FROM v_scored) x""")
def _(v: Views):
    level = alert_level("score")
    return v.scored.select("txn_id", "score", level.alias("alert_level"), alert_action(level).alias("action"))


@query("fallback_score", f"""
WITH {RECORD_SQL}
SELECT txn_id, least(round(0.05e0 + CASE WHEN new_device_flag = 1 THEN 0.35e0 ELSE 0 END + CASE WHEN ip_location_mismatch = 1 THEN 0.2e0 ELSE 0 END
       + CASE WHEN high = 1 THEN 0.15e0 ELSE 0 END + CASE WHEN dev > 3 THEN 0.15e0 ELSE 0 END + CASE WHEN night = 1 THEN 0.05e0 ELSE 0 END
       + CASE WHEN kyc_verified_flag = 0 THEN 0.05e0 ELSE 0 END, 4), 0.99e0) AS fallback_score,
       amount > 10000 OR new_device_flag = 1 OR ip_location_mismatch = 1 AS offline_is_fraud,
       CASE WHEN amount > 10000 OR new_device_flag = 1 OR ip_location_mismatch = 1 THEN 0.88e0 ELSE 0.05e0 END AS offline_score
FROM rec""")
def _(v: Views):
    hit, score = offline_verdict()
    return record(v).select(
        "txn_id", fallback_score().alias("fallback_score"),
        hit.alias("offline_is_fraud"), score.alias("offline_score"),
    )


@query("ensemble_score", f"""
WITH {RECORD_SQL},
s AS (SELECT txn_id, {RULES_SQL} AS ru, {LIGHT_SQL} AS li, CASE WHEN k % 3 = 0 THEN NULL ELSE k / 100.0e0 END AS tr FROM rec),
e AS (SELECT *, CASE WHEN tr IS NULL THEN round(least(greatest(ru * 0.375e0 + li * 0.625e0, 0), 1), 6)
                     ELSE round(least(greatest(ru * 0.15e0 + tr * 0.6e0 + li * 0.25e0, 0), 1), 6) END AS score FROM s)
SELECT txn_id, score AS ensemble_score, score >= 0.5 AS is_fraud, {LEVEL_SQL.format(s='score')} AS alert_level,
       CASE WHEN tr IS NULL THEN 'rules,light_lr' ELSE 'rules,tree,light_lr' END AS active_scorers,
       CASE WHEN tr IS NULL THEN 0.375e0 ELSE 0.15e0 END AS rules_weight FROM e""")
def _(v: Views):
    """Every third row lacks the tree score, so both weightings occur."""
    rec = record(v).withColumn("__tree", F.when(F.col("k") % 3 != 0, F.col("k") / 100.0))
    return scoring.ensemble(rec, tree_score="__tree", light_trained=True).select(
        "txn_id", "ensemble_score", "is_fraud", "alert_level",
        F.array_join("active_scorers", ",").alias("active_scorers"),
        F.try_element_at("weights_used", F.lit("rules")).alias("rules_weight"),
    )


@query("calendar_features", """
SELECT event_id, CAST(hour(ts) AS INT) AS hour_of_day, CAST(isodow(ts) - 1 AS INT) AS day_of_week,
       CAST(isodow(ts) >= 6 AS INT) AS is_weekend, CAST(hour(ts) < 6 OR hour(ts) >= 22 AS INT) AS is_night_transaction FROM events""")
def _(v: Views):
    return v.base("events").select("event_id", *[c.alias(n) for n, c in calendar_columns("ts").items()])


def live(v: Views) -> DataFrame:
    """Event transactions with the text fields a parsed message would carry."""
    return v.event_txn.withColumns(
        {
            "payee": F.when(F.col("k") % 2 == 0, F.concat(F.lit("shop"), F.col("k").cast("string"), F.lit("@okaxis")))
            .otherwise(F.concat(F.lit("Person "), F.col("k").cast("string"))),
            "sender": F.when(F.col("k") % 3 == 0, "AD-PAYTM").when(F.col("k") % 3 == 1, "vm-phonepe").otherwise("AD-HDFCBK"),
            "category": F.when(F.col("event_type") == "purchase", "Shopping").otherwise("Food"),
            "usr_account_age_days": (F.col("user_id") * 37 % 2000).cast("double"),
        }
    )


LIVE_SQL = f"""
WITH {BASE_SQL},
l AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'Merchant' ELSE 'User' END AS receiver_type,
        CASE k % 3 WHEN 0 THEN 'Paytm' WHEN 1 THEN 'PhonePe' ELSE 'GPay' END AS app,
        CASE WHEN event_type = 'purchase' THEN 'Shopping' ELSE 'Food' END AS category,
        CAST(user_id * 37 % 2000 AS DOUBLE) AS age, CAST(isodow(ts) - 1 AS INT) AS dow,
        CAST(hour_of_day < 6 OR hour_of_day >= 22 AS INT) AS night,
        CASE WHEN is_cold_start THEN amount ELSE mean END AS own FROM y)"""


@query("request_features", f"""{LIVE_SQL}
SELECT txn_id, receiver_type, CASE receiver_type WHEN 'User' THEN 'P2P' ELSE 'P2M' END AS transaction_type, app AS payment_app, 'Android' AS device_type,
  '25-34' AS usr_age_group, app AS usr_preferred_app, 'Android' AS usr_preferred_device,
  CASE receiver_type WHEN 'User' THEN 'P2P Transfer' ELSE category END AS mrc_category, CASE receiver_type WHEN 'User' THEN 'P2P' ELSE 'Medium' END AS mrc_size,
  amount, hour_of_day, dow AS day_of_week, CAST(dow >= 5 AS INT) AS is_weekend, night AS is_night_transaction,
  60.0e0 AS time_since_last_txn_min, 0.1e0 AS transaction_velocity, round(z_amount, 6) AS amount_deviation_score, 0.0e0 AS failed_attempts_last_24h,
  CAST(0 AS INT) AS recurring_payment_flag, round(z_hour, 6) AS transaction_frequency_score, new_device_flag, ip_location_mismatch,
  CAST(2 AS INT) AS user_city_tier, 30.0e0 AS user_avg_monthly_txn, round(own, 8) AS user_avg_txn_value, 0.6e0 AS user_loyalty_score, 10000.0e0 AS balance_after_transaction,
  CAST(1 AS INT) AS txn_success_flag, kyc_verified_flag, CAST(2 AS INT) AS usr_home_city_tier, age AS usr_account_age_days, 1.0e0 AS usr_linked_bank_count,
  round(own, 8) AS usr_avg_monthly_txn_profile, round(own, 8) AS usr_avg_txn_value_profile, CAST(0 AS INT) AS usr_is_high_risk,
  CASE receiver_type WHEN 'User' THEN 0.0e0 ELSE 50.0e0 END AS mrc_avg_daily_txn, CAST(1 AS INT) AS mrc_is_registered,
  CASE receiver_type WHEN 'User' THEN NULL ELSE 4.0e0 END AS mrc_rating, CASE WHEN new_device_flag = 1 THEN 0.9e0 END AS device_risk_score,
  CASE WHEN ip_location_mismatch = 1 THEN 0.95e0 END AS ip_risk_score
FROM l""")
def _(v: Views):
    df = scoring.request_features(with_baseline(live(v))).select("txn_id", *fixed.MODEL_FEATURES)
    df = rounded(df, 6, "amount_deviation_score", "transaction_frequency_score")
    return rounded(df, 8, "user_avg_txn_value", "usr_avg_monthly_txn_profile", "usr_avg_txn_value_profile")


FLAGSHIP_SQL = f"""{LIVE_SQL},
s AS (SELECT *, least(round(0.02e0 + CASE WHEN new_device_flag = 1 THEN 0.35e0 ELSE 0 END + CASE WHEN ip_location_mismatch = 1 THEN 0.2e0 ELSE 0 END
       + CASE WHEN kyc_verified_flag = 0 THEN 0.15e0 ELSE 0 END
       + CASE WHEN z_amount > 4 THEN 0.2e0 WHEN z_amount > 2 THEN 0.1e0 WHEN z_amount > 1 THEN 0.03e0 ELSE 0 END
       + CASE WHEN night = 1 THEN 0.05e0 ELSE 0 END
       + CASE WHEN (CASE WHEN age = 0 THEN 999 ELSE age END) < 30 AND amount > 5000 THEN 0.08e0 ELSE 0 END, 4), 0.98e0) AS score FROM l),
t AS (SELECT txn_id, user_id, ts, amount, z_amount, z_hour, CASE WHEN amount >= 0.05 THEN score END AS score, amount >= 0.05 AS valid FROM s)
SELECT txn_id, user_id, ts, amount, round(z_amount, 6) AS z_amount, round(z_hour, 6) AS z_hour,
       score AS ensemble_score, coalesce(score >= 0.5, false) AS is_fraud, CASE WHEN valid THEN {LEVEL_SQL.format(s='score')} END AS alert_level,
       CASE WHEN valid THEN {ACTION_SQL.format(l="(" + LEVEL_SQL.format(s='score') + ")")} END AS action,
       CASE WHEN valid THEN '' ELSE 'amount too small' END AS reasons
FROM t"""


@query("score_batch", FLAGSHIP_SQL)
def score_batch_query(v: Views):
    scored = scoring.score_batch(live(v), rules={"amount too small": F.col("amount") >= 0.05})
    return scored.select(
        "txn_id", "user_id", "ts", "amount",
        r("z_amount", 6).alias("z_amount"), r("z_hour", 6).alias("z_hour"),
        "ensemble_score", F.coalesce("is_fraud", F.lit(False)).alias("is_fraud"), "alert_level", "action",
        F.array_join("reasons", "; ").alias("reasons"),
    )


@query("payload_json", """
SELECT txn_id, concat('{"txn_id":', txn_id, ',"amount":', CAST(amount AS STRING), ',"event_type":"', event_type, '","k":',
       CASE WHEN k % 2 = 0 THEN CAST(k AS STRING) ELSE 'null' END, '}') AS payload,
       amount, CASE WHEN k % 2 = 0 THEN CAST(k AS DOUBLE) END AS k
FROM v_event_txn""")
def _(v: Views):
    df = v.event_txn.withColumn("k", F.when(F.col("k") % 2 == 0, F.col("k"))).select("txn_id", "amount", "event_type", "k")
    packed = df.select("txn_id", scoring.to_payload(df).alias("payload"))
    read = packed.withColumn("read", scoring.from_payload("payload", df.schema))
    return read.select("txn_id", "payload", "read.amount", F.col("read.k").cast("double").alias("k"))


@query("apply_verdicts", f"""
WITH n AS (SELECT txn_id, (txn_id * 31 % 1000) / 1e3 AS s FROM v_ledger WHERE txn_id % 3 = 0)
SELECT l.txn_id, coalesce(n.s, l.fraud_score) AS fraud_score, coalesce(n.s >= 0.5, l.is_fraud) AS is_fraud,
       CASE WHEN n.s IS NULL THEN 'none' ELSE {LEVEL_SQL.format(s='n.s')} END AS alert_level
FROM v_ledger l LEFT JOIN n ON l.txn_id = n.txn_id""")
def _(v: Views):
    score = F.col("txn_id") * 31 % 1000 / 1e3
    verdicts = v.ledger.filter(F.col("txn_id") % 3 == 0).select(
        "txn_id", score.alias("fraud_score"), (score >= 0.5).alias("is_fraud"), alert_level(score).alias("alert_level")
    )
    ledger = v.ledger.withColumn("alert_level", F.lit("none"))
    return scoring.apply_verdicts(ledger, verdicts).select("txn_id", "fraud_score", "is_fraud", "alert_level")


def typed_records(v: Views) -> DataFrame:
    """Scoring records from events; some break rules."""
    k = F.col("k")
    base = scoring.request_features(with_baseline(live(v).withColumn("amount", F.col("amount") + 1)))
    return base.withColumns(
        {
            "upi_id": F.when(k % 4 == 0, "user@oksbi").when(k % 4 == 1, "notavpa").when(k % 4 == 2, "a@b"),
            "amount": F.when(k % 20 == 7, -1.0).otherwise(F.col("amount")),
            "mrc_size": F.when(k % 6 == 0, "P2P").otherwise(F.col("mrc_size")),
            "hour_of_day": F.when(k % 10 == 3, 24).otherwise(F.col("hour_of_day")),
            "mrc_category": F.when(k % 12 == 1, "Casino").otherwise(F.col("mrc_category")),
            "user_loyalty_score": F.when(k % 25 == 2, F.lit(None)).otherwise(F.col("user_loyalty_score")),
        }
    )


@query("validate_records", """
WITH t AS (SELECT txn_id, k, k % 2 = 0 AS merchant FROM v_event_txn)
SELECT txn_id, concat_ws('; ',
   CASE WHEN k % 12 = 1 THEN 'mrc_category: not an allowed value' END,
   CASE WHEN merchant AND k % 6 = 0 THEN 'mrc_size: P2P needs receiver User' END,
   CASE WHEN k % 4 IN (1, 2) THEN 'upi_id: not a payment address' END,
   CASE WHEN k % 20 = 7 THEN 'amount: must be above 0' END,
   CASE WHEN k % 10 = 3 THEN 'hour_of_day: missing or out of range' END,
   CASE WHEN k % 25 = 2 THEN 'user_loyalty_score: missing or out of range' END) AS reasons
FROM t""")
def _(v: Views):
    return validate(typed_records(v), record_rules()).select(
        "txn_id", F.array_join("reasons", "; ").alias("reasons")
    )
