"""Views that give the shared tables the shape of payment data.

The bodies are plain SQL that Spark and other engines read alike; each may use the base
tables and the views above it.
"""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

LEDGER_AS_OF = datetime(2001, 7, 20)
EVENTS_AS_OF = datetime(2024, 1, 31)
BASE_TABLES = ["nation", "customer", "supplier", "orders", "events"]

VIEWS: dict[str, str] = {
    "v_ledger": """
SELECT o_orderkey AS txn_id, o_custkey AS user_id, o_totalprice AS amount, o_orderdate AS ts,
       concat('Merchant ', o_orderkey % 40) AS payee,
       CASE WHEN o_orderkey % 4 = 0 THEN 'User' ELSE 'Merchant' END AS receiver_type,
       CASE WHEN o_orderkey % 4 = 0 THEN concat('USR', o_orderkey % 50) ELSE concat('MRC', o_orderkey % 120) END AS receiver_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Food' WHEN '2-HIGH' THEN 'Travel' WHEN '3-MEDIUM' THEN 'Shopping'
            WHEN '4-NOT SPECIFIED' THEN 'Utilities'
            ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'Refund' ELSE 'Income' END END AS category,
       CASE o_orderstatus WHEN 'F' THEN 'Success' WHEN 'O' THEN 'Pending' ELSE 'Failed' END AS status,
       (o_orderkey * 7919 % 1000) / 1e3 AS fraud_score,
       (o_orderkey * 7919 % 1000) >= 950 AS is_fraud
FROM orders""",
    "v_event_txn": """
SELECT event_id AS txn_id, user_id, value AS amount, ts, CAST(hour(ts) AS INT) AS hour_of_day, event_type,
       k, CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS new_device_flag,
       CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS ip_location_mismatch,
       CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END AS kyc_verified_flag,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed,
       CASE WHEN k >= 97 OR (event_type = 'error' AND value > 150) THEN 1 ELSE 0 END AS is_fraud
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e""",
    "v_scored": """
SELECT txn_id, ts, is_fraud AS label,
       round(least(0.99e0, k / 150e0 + CASE WHEN is_fraud = 1 THEN 0.25e0 ELSE 0e0 END), 4) AS score
FROM v_event_txn""",
    "v_users": """
SELECT c_custkey AS user_id, concat('Tier ', 1 + n_regionkey % 3) AS city_tier, c_mktsegment AS age_group,
       n_name AS city, CAST(c_custkey * 37 % 2000 AS DOUBLE) AS account_age_days, 1 + c_custkey % 4 AS linked_bank_count,
       CAST(10 + c_custkey % 60 AS DOUBLE) AS avg_monthly_transactions,
       c_acctbal AS avg_transaction_value,
       CASE WHEN c_custkey % 2 = 0 THEN 'GPay' ELSE 'PhonePe' END AS preferred_app,
       CASE WHEN c_custkey % 3 = 0 THEN 'iOS' ELSE 'Android' END AS preferred_device,
       CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS is_high_risk_user
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_merchants": """
SELECT concat('MRC', s_suppkey) AS merchant_id, s_name AS merchant_name, n_name AS merchant_category,
       CASE WHEN s_suppkey % 3 = 0 THEN 'Small' WHEN s_suppkey % 3 = 1 THEN 'Medium' ELSE 'Enterprise' END AS merchant_size,
       s_acctbal AS avg_daily_transactions, 1 AS is_registered, 1 + s_suppkey % 5 AS rating
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "v_sms": """
SELECT txn_id AS msg_id, user_id, ts,
       CASE txn_id % 4 WHEN 0 THEN 'AD-HDFCBK' WHEN 1 THEN 'vm-ICICIB' WHEN 2 THEN '+919876543210' ELSE 'AD-GPAY' END AS sender,
       CASE txn_id % 5
         WHEN 0 THEN concat('Your a/c XX1234 debited Rs.', CAST(amount AS DECIMAL(18,2)), ' on 26-Apr-25 to ', payee, ' UPI Ref: ', 100000000000 + txn_id)
         WHEN 1 THEN concat('INR ', CAST(amount AS DECIMAL(18,2)), ' paid towards Zomato on 01/02/25 Txn ID: ABCD', 1000000 + txn_id)
         WHEN 2 THEN 'Your OTP is 4821'
         WHEN 3 THEN 'UPI payment received, see statement'
         ELSE concat('Rs ', CAST(amount AS DECIMAL(18,2)), ' credited to ', payee, ' via UPI') END AS body
FROM v_ledger""",
    "v_supplement": """
SELECT event_id AS transaction_id, user_id, value AS amount,
       CASE event_type WHEN 'click' THEN 'POS' WHEN 'view' THEN 'QR' WHEN 'purchase' THEN 'Online' WHEN 'signup' THEN 'ATM' ELSE 'Other' END AS transaction_type,
       event_type AS merchant_category, 'XX' AS country, CAST(hour(ts) AS INT) AS hour,
       (event_id * 31 % 100) / 1e2 AS device_risk_score, (event_id * 17 % 100) / 1e2 AS ip_risk_score,
       CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END AS is_fraud
FROM events""",
    "v_anchor": """
SELECT concat('TXN', o_orderkey) AS transaction_id, concat('USR_', o_custkey) AS user_id,
       CASE WHEN o_orderkey % 4 = 0 THEN concat('USR_', o_orderkey % 50) ELSE concat('MRC', o_orderkey % 120) END AS receiver_id,
       CASE WHEN o_orderkey % 50 = 0 THEN 'unknown' ELSE CAST(o_orderdate AS STRING) END AS timestamp,
       CASE WHEN o_orderkey % 70 = 0 THEN '' ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS date,
       CASE o_orderstatus WHEN 'F' THEN 'Success' WHEN 'O' THEN 'Pending' ELSE 'Failed' END AS status,
       CASE WHEN o_orderkey % 9 = 0 THEN 'Pending' WHEN o_orderkey % 31 = 0 THEN NULL ELSE 'Verified' END AS user_kyc_status,
       CASE WHEN o_orderkey % 4 = 0 THEN 'User' ELSE 'Merchant' END AS receiver_type,
       CASE WHEN o_orderkey % 4 = 0 THEN 'P2P' ELSE 'P2M' END AS transaction_type,
       CASE o_orderkey % 3 WHEN 0 THEN 'GPay' WHEN 1 THEN 'PhonePe' ELSE 'Paytm' END AS payment_app,
       CASE WHEN o_orderkey % 6 = 0 THEN 'iOS' ELSE 'Android' END AS device_type,
       o_totalprice AS amount, CAST(o_orderkey * 13 % 24 AS INT) AS hour_of_day,
       CASE o_orderkey % 7 WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday' WHEN 2 THEN 'Wednesday' WHEN 3 THEN 'Thursday'
            WHEN 4 THEN 'Friday' WHEN 5 THEN 'Saturday' ELSE 'Sunday' END AS day_of_week,
       CASE WHEN o_orderkey % 7 >= 5 THEN 1 ELSE 0 END AS is_weekend,
       CASE WHEN o_orderkey * 13 % 24 < 6 OR o_orderkey * 13 % 24 >= 22 THEN 1 ELSE 0 END AS is_night_transaction,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderkey * 7 % 1440 AS DOUBLE) END AS time_since_last_txn_min,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE (o_orderkey * 11 % 100) / 1e2 END AS transaction_velocity,
       CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE (o_orderkey * 17 % 600) / 1e2 - 1e0 END AS amount_deviation_score,
       CAST(o_orderkey * 5 % 4 AS DOUBLE) AS failed_attempts_last_24h,
       CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END AS recurring_payment_flag,
       (o_orderkey * 19 % 100) / 1e2 AS transaction_frequency_score,
       CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS new_device_flag,
       CASE WHEN o_orderkey % 14 = 0 THEN 1 ELSE 0 END AS ip_location_mismatch,
       concat('Tier ', 1 + o_custkey % 3) AS user_city_tier,
       CAST(5 + o_custkey % 60 AS DOUBLE) AS user_avg_monthly_txn, CAST(100 + o_custkey % 900 AS DOUBLE) AS user_avg_txn_value,
       (o_custkey % 100) / 1e2 AS user_loyalty_score,
       o_totalprice / 4e0 AS balance_after_transaction,
       CASE WHEN (o_orderkey * 7919 % 1000) >= 960 THEN 1 ELSE 0 END AS is_fraud
FROM orders""",
    "v_anchor_users": """
SELECT concat('USR_', user_id) AS user_id, age_group, city, city_tier, account_age_days, linked_bank_count,
       avg_monthly_transactions, avg_transaction_value, preferred_app, preferred_device, is_high_risk_user
FROM v_users""",
    "v_budgets": """
SELECT user_id, 'Food' AS category, 60000.0e0 * (1 + user_id % 5) AS monthly_limit FROM v_users WHERE user_id % 3 <> 0
UNION ALL
SELECT user_id, 'Travel', 90000.0e0 * (1 + user_id % 5) FROM v_users WHERE user_id % 3 <> 0
UNION ALL
SELECT user_id, 'Shopping', 120000.0e0 * (1 + user_id % 5) FROM v_users WHERE user_id % 3 <> 0""",
    "v_payee_log": """
SELECT lower(payee) AS payee_name, category, CASE WHEN txn_id % 2 = 0 THEN 'user' ELSE 'nlp' END AS source,
       CASE WHEN txn_id % 2 = 0 THEN NULL ELSE 0.9e0 END AS confidence,
       txn_id AS seq, CASE WHEN txn_id % 7 = 0 THEN 'delete' ELSE 'upsert' END AS op
FROM v_ledger WHERE txn_id % 40 < 25 AND category NOT IN ('Income', 'Refund')""",
    "v_goals": """
SELECT user_id, user_id * 10 + slot AS goal_id, concat('Goal ', slot) AS name,
       CASE WHEN (user_id + slot) % 13 = 0 THEN 0.0e0 ELSE 1000.0e0 * (5 + (user_id + slot) % 40) END AS target_amount,
       CASE WHEN avg_transaction_value < 0 THEN 0.0e0 ELSE avg_transaction_value * slot END AS saved_amount,
       CASE WHEN (user_id + slot) % 5 = 0 THEN NULL ELSE CAST((user_id * 7 + slot) % 60 - 20 AS INT) END AS due_in_days,
       CAST(user_id * 3 % 11 + slot AS INT) AS created_order,
       (user_id + slot) % 9 = 0 AS is_completed
FROM (SELECT user_id, avg_transaction_value, 1 AS slot FROM v_users
      UNION ALL SELECT user_id, avg_transaction_value, 2 AS slot FROM v_users) g""",
    "v_state_log": """
SELECT user_id AS state_key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, value AS payload
FROM events""",
}


def load_base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


class Views:
    """The views over one data folder, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._frames: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = load_base(self.spark, self.sf_dir, name)
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        view = f"v_{name}"
        if view not in self._frames:
            body = VIEWS[view]
            for other in [*BASE_TABLES, *VIEWS]:
                if _mentions(body, other):
                    frame = self.base(other) if other in BASE_TABLES else getattr(self, other[2:])
                    frame.createOrReplaceTempView(other)
            self._frames[view] = self.spark.sql(body)
        return self._frames[view]


def _mentions(body: str, name: str) -> bool:
    words = body.replace("(", " ").replace(")", " ").split()
    return any(a.upper() in ("FROM", "JOIN") and b == name for a, b in zip(words, words[1:]))


def with_views(sql: str) -> str:
    """Prefix a query with the views it uses, as common table expressions."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if _mentions(text, name) and name not in wanted:
                visit(VIEWS[name])
                wanted.append(name)

    visit(sql)
    parts = [f"{name} AS ({VIEWS[name]})" for name in wanted]
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
