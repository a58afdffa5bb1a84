"""Keyed state and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators.state import apply_corrections, current_state, latest_per_key, state_counts
from ledgerlens.operators.validate import audit_keys, binary_target, check_contract
from ledgerlens.plans.catalog.registry import query
from ledgerlens.plans.fixtures import Views


@query("latest_per_key", """
SELECT state_key, seq, op, payload FROM v_state_log QUALIFY row_number() OVER (PARTITION BY state_key ORDER BY seq DESC) = 1""")
def _(v: Views):
    return latest_per_key(v.state_log, ["state_key"], ["seq"])


@query("current_state", """
SELECT state_key, seq, payload FROM
  (SELECT * FROM v_state_log QUALIFY row_number() OVER (PARTITION BY state_key ORDER BY seq DESC) = 1) x WHERE op <> 'delete'""")
def _(v: Views):
    return current_state(v.state_log, ["state_key"])


def corrections(v: Views):
    n = F.col("txn_id")
    return v.ledger.filter(n % 7 == 3).select(
        "txn_id", "payee", F.when(n % 2 == 0, "Grocery").otherwise("Healthcare").alias("category"),
        (n + 10_000_000).alias("seq"),
    )


@query("apply_corrections", """
WITH k AS (SELECT txn_id, payee, CASE WHEN txn_id % 2 = 0 THEN 'Grocery' ELSE 'Healthcare' END AS category, txn_id + 10000000 AS seq
           FROM v_ledger WHERE txn_id % 7 = 3),
g AS (SELECT payee_name, category, source, seq, op FROM v_payee_log
      UNION ALL SELECT lower(payee), category, 'user', seq, 'upsert' FROM k),
c AS (SELECT * FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY payee_name ORDER BY seq DESC) = 1) x WHERE op <> 'delete')
SELECT 'ledger' AS part, CAST(l.txn_id AS STRING) AS item, coalesce(k.category, l.category) AS category FROM v_ledger l LEFT JOIN k ON l.txn_id = k.txn_id
UNION ALL SELECT 'payee', payee_name, category FROM c""")
def _(v: Views):
    rows, log = apply_corrections(v.ledger, v.payee_log, corrections(v))
    payees = current_state(log, ["payee_name"])
    return rows.select(F.lit("ledger").alias("part"), F.col("txn_id").cast("string").alias("item"), "category").unionByName(
        payees.select(F.lit("payee").alias("part"), F.col("payee_name").alias("item"), "category")
    )


@query("state_counts", """
WITH c AS (SELECT * FROM (SELECT * FROM v_payee_log QUALIFY row_number() OVER (PARTITION BY payee_name ORDER BY seq DESC) = 1) x WHERE op <> 'delete')
SELECT (SELECT count(*) FROM c WHERE source = 'user') AS user_payees, (SELECT count(*) FROM v_budgets) AS budgets,
       (SELECT count(*) FROM v_goals WHERE NOT is_completed) AS active_goals""")
def _(v: Views):
    return state_counts(current_state(v.payee_log, ["payee_name"]), v.budgets, v.goals)


@query("schema_evolution", """
SELECT txn_id, user_id, amount, CAST(NULL AS DOUBLE) AS hour_of_day FROM v_event_txn WHERE ts < TIMESTAMP '2024-01-16'
UNION ALL SELECT txn_id, user_id, amount, hour_of_day FROM v_event_txn WHERE ts >= TIMESTAMP '2024-01-16'""")
def _(v: Views):
    from ledgerlens.sources.evolving import read_evolving, scratch_folder

    folder = scratch_folder(v.spark, "evolving")
    old = v.event_txn.filter("ts < TIMESTAMP_NTZ '2024-01-16 00:00:00'").select("txn_id", "user_id", "amount")
    new = v.event_txn.filter("ts >= TIMESTAMP_NTZ '2024-01-16 00:00:00'").select("txn_id", "user_id", "amount", "hour_of_day")
    old.write.parquet(f"{folder}/version=1")
    new.write.parquet(f"{folder}/version=2")
    return read_evolving(v.spark, folder).drop("version").select(
        "txn_id", "user_id", "amount", F.col("hour_of_day").cast("double").alias("hour_of_day")
    )


@query("contract_check", """
SELECT 'is_fraud is 0 or 1' AS rule, count(*) FILTER (WHERE is_fraud NOT IN (0, 1)) AS violations FROM v_event_txn
UNION ALL SELECT 'amount is above 1', count(*) FILTER (WHERE NOT amount > 1) FROM v_event_txn
UNION ALL SELECT 'event type is not signup', count(*) FILTER (WHERE event_type = 'signup') FROM v_event_txn""")
def _(v: Views):
    rules = {
        **binary_target("is_fraud"),
        "amount is above 1": F.col("amount") > 1,
        "event type is not signup": F.col("event_type") != "signup",
    }
    return check_contract(v.event_txn, rules)


@query("dimension_key_audit", """
SELECT 'users' AS dimension, CAST(user_id AS STRING) AS key, count(*) AS n FROM v_users GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'merchants', merchant_id, count(*) FROM v_merchants GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'payee log', payee_name, count(*) FROM v_payee_log GROUP BY 2 HAVING count(*) > 1""")
def _(v: Views):
    parts = {"users": (v.users, "user_id"), "merchants": (v.merchants, "merchant_id"), "payee log": (v.payee_log, "payee_name")}
    frames = [audit_keys(df, key).withColumn("dimension", F.lit(name)) for name, (df, key) in parts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).select("dimension", "key", "n")
