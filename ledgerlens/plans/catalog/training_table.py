"""The training table and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import fixed
from ledgerlens.operators import prep, stats
from ledgerlens.plans import master
from ledgerlens.plans.catalog.registry import query, rounded
from ledgerlens.plans.fixtures import Views
from ledgerlens.session import written

# --- the master table in SQL ----------------------------------------------------------

ANCHOR_TEXT = ["status", "user_kyc_status", "payment_app", "device_type", "day_of_week", "user_city_tier",
               "usr_age_group", "usr_home_city", "usr_home_city_tier", "usr_preferred_app",
               "usr_preferred_device", "mrc_size"]
ANCHOR_NUMBERS = ["is_weekend", "time_since_last_txn_min", "transaction_velocity", "amount_deviation_score",
                  "failed_attempts_last_24h", "recurring_payment_flag", "transaction_frequency_score",
                  "user_avg_monthly_txn", "user_avg_txn_value", "user_loyalty_score",
                  "balance_after_transaction", "txn_success_flag", "kyc_verified_flag", "usr_account_age_days",
                  "usr_linked_bank_count", "usr_avg_monthly_txn_profile", "usr_avg_txn_value_profile",
                  "usr_is_high_risk", "mrc_avg_daily_txn", "mrc_is_registered", "mrc_rating"]
USER_SQL = ", ".join(f"u.{c} AS {n}" for c, n in fixed.USER_COLUMNS.items())
MERCHANT_SQL = ", ".join(
    f"CASE WHEN a.receiver_type = 'User' THEN {fixed.P2P_DEFAULTS[n]!r} ELSE m.{c} END AS {n}"
    if n in fixed.P2P_DEFAULTS else f"m.{c} AS {n}"
    for c, n in fixed.MERCHANT_COLUMNS.items()
)
FILLED = ", ".join(
    f"coalesce({c}, (SELECT median({c}) FROM v_anchor)) AS {c}" for c in master.IMPUTED
)
ENRICHED_SQL = f"""
a AS (SELECT * REPLACE ({FILLED}, try_cast(timestamp AS TIMESTAMP) AS timestamp, try_cast(date AS TIMESTAMP) AS date),
        CAST(coalesce(status = 'Success', false) AS INT) AS txn_success_flag,
        CAST(coalesce(user_kyc_status = 'Verified', false) AS INT) AS kyc_verified_flag, 'anchor' AS data_source FROM v_anchor),
enr AS (SELECT a.*, {USER_SQL}, {MERCHANT_SQL}
      FROM a LEFT JOIN v_anchor_users u ON a.user_id = u.user_id LEFT JOIN v_merchants m ON a.receiver_id = m.merchant_id)"""
BRIDGE_OWN = """
  concat('SYN_', transaction_id) AS transaction_id, concat('SYN_USR_', user_id) AS user_id, 'SYN_MRC_UNKNOWN' AS receiver_id,
  CAST(NULL AS TIMESTAMP) AS timestamp, CAST(NULL AS TIMESTAMP) AS date, 'Merchant' AS receiver_type, 'supplement' AS data_source,
  amount, CAST(is_fraud AS INT) AS is_fraud, hour AS hour_of_day,
  CASE transaction_type WHEN 'ATM' THEN 'ATM' WHEN 'Other' THEN NULL ELSE 'P2M' END AS transaction_type, merchant_category AS mrc_category,
  CAST(device_risk_score > 0.7 AS INT) AS new_device_flag, CAST(ip_risk_score > 0.7 AS INT) AS ip_location_mismatch,
  CAST(hour < 6 OR hour >= 22 AS INT) AS is_night_transaction, device_risk_score, ip_risk_score"""
BRIDGE_SQL = "SELECT " + BRIDGE_OWN + "".join(
    f",\n  (SELECT {c} FROM enr WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}" for c in ANCHOR_TEXT
) + "".join(f",\n  (SELECT median({c}) FROM enr) AS {c}" for c in ANCHOR_NUMBERS) + "\nFROM v_supplement"
TIER = "CASE {c} WHEN 'Tier 1' THEN 1 WHEN 'Tier 2' THEN 2 WHEN 'Tier 3' THEN 3 END"
DAYS = "CASE day_of_week " + " ".join(f"WHEN '{d}' THEN {i}" for d, i in fixed.WEEKDAY_MAP.items()) + " END"
MASTER_SQL = f"""
WITH {ENRICHED_SQL},
syn AS ({BRIDGE_SQL}),
st AS (SELECT * FROM enr UNION ALL BY NAME SELECT * FROM syn),
h AS (SELECT user_id, avg(hour_of_day) AS hm, greatest(coalesce(stddev_samp(hour_of_day), 6.0), 0.5) AS hs FROM st GROUP BY 1)
SELECT st.* REPLACE (round(abs(hour_of_day - hm) / hs, 6) AS transaction_frequency_score, CAST({DAYS} AS INT) AS day_of_week,
       CAST({TIER.format(c='user_city_tier')} AS INT) AS user_city_tier, CAST({TIER.format(c='usr_home_city_tier')} AS INT) AS usr_home_city_tier)
FROM st JOIN h ON st.user_id = h.user_id"""


def master_table(v: Views) -> DataFrame:
    return master.build_master(v.anchor, v.anchor_users, v.merchants, v.supplement)


def anchor_table(v: Views) -> DataFrame:
    return master.build_anchor(v.anchor, v.anchor_users, v.merchants)


@query("master_dataset", MASTER_SQL)
def _(v: Views):
    return rounded(master_table(v), 6, "transaction_frequency_score")


@query("schema_bridge", f"WITH {ENRICHED_SQL} {BRIDGE_SQL}")
def _(v: Views):
    anchor = written(anchor_table(v), "anchor")
    return master.bridge(v.supplement, anchor, master.bridge_stats(anchor))


@query("vocab_map", """
SELECT transaction_id, CASE transaction_type WHEN 'ATM' THEN 'ATM' WHEN 'Other' THEN NULL ELSE 'P2M' END AS transaction_type
FROM v_supplement""")
def _(v: Views):
    return v.supplement.select(
        "transaction_id", master.map_vocab("transaction_type", fixed.TYPE_MAP).alias("transaction_type")
    )


@query("align_features", """
SELECT amount, hour_of_day, CAST(NULL AS DOUBLE) AS transaction_velocity, new_device_flag FROM v_event_txn""")
def _(v: Views):
    return master.align(v.event_txn, ["amount", "hour_of_day", "transaction_velocity", "new_device_flag"])


@query("stack_sources", """
SELECT CAST(txn_id AS STRING) AS id, amount, category, CAST(NULL AS DOUBLE) AS risk FROM v_ledger
UNION ALL SELECT concat('SYN_', transaction_id), amount, NULL, device_risk_score FROM v_supplement""")
def _(v: Views):
    anchor = v.ledger.select(F.col("txn_id").cast("string").alias("id"), "amount", "category")
    added = v.supplement.select(
        F.concat(F.lit("SYN_"), F.col("transaction_id").cast("string")).alias("id"), "amount",
        F.col("device_risk_score").alias("risk"),
    )
    return master.stack(anchor, added)


@query("enrich_users", f"""
SELECT a.transaction_id, {USER_SQL} FROM v_anchor a LEFT JOIN v_anchor_users u ON a.user_id = u.user_id""")
def _(v: Views):
    return master.enrich_users(v.anchor, v.anchor_users).select(
        "transaction_id", *fixed.USER_COLUMNS.values()
    )


@query("enrich_merchants", f"""
SELECT * REPLACE (CAST(mrc_is_registered AS DOUBLE) AS mrc_is_registered, CAST(mrc_rating AS DOUBLE) AS mrc_rating) FROM (
SELECT a.transaction_id, a.receiver_id, {MERCHANT_SQL} FROM v_anchor a LEFT JOIN v_merchants m ON a.receiver_id = m.merchant_id) x""")
def _(v: Views):
    joined = master.enrich_merchants(v.anchor, v.merchants)
    return joined.withColumns({c: F.col(c).cast("double") for c in ("mrc_is_registered", "mrc_rating")}).select(
        "transaction_id", "receiver_id", *fixed.MERCHANT_COLUMNS.values()
    )


@query("hour_deviation_offline", """
WITH h AS (SELECT user_id, avg(hour_of_day) AS hm, greatest(coalesce(stddev_samp(hour_of_day), 6.0), 0.5) AS hs FROM v_event_txn GROUP BY 1)
SELECT txn_id, round(abs(hour_of_day - hm) / hs, 6) AS score FROM v_event_txn t JOIN h ON t.user_id = h.user_id""")
def _(v: Views):
    return rounded(master.hour_deviation(v.event_txn, "score").select("txn_id", "score"), 6, "score")


@query("overlap_audit", """
WITH a AS (SELECT DISTINCT txn_id FROM v_ledger), b AS (SELECT DISTINCT txn_id FROM v_event_txn),
c AS (SELECT txn_id, event_type = 'error' AS f FROM v_event_txn WHERE event_type IN ('error', 'click')),
x AS (SELECT (SELECT avg(CAST(is_fraud AS INT)) FROM v_ledger) AS ra, (SELECT avg(is_fraud) FROM v_event_txn) AS rb,
             (SELECT avg(CAST(f AS INT)) FROM c) AS rc,
             (SELECT count(*) FROM a JOIN b USING (txn_id)) AS ab, (SELECT count(*) FROM a JOIN c USING (txn_id)) AS ac,
             (SELECT count(*) FROM b JOIN c USING (txn_id)) AS bc,
             (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM c) AS nc)
SELECT 'ledger' AS a, 'events' AS b, ab AS common, round(ab / least(na, nb), 6) AS share, round(ra, 6) AS fraud_rate_a, round(rb, 6) AS fraud_rate_b, ra >= 0.5 OR rb >= 0.5 AS rejected FROM x
UNION ALL SELECT 'ledger', 'balanced', ac, round(ac / least(na, nc), 6), round(ra, 6), round(rc, 6), ra >= 0.5 OR rc >= 0.5 FROM x
UNION ALL SELECT 'events', 'balanced', bc, round(bc / least(nb, nc), 6), round(rb, 6), round(rc, 6), rb >= 0.5 OR rc >= 0.5 FROM x""")
def _(v: Views):
    balanced = v.event_txn.filter(F.col("event_type").isin("error", "click"))
    sources = {
        "ledger": v.ledger.select("txn_id", F.col("is_fraud").cast("int").alias("is_fraud")),
        "events": v.event_txn.select("txn_id", "is_fraud"),
        "balanced": balanced.select("txn_id", F.col("failed").alias("is_fraud")),
    }
    return rounded(master.overlap_audit(sources, "txn_id"), 6, "share", "fraud_rate_a", "fraud_rate_b")


# Every column of the anchor table, by kind.
STAT_NUMBERS = ["amount", "hour_of_day", "is_weekend", "is_night_transaction", "time_since_last_txn_min",
                "transaction_velocity", "amount_deviation_score", "failed_attempts_last_24h", "recurring_payment_flag",
                "transaction_frequency_score", "new_device_flag", "ip_location_mismatch", "user_avg_monthly_txn",
                "user_avg_txn_value", "user_loyalty_score", "balance_after_transaction", "is_fraud"]
STAT_TEXTS = ["transaction_id", "user_id", "receiver_id", "timestamp", "date", "status", "user_kyc_status", "receiver_type",
              "transaction_type", "payment_app", "device_type", "day_of_week", "user_city_tier"]


@query("anchor_stats", " UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", round(CAST(median({c}) AS DOUBLE), 6) AS median, CAST(NULL AS STRING) AS mode FROM v_anchor" for c in STAT_NUMBERS]
    + [f"SELECT '{c}', NULL, (SELECT {c} FROM v_anchor WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in STAT_TEXTS]))
def _(v: Views):
    return rounded(stats.column_stats(v.anchor.select(*STAT_NUMBERS, *STAT_TEXTS)), 6, "median")


PROFILED = STAT_TEXTS + STAT_NUMBERS


@query("column_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{'text' if c in STAT_TEXTS else 'numeric'}' AS kind, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) AS \"distinct\" FROM v_anchor"
    for c in PROFILED) + """
UNION ALL SELECT concat('class ', is_fraud), 'balance', count(*), CAST(-1 AS BIGINT) FROM v_anchor GROUP BY is_fraud""")
def _(v: Views):
    balance = stats.class_balance(v.anchor, "is_fraud").select(
        F.concat(F.lit("class "), F.col("is_fraud").cast("string")).alias("column"),
        F.lit("balance").alias("kind"),
        F.col("n").alias("nulls"),
        F.lit(-1).cast("long").alias("distinct"),
    )
    return stats.profile(v.anchor.select(*PROFILED)).unionByName(balance)


NULLABLE = STAT_TEXTS + STAT_NUMBERS


@query("null_summary", "SELECT \"column\", nulls, round(nulls / n * 100, 6) AS pct FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS n FROM v_anchor" for c in NULLABLE)
    + ") x WHERE nulls > 0 ORDER BY nulls DESC, \"column\" LIMIT 10")
def _(v: Views):
    return rounded(stats.null_summary(v.anchor.select(*NULLABLE)), 6, "pct")


HASH = "CAST(concat('0x', substr(md5(concat('{seed}|', {key})), 1, 8)) AS BIGINT)"
SPLIT_SQL = f"""
hashed AS (SELECT *, {HASH.format(seed=42, key='txn_id')} AS hsh FROM v_event_txn),
split AS (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY hsh, txn_id)
              <= round(count(*) OVER (PARTITION BY is_fraud) * 0.2) AS is_test FROM hashed)"""


def split(v: Views) -> DataFrame:
    return prep.stratified_split(v.event_txn, "is_fraud", "txn_id")


@query("stratified_split", f"WITH {SPLIT_SQL} SELECT txn_id, is_fraud, is_test FROM split")
def _(v: Views):
    return split(v).select("txn_id", "is_fraud", "is_test")


def holes(v: Views) -> DataFrame:
    """The split with some values missing."""
    n = F.col("txn_id")
    return split(v).select(
        "txn_id", "is_test",
        F.when(n % 9 != 0, F.col("amount")).alias("amount"),
        F.when(n % 11 != 0, F.col("k").cast("double")).alias("k"),
        F.when(n % 7 != 0, F.col("event_type")).alias("event_type"),
    )


HOLES_SQL = f"""{SPLIT_SQL},
holes AS (SELECT txn_id, is_test, CASE WHEN txn_id % 9 <> 0 THEN amount END AS amount, CASE WHEN txn_id % 11 <> 0 THEN CAST(k AS DOUBLE) END AS k,
                 CASE WHEN txn_id % 7 <> 0 THEN event_type END AS event_type FROM split)"""


@query("impute_train_stats", f"""
WITH {HOLES_SQL}
SELECT txn_id, is_test, round(coalesce(amount, (SELECT median(amount) FROM holes WHERE NOT is_test)), 6) AS amount,
       coalesce(k, (SELECT median(k) FROM holes WHERE NOT is_test)) AS k,
       coalesce(event_type, (SELECT event_type FROM holes WHERE NOT is_test AND event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type
FROM holes""")
def _(v: Views):
    kept = holes(v)
    train = kept.filter(~F.col("is_test")).drop("is_test", "txn_id")
    filled = prep.impute(kept, stats.column_stats(train))
    return rounded(filled, 6, "amount")


@query("ordinal_encode", f"""
WITH {HOLES_SQL},
seen AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS code
         FROM (SELECT DISTINCT event_type FROM holes WHERE NOT is_test AND event_type IS NOT NULL AND event_type <> 'view') x)
SELECT txn_id, CASE WHEN h.event_type IS NULL THEN -2 ELSE coalesce(code, -1) END AS event_type
FROM holes h LEFT JOIN seen s ON h.event_type = s.event_type""")
def _(v: Views):
    """`view` is kept out of the fitting part, so it shows up as unseen."""
    kept = holes(v)
    fitted = prep.fit_ordinals(
        kept.filter(~F.col("is_test") & (F.col("event_type") != "view")), ["event_type"]
    )
    return prep.encode(kept, fitted).select("txn_id", "event_type")


F_COLUMNS = ["amount", "hour_of_day", "k", "new_device_flag", "ip_location_mismatch", "kyc_verified_flag", "failed"]


@query("anova_f_rank", "WITH g AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (WHERE is_fraud = 0) AS n0, count(*) FILTER (WHERE is_fraud = 1) AS n1, avg({c}) FILTER (WHERE is_fraud = 0) AS m0, "
    f"avg({c}) FILTER (WHERE is_fraud = 1) AS m1, var_pop({c}) FILTER (WHERE is_fraud = 0) AS v0, var_pop({c}) FILTER (WHERE is_fraud = 1) AS v1 FROM v_event_txn" for c in F_COLUMNS)
    + """), f AS (SELECT feature, (n0 * n1 / (n0 + n1) * (m0 - m1) * (m0 - m1)) / ((n0 * v0 + n1 * v1) / (n0 + n1 - 2)) AS f FROM g)
SELECT feature, round(f, 4) AS f, CAST(row_number() OVER (ORDER BY f DESC, feature) AS INT) AS rank FROM f""")
def _(v: Views):
    return rounded(stats.anova_f(v.event_txn, "is_fraud", F_COLUMNS), 4, "f")


@query("class_mean_ratio", """
SELECT round(avg(k) FILTER (WHERE is_fraud = 1), 6) AS mean_1, round(avg(k) FILTER (WHERE is_fraud = 0), 6) AS mean_0,
       round(avg(k) FILTER (WHERE is_fraud = 1) / avg(k) FILTER (WHERE is_fraud = 0), 6) AS ratio FROM v_event_txn""")
def _(v: Views):
    return rounded(stats.class_mean_ratio(v.event_txn, "k", "is_fraud"), 6, "mean_1", "mean_0", "ratio")


@query("dataset_report", """
WITH s AS (SELECT 'anchor' AS source, is_fraud FROM v_anchor UNION ALL SELECT 'supplement', is_fraud FROM v_supplement),
g AS (SELECT source, count(*) AS n, sum(is_fraud) AS fraud FROM s GROUP BY 1 UNION ALL SELECT 'total', count(*), sum(is_fraud) FROM s)
SELECT source, n AS rows, CAST(fraud AS BIGINT) AS fraud, round(fraud / n * 100, 6) AS rate,
       round(fraud / n * 100 - (SELECT fraud / n * 100 FROM g WHERE source = 'anchor'), 6) AS rate_shift FROM g""")
def _(v: Views):
    rows = v.anchor.select(F.lit("anchor").alias("data_source"), "is_fraud").unionByName(
        v.supplement.select(F.lit("supplement").alias("data_source"), "is_fraud")
    )
    return rounded(stats.dataset_report(rows), 6, "rate", "rate_shift")
