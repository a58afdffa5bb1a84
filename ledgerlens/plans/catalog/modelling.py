"""Balancing, training and evaluation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import fixed
from ledgerlens.operators import balance as bal
from ledgerlens.operators import evaluate, model, stats
from ledgerlens.plans.catalog.registry import query, rounded
from ledgerlens.plans.catalog.training_table import F_COLUMNS, HASH, split
from ledgerlens.plans.fixtures import Views
from ledgerlens.sources.evolving import scratch_folder

FEATURES = ["amount", "hour_of_day", "k"]
TREES = {"maxIter": 10, "maxDepth": 3}


def scored(v: Views) -> DataFrame:
    return v.scored.select("txn_id", "ts", "label", "score")


# --- evaluation -----------------------------------------------------------------------

COUNTS = """count(*) FILTER (WHERE score >= {t} AND label = 1) AS tp, count(*) FILTER (WHERE score >= {t} AND label = 0) AS fp,
  count(*) FILTER (WHERE score < {t} AND label = 1) AS fn, count(*) FILTER (WHERE score < {t} AND label = 0) AS tn"""
RATES = """round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1"""


@query("classification_report", f"""
WITH c AS (SELECT {COUNTS.format(t=0.5)} FROM v_scored),
p AS (SELECT CAST(1 AS INT) AS class, * FROM c UNION ALL SELECT 0, tn, fn, fp, tp FROM c)
SELECT class, tp, fp, fn, tn, {RATES}, tp + fn AS support, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM p""")
def _(v: Views):
    return rounded(evaluate.classification_report(scored(v)), 6, "precision", "recall", "f1", "accuracy")


CUM = """
g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM {src} GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn FROM g)"""
AUC = """1 - sum(pos * (cn - neg / 2)) / (sum(pos) * sum(neg)) AS roc, sum(pos * cp / (cp + cn)) / sum(pos) AS ap"""


@query("auc_metrics", f"WITH {CUM.format(src='v_scored')} SELECT round(roc, 8) AS roc_auc, round(ap, 8) AS avg_precision FROM (SELECT {AUC} FROM c) x")
def _(v: Views):
    return rounded(evaluate.auc(scored(v)), 8, "roc_auc", "avg_precision")


@query("curve_points", f"""
WITH {CUM.format(src='v_scored')}
SELECT score AS threshold, round(cp / (SELECT sum(pos) FROM g), 8) AS tpr, round(cn / (SELECT sum(neg) FROM g), 8) AS fpr,
       round(cp / (cp + cn), 8) AS precision, round(cp / (SELECT sum(pos) FROM g), 8) AS recall FROM c""")
def _(v: Views):
    return rounded(evaluate.curves(scored(v)), 8, "tpr", "fpr", "precision", "recall")


@query("score_histogram", """
WITH h AS (SELECT label, CAST(least(floor(score * 40), 39) AS INT) AS bin, count(*) AS n FROM v_scored GROUP BY 1, 2)
SELECT label, bin, n, round(n * 40 / sum(n) OVER (PARTITION BY label), 6) AS density, bin / 40 AS lower FROM h""")
def _(v: Views):
    return rounded(evaluate.score_histogram(scored(v)), 6, "density")


SWEEP = " UNION ALL ".join(f"SELECT {t:.2f}e0 AS threshold, {COUNTS.format(t=f'{t:.2f}e0')} FROM v_scored" for t in fixed.SWEEP)
SWEEP_SQL = f"""
s AS ({SWEEP}),
w AS (SELECT *, {RATES} FROM s),
x AS (SELECT threshold, tp, fp, fn, tn, precision, recall, f1, recall >= 0.75 AND precision >= 0.5 AS meets, max(recall) OVER () AS recall_ceiling FROM w)"""


@query("threshold_sweep", f"WITH {SWEEP_SQL} SELECT * FROM x")
def _(v: Views):
    return rounded(evaluate.sweep(scored(v)), 6, "precision", "recall", "f1", "recall_ceiling")


@query("pick_threshold", f"WITH {SWEEP_SQL} SELECT * FROM x ORDER BY meets DESC, f1 DESC, threshold DESC LIMIT 1")
def _(v: Views):
    table = rounded(evaluate.sweep(scored(v)), 6, "precision", "recall", "f1", "recall_ceiling")
    return evaluate.pick_threshold(table)


@query("retrain_gate", f"""
WITH recent AS (SELECT * FROM v_scored WHERE ts >= TIMESTAMP '2023-01-20' AND ts < TIMESTAMP '2024-01-20'), {CUM.format(src='recent')}
SELECT round(roc, 8) AS roc_auc, round(ap, 8) AS avg_precision, ap >= 0.45 AS accepted FROM (SELECT {AUC} FROM c) x""")
def _(v: Views):
    return rounded(evaluate.retrain_gate(scored(v), datetime(2024, 1, 20)), 8, "roc_auc", "avg_precision")


# --- balancing ------------------------------------------------------------------------

def _near_sql(queries: str, points: str, k: int) -> str:
    gaps = " + ".join(f"(CAST(q.{f} AS DOUBLE) - p.{f}) * (CAST(q.{f} AS DOUBLE) - p.{f})" for f in FEATURES)
    return f"""SELECT q.txn_id, p.txn_id AS neighbour, p.is_fraud, row_number() OVER (PARTITION BY q.txn_id ORDER BY {gaps}, p.txn_id) AS rank
      FROM {queries} q JOIN {points} p ON q.txn_id <> p.txn_id QUALIFY rank <= {k}"""


@query("borderline_labels", f"""
WITH one AS (SELECT * FROM v_event_txn WHERE is_fraud = 1), n AS ({_near_sql('one', 'v_event_txn', 10)}),
c AS (SELECT txn_id, count(*) FILTER (WHERE is_fraud <> 1) AS majority_neighbours FROM n GROUP BY 1)
SELECT *, CASE WHEN majority_neighbours = 10 THEN 'noise' WHEN majority_neighbours >= 5 THEN 'danger' ELSE 'safe' END AS kind FROM c""")
def _(v: Views):
    return bal.borderline_labels(v.event_txn, FEATURES, "is_fraud")


def _hash(tag: str) -> str:
    return HASH.format(seed=42, key=f"concat('{tag}|', seed_id, '|', copy)")


MADE = ", ".join(f"round(s.{f} + u * (p.{f} - s.{f}), 6) AS {f}" for f in FEATURES)
SMOTE_SQL = f"""
WITH one AS (SELECT * FROM v_event_txn WHERE is_fraud = 1), n AS ({_near_sql('one', 'one', 5)}),
w AS (SELECT greatest(count(*) FILTER (WHERE is_fraud = 0) // 2 - count(*) FILTER (WHERE is_fraud = 1), 0) AS wanted, count(*) FILTER (WHERE is_fraud = 1) AS seeds FROM v_event_txn),
plan AS (SELECT txn_id AS seed_id, wanted // seeds + CAST(row_number() OVER (ORDER BY {HASH.format(seed=42, key='txn_id')}, txn_id) <= wanted % seeds AS INT) AS copies FROM one, w),
drawn AS (SELECT seed_id, unnest(range(copies)) AS copy FROM plan),
x AS (SELECT seed_id, copy, {_hash('u')} / 4294967296.0e0 AS u, {_hash('n')} % 5 + 1 AS pick FROM drawn)
SELECT seed_id, copy, neighbour, round(u, 8) AS u, {MADE}
FROM x JOIN n ON x.seed_id = n.txn_id AND x.pick = n.rank JOIN one s ON s.txn_id = seed_id JOIN one p ON p.txn_id = neighbour"""


@query("smote", SMOTE_SQL)
def _(v: Views):
    df = bal.smote(v.event_txn, FEATURES, "is_fraud", ratio=0.5)
    return rounded(rounded(df, 6, *FEATURES), 8, "u")


@query("balanced_train")
def _(v: Views):
    train = split(v).filter(~F.col("is_test")).select("txn_id", "is_fraud", *F_COLUMNS)
    return rounded(bal.balance(train, FEATURES, "is_fraud"), 6, *FEATURES)


# --- models ---------------------------------------------------------------------------

def parts(v: Views) -> tuple[DataFrame, DataFrame]:
    rows = split(v).withColumn("label", F.col("is_fraud").cast("double"))
    return rows.filter(~F.col("is_test")), rows.filter("is_test")


@query("gbt_scores")
def _(v: Views):
    train, test = parts(v)
    fitted = model.train_trees(train, F_COLUMNS)
    return rounded(model.tree_score(test, fitted).select("txn_id", "is_fraud", "score"), 6, "score")


@query("ablation")
def _(v: Views):
    train, test = parts(v)
    fitted = model.train_trees(train, F_COLUMNS, **TREES)
    masked = ["k", "failed"]
    return model.ablate(fitted, test, stats.column_medians(train, masked), masked)


LINEAR = dict(zip(["k", "amount", "new_device_flag", "ip_location_mismatch"], [0.05, 0.01, 1.6, 1.2]))


@query("feature_importance", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(abs(({c} - (SELECT avg({c}) FROM v_event_txn)) * {w}e0)), 6) AS contribution FROM v_event_txn" for c, w in LINEAR.items()))
def _(v: Views):
    return rounded(model.linear_importance(v.event_txn, LINEAR), 6, "contribution")


@query("tree_importance")
def _(v: Views):
    train, _ = parts(v)
    fitted = model.train_trees(train, F_COLUMNS, **TREES)
    return v.spark.createDataFrame(model.tree_importance(fitted, F_COLUMNS), "feature string, weight double")


@query("platt_calibration")
def _(v: Views):
    rows = scored(v)
    held_out = rows.filter(F.col("txn_id") % 2 == 0).withColumn("label", F.col("label").cast("double"))
    fresh = rows.filter(F.col("txn_id") % 2 == 1)
    return rounded(model.platt(fresh, held_out).select("txn_id", "label", "score", "calibrated"), 6, "calibrated")


@query("model_roundtrip")
def _(v: Views):
    """The metrics of a model before saving and after loading, side by side."""
    train, test = parts(v)
    fitted = model.train_trees(train, F_COLUMNS, **TREES)
    folder = scratch_folder(v.spark, "model")
    model.save_model(fitted, 0.5, F_COLUMNS, folder)
    loaded, threshold, features = model.load_model(folder)
    before = evaluate.auc(model.tree_score(test, fitted).select("label", "score"))
    after = evaluate.auc(model.tree_score(test, loaded).select("label", "score"))
    return rounded(before.withColumn("stage", F.lit("before")).unionByName(after.withColumn("stage", F.lit("after"))), 8, "roc_auc", "avg_precision").select(
        "stage", "roc_auc", "avg_precision", F.lit(threshold).alias("threshold"), F.lit(",".join(features)).alias("features")
    )
