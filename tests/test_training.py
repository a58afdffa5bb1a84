"""Training table, sources, evaluation and models."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import fixed
from ledgerlens.operators import evaluate, model, prep, stats
from ledgerlens.plans import master
from ledgerlens.plans.catalog import QUERIES
from ledgerlens.plans.fixtures import Views
from ledgerlens.session import shared_folder
from ledgerlens.sources.evolving import scratch_folder
from ledgerlens.sources.tables import SCHEMAS, load


@pytest.fixture(scope="module")
def table(views):
    return master.build_master(views.anchor, views.anchor_users, views.merchants, views.supplement)


def test_master_shape(table, views):
    assert len(table.columns) == 50
    assert sorted(prep_cols := master.prune(table).columns) == sorted([*fixed.MODEL_FEATURES, "is_fraud"]) and len(prep_cols) == 41
    assert table.count() == views.anchor.count() + views.supplement.count()


def test_master_sink_is_partitioned(spark, table):
    folder = scratch_folder(spark, "master")
    master.write_master(table, folder)
    back = spark.read.parquet(folder)
    assert {r.data_source for r in back.select("data_source").distinct().collect()} == {"anchor", "supplement"}
    plan = back.filter("data_source = 'anchor'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(data_source" in plan


def test_csv_and_parquet_agree(spark, views):
    folder = scratch_folder(spark, "tables")
    views.anchor.write.option("header", True).csv(f"{folder}/transactions")
    rows = load(spark, folder, "transactions", "csv")
    declared = spark.createDataFrame([], SCHEMAS["transactions"]).schema
    assert [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in declared]
    parquet = scratch_folder(spark, "tables")
    rows.write.parquet(f"{parquet}/transactions")
    assert load(spark, parquet, "transactions").exceptAll(rows).count() == 0


def test_person_to_person(spark):
    txn = spark.createDataFrame([("MRC1", "Merchant"), ("MRC9", "Merchant"), ("MRC1", "User")], "receiver_id string, receiver_type string")
    merchants = spark.createDataFrame([("MRC1", "Food", "Small", 5.0, 0, 4.0)], "merchant_id string, merchant_category string, merchant_size string, avg_daily_transactions double, is_registered int, rating double")
    got = master.enrich_merchants(txn, merchants).collect()
    assert sorted((r.receiver_type, r.mrc_category or "", r.mrc_is_registered if r.mrc_is_registered is not None else -1) for r in got) == [("Merchant", "", -1), ("Merchant", "Food", 0), ("User", "P2P Transfer", 1)]


def test_hour_deviation_examples(spark):
    # Two users at 2 o'clock: 0.63 deviations from 01:30 and 6.67 from 10:00.
    for mean, std, z in ((1.5, 0.8, 0.63), (10.0, 1.2, 6.67)):
        assert abs(2 - mean) / std == pytest.approx(z, abs=0.006)
    df = spark.createDataFrame([(1, 5), (2, 1), (2, 1), (2, 1)], "user_id long, hour_of_day int")
    got = master.hour_deviation(df, "z").groupBy("user_id").agg(F.max("z").alias("z")).collect()
    assert {r.user_id: r.z for r in got} == {1: 0.0, 2: 0.0}
    one = spark.createDataFrame([(1, 4), (1, 8)], "user_id long, hour_of_day int")
    assert master.hour_deviation(one, "z").first().z == pytest.approx(2 / math.sqrt(8))


def test_overlap(spark):
    a = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, is_fraud int")
    b = spark.createDataFrame([(1, 1), (2, 0)], "id long, is_fraud int")
    r = master.overlap_audit({"a": a, "b": b}, "id").first()
    assert (r.common, r.share, r.fraud_rate_b, r.rejected) == (2, 1.0, 0.5, True)


def test_imputation_uses_train_only(spark):
    rows = [(1, 1.0, "a", False), (2, 3.0, "a", False), (3, None, None, False), (4, None, None, True), (5, 1e9, "z", True)]
    df = spark.createDataFrame(rows, "txn_id long, x double, t string, is_test boolean")
    got = {r.txn_id: (r.x, r.t) for r in prep.impute_from_train(df).collect()}
    assert got[4] == (2.0, "a") and got[5] == (1e9, "z")


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, score double")


def test_auc_with_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.3), (0, 0.3), (1, 0.3)]
    r = evaluate.auc(scored(spark, rows)).first()
    pairs = [(1.0 if p > n else 0.5 if p == n else 0.0) for lp, p in rows if lp for ln, n in rows if not ln]
    assert r.roc_auc == pytest.approx(sum(pairs) / len(pairs))
    assert r.avg_precision == pytest.approx(1 / 3 * 1 / 2 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 6)
    assert evaluate.auc(scored(spark, [(0, 0.1), (0, 0.2)])).first().roc_auc is None


def test_published_counts(spark):
    rows = [(1, 0.9)] * 61 + [(1, 0.1)] * 100 + [(0, 0.1)] * 5839
    one = evaluate.classification_report(scored(spark, rows)).filter("class = 1").first()
    assert (one.tp, one.fp, one.fn, one.tn) == (61, 0, 100, 5839)
    assert round(one.precision, 4) == 1.0 and round(one.recall, 4) == 0.3789 and round(one.f1, 4) == 0.5495
    assert round(one.accuracy, 4) == 0.9833


def test_threshold_choice(spark):
    good = [(1, 0.42)] * 9 + [(0, 0.42)] + [(0, 0.01)] * 90 + [(1, 0.01)]
    table = evaluate.sweep(scored(spark, good))
    assert table.count() == 10 and table.first().recall_ceiling == 0.9
    best = evaluate.pick_threshold(table).first()
    assert best.meets and best.threshold == 0.40  # the highest of equal thresholds
    poor = evaluate.pick_threshold(evaluate.sweep(scored(spark, [(1, 0.01), (0, 0.9)]))).first()
    assert not poor.meets and poor.threshold == 0.50


def test_histogram_holds_every_row(spark):
    rows = [(0, 0.0), (0, 1.0), (0, 0.0249), (1, 0.025)]
    got = evaluate.score_histogram(scored(spark, rows)).collect()
    assert sorted((r.label, r.bin, r.n) for r in got) == [(0, 0, 2), (0, 39, 1), (1, 1, 1)]
    assert sum(r.density for r in got if r.label == 0) / 40 == pytest.approx(1.0)


def test_model_keeps_its_metrics(spark, views):
    rows = views.event_txn.withColumn("label", F.col("is_fraud").cast("double"))
    features = ["amount", "k", "failed"]
    fitted = model.train_trees(rows, features, maxIter=3, maxDepth=3)
    folder = scratch_folder(spark, "model")
    model.save_model(fitted, 0.45, features, folder)
    loaded, threshold, names = model.load_model(folder)
    assert (threshold, names) == (0.45, features)
    a, b = (evaluate.auc(model.tree_score(rows, m)).first() for m in (fitted, loaded))
    assert a == b and a.roc_auc > 0.9
    medians = stats.column_medians(rows, ["k"])
    r = model.ablate(fitted, rows, medians, ["k"]).first()
    assert r.ap_masked < r.ap_base and r.verdict in ("rule engine", "partial learner", "genuine model")
    light = model.train_light(rows, ["k"])
    assert model.tree_score(rows, light).filter("score between 0 and 1").count() == rows.count()


def test_scores_come_of_all_trees(spark, tmp_path, monkeypatch):
    """Error rows are fraud and all others not, so every tree parts the classes and its leaves are known."""
    events = spark.range(200).select(
        F.col("id").alias("event_id"), F.lit("2024-01-01 10:00:00").cast("timestamp").alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.when(F.col("id") % 3 == 0, "error").otherwise("view").alias("event_type"),
        F.when(F.col("id") % 3 == 0, 200.0).otherwise(20.0).alias("value"), F.lit('{"k": 3}').alias("props"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    fitted, train = [], model.train_trees
    monkeypatch.setattr(model, "train_trees", lambda *a, **p: fitted.append(train(*a, **p)) or fitted[-1])
    rows = QUERIES["gbt_scores"](Views(spark, str(tmp_path))).collect()
    trees = fitted[0].stages[-1]
    assert (trees.getNumTrees, trees.getMaxDepth()) == (400, 5)
    margin = 1.0  # the first tree gives the class, +1 or -1; each further one 0.05 of its residual
    for _ in range(399):
        margin += 0.05 * 4 / (1 + math.exp(2 * margin))
    fraud = 1 / (1 + math.exp(-2 * margin))
    assert {r.is_fraud for r in rows} == {0, 1} and len(rows) == 40
    for r in rows:
        assert r.score == pytest.approx(fraud if r.is_fraud else 1 - fraud, abs=2e-6)


def test_trees_have_a_folder_that_cuts_their_lineage(spark, monkeypatch):
    rows = spark.range(60).select((F.col("id") % 2).cast("double").alias("label"), F.col("id").alias("x"))
    given = []
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(type(spark.sparkContext), "setCheckpointDir", lambda self, folder: given.append(folder))
    model.train_trees(rows, ["x"], maxIter=1, maxDepth=1)
    assert given == [shared_folder(spark)]


def test_statistics_of_the_filled_columns_only(spark):
    """Ids that the bridge takes from the supplement are not counted by value."""
    anchor = spark.createDataFrame([("t1", "u1", 1.0, "GPay", 3.0), ("t2", "u2", 2.0, "GPay", 5.0)],
                                   "transaction_id string, user_id string, amount double, payment_app string, user_loyalty_score double")
    got = {(r["column"], r["median"], r["mode"]) for r in master.bridge_stats(anchor).collect()}
    assert got == {("payment_app", None, "GPay"), ("user_loyalty_score", 4.0, None)}
