"""Trailing windows against plain Python, and the worked examples."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.baseline import with_baseline, with_velocity
from ledgerlens.operators.trailing import Frame, with_trailing

T0 = datetime(2024, 3, 1, 10)
SCHEMA = "txn_id long, user_id long, ts timestamp_ntz, amount double, hour_of_day int"


def history(amounts, hours, last_amount, last_hour):
    rows = [(i, 1, T0 + timedelta(hours=i), float(a), h) for i, (a, h) in enumerate(zip(amounts, hours))]
    return rows + [(99, 1, T0 + timedelta(hours=50), last_amount, last_hour)]


def last(spark, rows):
    return with_baseline(spark.createDataFrame(rows, SCHEMA)).filter("txn_id = 99").first()


def test_amount_examples(spark):
    # mean 500, deviation 80: 15000 is 181.25 deviations away, 560 is 0.75.
    amounts = [420, 580] * 3
    assert last(spark, history(amounts, [12] * 6, 15000.0, 12)).z_amount == pytest.approx(181.25)
    assert last(spark, history(amounts, [12] * 6, 560.0, 12)).z_amount == pytest.approx(0.75)


def test_floors_and_cold_start(spark):
    r = last(spark, history([100] * 5, [9] * 5, 103.0, 10))
    assert (r.n, r.std, r.std_hour, r.z_amount, r.z_hour) == (5, 1.0, 0.5, 3.0, 2.0)
    r = last(spark, history([100] * 4, [9] * 4, 1e6, 3))
    assert (r.is_cold_start, r.z_amount, r.z_hour, r.mean, r.std_hour) == (True, 0.0, 0.0, 0.0, 6.0)
    r = last(spark, history([100] * 6, [9, None, None, 9, 9, 9], 100.0, 6))
    assert (r.is_cold_start, r.mean_hour, r.z_hour) == (False, 12.0, 1.0)


def test_own_row_and_same_time_rows_do_not_count(spark):
    rows = [(i, 1, T0, 10.0, 1) for i in range(20)] + [(20, 1, T0 + timedelta(microseconds=1), 10.0, 1)]
    got = {r.txn_id: r.n for r in with_baseline(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {**{i: 0 for i in range(20)}, 20: 20}


def test_window_edge(spark):
    rows = [(1, 1, T0, 10.0, 1), (2, 1, T0 + timedelta(days=90), 10.0, 1),
            (3, 1, T0 + timedelta(days=90, microseconds=1), 10.0, 1)]
    got = {r.txn_id: r.n for r in with_baseline(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def test_rows_without_time_survive(spark):
    rows = [(1, 1, None, 10.0, 1), (2, 1, None, 10.0, 1), (3, 1, T0, 10.0, None)]
    got = with_baseline(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3 and all(r.n == 0 for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    hour = timedelta(hours=1)
    # User 0 holds most rows; times fall on few minutes, so ties and edges occur. Some precede 1970.
    base = datetime(1969, 12, 31)
    rows = [(i, 0 if rnd.random() < 0.7 else rnd.randrange(5), base + timedelta(minutes=15 * rnd.randrange(400)), float(rnd.randrange(100))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, u long, ts timestamp_ntz, x double")
    frames = [Frame(3 * hour, {"near": F.col("x"), "n": F.lit(1)}), Frame(20 * hour, {"band": F.lit(1)}, end=5 * hour)]
    got = {r.id: r for r in with_trailing(df, ["u"], "ts", frames, previous="prev").collect()}
    assert len(got) == 400
    for i, u, t, _ in rows:
        ages = [(t - t2, x) for _, u2, t2, x in rows if u2 == u]
        near = [x for a, x in ages if timedelta(0) < a <= 3 * hour]
        r = got[i]
        assert (r.near, r.n) == (sum(near), len(near))
        assert r.band == sum(1 for a, _ in ages if 5 * hour < a <= 20 * hour)
        earlier = [t2 for _, u2, t2, _ in rows if u2 == u and t2 < t]
        assert r.prev == (max(earlier) if earlier else None)


def test_hot_key_is_spread(spark):
    """One user with all rows must not end in one partition of the window."""
    rows = spark.range(5000).select(
        F.col("id").alias("txn_id"), F.lit(1).cast("long").alias("user_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("id") % 700).cast("int"))).alias("ts"),
        F.lit(5.0).alias("amount"), F.lit(3).alias("hour_of_day"),
    )
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = with_baseline(rows).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(parts) == 8 and max(r["count"] for r in parts) < 5000 / 3


def test_velocity(spark):
    d = timedelta(days=1)
    rows = [
        (1, 1, T0, "shop", 9.0, 1), (2, 1, T0 + timedelta(minutes=30), "shop", 9.0, 0),
        (3, 1, T0 + timedelta(minutes=60), "cafe", 5.0, 0), (4, 1, T0 + 24 * timedelta(hours=1), "cafe", 5.0, 0),
        (5, 1, T0 + 30 * d, "shop", 9.0, 0), (6, 1, T0 + 30 * d + timedelta(hours=1), "cafe", 9.0, 0),
    ]
    df = spark.createDataFrame(rows, "txn_id long, user_id long, ts timestamp_ntz, payee string, amount double, failed int")
    got = {r.txn_id: (r.time_since_last_txn_min, r.transaction_velocity, r.failed_attempts_last_24h, r.recurring_payment_flag) for r in with_velocity(df).collect()}
    assert got[1] == (None, 0, 0, 0)
    assert got[2] == (30.0, 1, 1, 0)
    assert got[3] == (30.0, 2, 1, 0)
    assert got[4] == (23 * 60.0, 0, 1, 0)
    assert got[5][3] == 1 and got[6][3] == 0


@pytest.mark.parametrize("base", [1e9, 1e12])
def test_large_amounts_keep_their_deviation(spark, base):
    """Against two passes over the rows of the frame, with an outlier that enters and leaves it."""
    rng = random.Random(5)
    rows = [(i, i % 2, T0 + timedelta(hours=7 * i, minutes=i % 60), base + rng.randrange(60), i % 24) for i in range(700)]
    rows[10] = (10, 0, rows[10][2], base * 1000, 3)
    got = with_baseline(spark.createDataFrame(rows, SCHEMA)).collect()
    for r in got:
        seen = [a - base for _, u, t, a, _ in rows if u == r.user_id and r.ts - timedelta(days=90) <= t < r.ts]
        assert r.n == len(seen)
        if len(seen) >= 5:
            mean = sum(seen) / len(seen)
            std = max((sum((a - mean) ** 2 for a in seen) / len(seen)) ** 0.5, 1.0)
            assert r.std == pytest.approx(std, rel=1e-6)
            assert r.z_amount == pytest.approx((r.amount - base - mean) / std, rel=1e-6, abs=1e-6)


def test_frame_of_one_slice(spark):
    rows = [(i, 1, T0 + timedelta(minutes=20 * i), 1.0, 1) for i in range(12)]
    out = with_trailing(spark.createDataFrame(rows, SCHEMA), ["user_id"], "ts", [Frame(timedelta(hours=1), {"n": F.lit(1)})])
    assert {r.txn_id: r.n for r in out.collect()} == {i: min(i, 3) for i in range(12)}
