"""Ranks, medians, numbering, cuts and neighbours against plain Python."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import balance as bal
from ledgerlens.operators.neighbours import build_tree, leaf_of, leaves_within, nearest, node_boxes
from ledgerlens.operators.ordered import exact_medians, first_by_hash, with_dense_number, with_running_totals
from ledgerlens.operators.prep import encode, fit_ordinals, stratified_split
from ledgerlens.operators.stats import anova_f, column_modes, column_stats, null_summary


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rnd = random.Random(3)
    # Most values crowd near 0, so equal-width buckets would not do.
    values = {round(rnd.random() ** 8, 9): rnd.randrange(1, 9) for _ in range(900)}
    df = spark.createDataFrame(list(values.items()), "v double, n long")
    got = with_running_totals(df, "v", {"cum": "n"}, descending=descending, totals={"all": "n"}).collect()
    upto = 0
    for r in sorted(got, key=lambda r: -r.v if descending else r.v):
        upto += values[r.v]
        assert (r.cum, r["all"]) == (upto, sum(values.values()))
    assert len(got) == len(values)


def test_medians(spark):
    rnd = random.Random(4)
    data = {"even": [rnd.random() for _ in range(200)], "odd": [float(rnd.randrange(9)) for _ in range(301)],
            "copies": [7.0] * 500 + [1.0] * 400, "one": [3.5], "two": [1.0, 2.0]}
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("even", None)]
    counted = spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").agg(F.count("*").alias("n"))
    got = {r.g: r.median for r in exact_medians(counted, "g", "v", "n").collect()}
    assert got == pytest.approx({g: statistics.median(vs) for g, vs in data.items()})


def test_modes_take_the_lowest_on_ties(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("a", None), (None, 9)], "t string, x int")
    assert column_modes(df, ["t"]).first().mode == "a"
    assert {r["column"]: r.median for r in column_stats(df).collect()} == {"x": 2.5, "t": None}
    assert [(r["column"], r.nulls) for r in null_summary(df).collect()] == [("t", 1), ("x", 1)]


def test_dense_number_and_cut(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    numbers = [r.number for r in with_dense_number(df, "id", 5, buckets=16).collect()]
    assert sorted(numbers) == list(range(1000))
    targets = spark.createDataFrame([(0, 10), (1, 0), (2, 333)], "g long, target long")
    got = first_by_hash(df, "id", "g", targets, 5, buckets=16).filter("chosen").groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {0: 10, 2: 333}


def test_split_deals_no_row_by_its_class(spark):
    """The cuts go to every task, so that a class is not put in one."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of unknown size
    try:
        df = spark.range(2000).withColumn("y", (F.col("id") % 25 == 0).cast("int"))
        rows = stratified_split(df, "y", "id")
        assert rows.filter("is_test").count() == 400
        assert "LeftOuter, BuildRight" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(2000).withColumn("y", (F.col("id") % 25 == 0).cast("int"))
    a = stratified_split(df.repartition(7), "y", "id")
    b = stratified_split(df.repartition(3, "y"), "y", "id")
    assert a.exceptAll(b).count() == 0
    got = {(r.y, r.is_test): r["count"] for r in a.groupBy("y", "is_test").count().collect()}
    assert got == {(0, True): 384, (0, False): 1536, (1, True): 16, (1, False): 64}


def test_encode(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    ordinals = fit_ordinals(train, ["c"])
    new = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")
    assert [r.c for r in encode(new, ordinals).collect()] == [0, 1, -1, -2]


def test_anova_matches_definition(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    x = rng.normal(1e6, 1, 300) + y
    df = spark.createDataFrame([(int(a), float(b), 1.0) for a, b in zip(y, x)], "y int, x double, flat double")
    groups = [x[y == k] for k in (0, 1)]
    between = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups)
    got = {r.feature: (r.f, r["rank"]) for r in anova_f(df, "y", ["flat", "x"]).collect()}
    assert got["x"] == (pytest.approx(between * 298 / within), 1) and got["flat"] == (None, 2)


def brute(queries, points, k):
    out = {}
    for q, qv in queries:
        d = sorted((sum((a - b) * (a - b) for a, b in zip(qv, pv)), p) for p, pv in points if p != q)
        out[q] = [p for _, p in d[:k]]
    return out


@pytest.mark.parametrize("tile", [16, 4096])
def test_nearest(spark, tile):
    rnd = random.Random(6)
    # A third of the points are copies of one point.
    points = [(i, (1.0, 1.0, 1.0) if i % 3 == 0 else (float(rnd.randrange(40)), rnd.random() * 9, float(rnd.randrange(2)))) for i in range(300)]
    df = spark.createDataFrame([(i, *v) for i, v in points], "txn_id long, a double, b double, c double")
    queries = df.filter("txn_id % 2 = 0")
    got = {}
    for r in nearest(queries, df, ["a", "b", "c"], 7, tile=tile).orderBy("txn_id", "rank").collect():
        got.setdefault(r.txn_id, []).append(r.neighbour)
    assert got == brute([p for p in points if p[0] % 2 == 0], points, 7)


def test_few_points(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0)], "txn_id long, a double")
    assert nearest(df, df, ["a"], 5).count() == 2
    assert nearest(df, df.limit(0), ["a"], 5).count() == 0


def training(spark, n=240):
    rnd = random.Random(8)
    rows = [(i, int(i % 12 == 0), rnd.random() + (i % 12 == 0) * 0.5, rnd.random(), f"s{i % 5}") for i in range(n)]
    return spark.createDataFrame(rows, "txn_id long, y int, a double, b double, shop string")


def test_smote_lies_between_neighbours(spark):
    df = training(spark)
    made = bal.smote(df, ["a", "b"], "y", ratio=1.0).collect()
    at = {r.txn_id: (r.a, r.b) for r in df.collect()}
    assert len(made) == 220 - 20
    for r in made:
        for x, s, n in zip((r.a, r.b), at[r.seed_id], at[r.neighbour]):
            assert min(s, n) - 1e-9 <= x <= max(s, n) + 1e-9
    per_seed = {r.seed_id: sum(1 for x in made if x.seed_id == r.seed_id) for r in made}
    assert set(per_seed.values()) == {10}


def test_many_copies_of_few_seeds(spark):
    rows = [(i, int(i < 3), float(i), 0.0) for i in range(5003)]
    df = spark.createDataFrame(rows, "txn_id long, y int, a double, b double")
    assert bal.smote(df, ["a", "b"], "y", ratio=1.0, k=2).count() == 5000 - 3


def test_balance(spark):
    df = training(spark)
    got = bal.balance(df, ["a", "b"], "y", ratio=0.5)
    counts = {(r.y, r.is_synthetic): r["count"] for r in got.groupBy("y", "is_synthetic").count().collect()}
    assert counts == {(0, False): 220, (1, False): 20, (1, True): 90}
    assert got.filter("shop is null or a is null").count() == 0


def test_nearest_in_fifteen_dimensions(spark):
    rnd = random.Random(15)
    # clusters, a run of copies and one constant feature
    centres = [[rnd.gauss(0, 5) for _ in range(15)] for _ in range(6)]
    points = []
    for i in range(900):
        c = centres[i % 6]
        v = (1.0,) * 15 if i % 10 == 0 else tuple(round(x + rnd.gauss(0, 1), 3) for x in c)
        points.append((i, v[:14] + (2.0,)))
    cols = [f"f{j}" for j in range(15)]
    df = spark.createDataFrame([(i, *v) for i, v in points], "txn_id long, " + ", ".join(f"{c} double" for c in cols))
    queries = df.filter("txn_id % 3 = 0")
    report = {}
    got = {}
    for r in nearest(queries, df, cols, 5, tile=32, report=report).orderBy("txn_id", "rank").collect():
        got.setdefault(r.txn_id, []).append(r.neighbour)
    assert got == brute([p for p in points if p[0] % 3 == 0], points, 5)
    # leaves follow the row count; most leaves are left out for most queries
    assert report["leaves"] >= 900 // 16 // 2 and report["visited"] < 0.5


def test_leaves_grow_with_rows():
    from ledgerlens.operators.neighbours import build_tree, leaf_of

    rnd = np.random.default_rng(3)
    sizes = []
    for n in (1000, 4000, 16000):
        x = rnd.normal(size=(n, 15))
        tree = build_tree(x, 1.0, 64)
        leaves = leaf_of(x, tree)
        counts = np.bincount(leaves)
        assert counts.max() <= 64 and counts.min() >= 1
        sizes.append(counts.size)
    assert sizes[0] < sizes[1] < sizes[2] and sizes[2] >= 16000 // 64


@pytest.mark.parametrize("accuracy", [3, 50, 10_000])
def test_bracketed_medians_are_exact(spark, accuracy):
    from ledgerlens.operators.stats import bracketed_medians

    rnd = random.Random(accuracy)
    rows = []
    for i in range(2001):
        rows.append((
            float(rnd.randrange(7)),                            # many ties
            None if i % 3 == 0 else rnd.gauss(100, 30),          # nulls
            float(i) if i < 2000 else None,                      # even count
            None,                                                # no values
            1e12 + rnd.random() if i % 2 else -1e12,             # wide
            5.0,                                                 # constant
        ))
    cols = ["ties", "nulls", "even", "empty", "wide", "same"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(4)
    got = {r.column: r.median for r in bracketed_medians(df, cols, accuracy).collect()}
    for j, c in enumerate(cols):
        values = [r[j] for r in rows if r[j] is not None]
        want = statistics.median(values) if values else None
        assert got[c] == (pytest.approx(want, rel=1e-12) if want is not None else None), c
    assert bracketed_medians(df.limit(0), cols).filter("median is not null").count() == 0


def leaf_search_set(n_rows, n_features, seed, copies=0):
    """Points with a crowded place, their tree, leaf boxes and counts."""
    rnd = np.random.default_rng(seed)
    x = np.concatenate([rnd.normal(size=(n_rows, n_features)) * 9, np.ones((copies, n_features))])
    tree = build_tree(x, 1.0, 8)
    leaf = leaf_of(x, tree)
    n_leaves = int(tree[4].max()) + 1
    counts = np.bincount(leaf, minlength=n_leaves)
    low = np.array([x[leaf == c].min(axis=0) for c in range(n_leaves)])
    high = np.array([x[leaf == c].max(axis=0) for c in range(n_leaves)])
    return x, tree, low, high, counts


@pytest.mark.parametrize("n_features, needed, most", [(1, 3, 1 << 20), (3, 11, 1 << 20), (3, 11, 50), (3, 10_000, 1 << 20), (9, 6, 1 << 20)])
def test_leaves_within_are_those_of_all_boxes(n_features, needed, most):
    x, tree, low, high, counts = leaf_search_set(700, n_features, 3, copies=40)
    q = np.concatenate([x[::7], x[:20] * 3])
    rows, leaves = leaves_within(q, tree, node_boxes(tree, low, high, counts), needed, most)
    want = set()
    for i, v in enumerate(q):
        gap = np.maximum(np.maximum(low - v, v - high), 0.0)
        reach = np.maximum(np.abs(v - low), np.abs(v - high))
        near, far = (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)
        order = np.argsort(far, kind="stable")
        limit = far[order][min(int((np.cumsum(counts[order]) < needed).sum()), len(counts) - 1)]
        want |= {(i, int(c)) for c in np.flatnonzero(near <= limit * (1 + 1e-9) + 1e-9)}
    assert len(rows) == len(want) and set(zip(rows.tolist(), leaves.tolist())) == want


def test_leaf_search_does_not_look_at_every_leaf():
    """Boxes compared per query: many times the leaves do not make them many times more."""
    class Counted(np.ndarray):
        def __getitem__(self, at):
            compared.append(len(at))
            return np.asarray(self)[at]

    seen = {}
    for n in (2_000, 32_000):
        x, tree, low, high, counts = leaf_search_set(n, 3, 5)
        boxes = node_boxes(tree, low, high, counts)
        compared = []
        leaves_within(x[:50], tree, (boxes[0].view(Counted), *boxes[1:]), 11, 1 << 20)
        seen[n] = sum(compared), len(counts)
    assert seen[32_000][1] > 10 * seen[2_000][1] and seen[32_000][0] < 3 * seen[2_000][0]


def test_balance_reads_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    df = training(spark)
    bal.balance(df.mapInPandas(counted, df.schema), ["a", "b"], "y", ratio=0.5).collect()
    assert read.value == 240
