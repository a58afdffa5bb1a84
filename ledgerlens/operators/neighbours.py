"""Exact nearest neighbours of many points without forming all pairs.

Points are dealt into the leaves of a k-d tree of cuts. The cuts come from a bounded, hashed
sample of the points (`SAMPLE_ROWS`): a node is cut at the sample median of its widest feature,
over all features, until a leaf would hold about half a tile of points; the number of leaves so
grows with the data (at most `MAX_LEAVES`, beyond which leaves grow instead). Every point then
falls in exactly one leaf, so the sample decides the shape of the tree, never a result.

The leaves' bounding boxes and counts give each query a distance that surely holds k points
(the running k-th distance over leaves taken best first, by their farthest corner); only leaves
nearer than that are searched. They are found by descending the tree of boxes, so a query's cost
follows the leaves near it, not all leaves. Leaves are split into tiles on both sides, so a crowded
leaf is many small tasks, and each tile hands on no more than k points per query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.text import hash32
from ledgerlens.session import written

#: Points drawn, by a hash of their key, to place the cuts; the tree's leaves stay below MAX_LEAVES.
SAMPLE_ROWS = 100_000
MAX_LEAVES = 16_384


def build_tree(sample: np.ndarray, scale: float, leaf_rows: int) -> tuple[np.ndarray, ...]:
    """Cuts of a k-d tree: per node (feature, cut, left, right), -1 children for leaves, and leaf
    numbers. A node of the sample standing for more than `leaf_rows` points is cut at the median of
    its widest feature; a node whose points are all equal, or that cannot be cut in two, is a leaf."""
    feature, cut, left, right, leaf = [], [], [], [], []

    def grow(rows: np.ndarray) -> int:
        at = len(feature)
        feature.append(-1); cut.append(0.0); left.append(-1); right.append(-1); leaf.append(-1)  # noqa: E702
        if len(rows) * scale > leaf_rows and len(rows) > 1:
            part = sample[rows]
            width = part.max(axis=0) - part.min(axis=0)
            f = int(np.argmax(width))
            if width[f] > 0:
                value = float(np.median(part[:, f]))
                low = part[:, f] <= value
                if low.all():  # the median is the largest value: cut just below it
                    value = float(np.max(part[:, f][part[:, f] < value]))
                    low = part[:, f] <= value
                feature[at], cut[at] = f, value
                a = grow(rows[low])
                b = grow(rows[~low])
                left[at], right[at] = a, b
                return at
        leaf[at] = max(leaf) + 1
        return at

    grow(np.arange(len(sample)))
    return tuple(np.array(x) for x in (feature, cut, left, right, leaf))


def leaf_of(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """The leaf number of each row of `x`, all rows descending the tree one level at a time."""
    feature, cut, left, right, leaf = tree
    node = np.zeros(len(x), np.int64)
    while True:
        inner = left[node] >= 0
        if not inner.any():
            return leaf[node]
        rows = np.flatnonzero(inner)
        f = feature[node[rows]]
        go_left = x[rows, f] <= cut[node[rows]]
        node[rows] = np.where(go_left, left[node[rows]], right[node[rows]])


def node_boxes(tree: tuple[np.ndarray, ...], low: np.ndarray, high: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(low, high, points) of every node, from those of the leaves; a leaf without points has low above high."""
    _, _, left, right, leaf = tree
    node_low, node_high = np.full((len(left), low.shape[1]), np.inf), np.full((len(left), low.shape[1]), -np.inf)
    node_n = np.zeros(len(left), np.int64)
    ends = np.flatnonzero(left < 0)
    node_low[ends], node_high[ends], node_n[ends] = low[leaf[ends]], high[leaf[ends]], counts[leaf[ends]]
    for at in range(len(left) - 1, -1, -1):  # children come after their parent
        if left[at] >= 0:
            both = [left[at], right[at]]
            node_low[at], node_high[at], node_n[at] = node_low[both].min(axis=0), node_high[both].max(axis=0), node_n[both].sum()
    return node_low, node_high, node_n


def leaves_within(
    x: np.ndarray, tree: tuple[np.ndarray, ...], boxes: tuple[np.ndarray, ...], needed: int, most: int
) -> tuple[np.ndarray, np.ndarray]:
    """(row of `x`, leaf number) of the leaves that can hold one of the `needed` nearest points of the row.

    The reach of a row is the smallest distance at which the leaves that lie wholly within it hold `needed`
    points. On the way down the nearest node with `needed` points bounds it from above, which drops all
    nodes beyond; no leaf within reach is among them. Rows with more than `most` open nodes are halved.
    """
    _, _, left, right, leaf = tree
    low, high, counts = boxes
    rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    limit, found = np.full(len(x), np.inf), []
    while len(rows):
        if len(rows) > most and len(x) > 1:
            half = len(x) // 2
            a, b = (leaves_within(part, tree, boxes, needed, most) for part in (x[:half], x[half:]))
            return np.concatenate([a[0], b[0] + half]), np.concatenate([a[1], b[1]])
        at = x[rows]
        gap = np.maximum(np.maximum(low[node] - at, at - high[node]), 0.0)
        reach = np.maximum(np.abs(at - low[node]), np.abs(at - high[node]))
        near, far = (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)
        full = counts[node] >= needed
        np.minimum.at(limit, rows[full], far[full])
        # A little slack keeps rounding from hiding a cell that just touches.
        kept = (counts[node] > 0) & (near <= limit[rows] * (1 + 1e-9) + 1e-9)
        end = kept & (left[node] < 0)
        found.append((rows[end], node[end], near[end], far[end]))
        rows, node = rows[kept & ~end], node[kept & ~end]
        rows, node = np.repeat(rows, 2), np.stack([left[node], right[node]], axis=1).ravel()
    rows, node, near, far = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((far, rows))
    rows, node, near, far = rows[order], node[order], near[order], far[order]
    have = np.cumsum(counts[node])
    first = np.searchsorted(rows, rows)  # of the same row
    before = have[first] - counts[node[first]]
    limit = np.full(len(x), -np.inf)
    # leaves up to the one that completes `needed`; all, where there are fewer points
    inside = have - counts[node] - before < needed
    np.maximum.at(limit, rows[inside], far[inside])
    kept = near <= limit[rows] * (1 + 1e-9) + 1e-9
    return rows[kept], leaf[node[kept]]


def nearest(
    queries: DataFrame,
    points: DataFrame,
    features: list[str],
    k: int,
    key: str = "txn_id",
    carry: tuple[str, ...] = (),
    tile: int = 4096,
    report: dict | None = None,
) -> DataFrame:
    """The `k` nearest other points of each query: `key`, neighbour, distance2, rank, `carry`.

    Euclidean distance over `features` as they are; a null or NaN in one is an error. Ties go to
    the lower key.
    Fewer than `k` rows come back only where fewer other points exist. A `report` dict, when
    given, receives the number of leaves and the share of (query, leaf) pairs searched.
    """
    def number(f: str) -> Column:
        # A missing value would hide the whole cell it falls in: no result is better than that.
        x = F.col(f).cast("double")
        stop = F.raise_error(F.lit(f"neighbours: {f} holds a null or NaN"))
        return F.when(x.isNull() | F.isnan(x), stop).otherwise(x).alias(f)

    doubles = [number(f) for f in features]
    points = points.select(F.col(key).alias("__p"), *doubles, *carry)
    queries = queries.select(F.col(key).alias("__q"), *doubles)

    # One bounded sample places the cuts; a leaf should hold about half a tile of points.
    n = points.count()
    rate = min(1.0, SAMPLE_ROWS / max(n, 1))
    drawn = points.filter(F.pmod(hash32(3, "__p"), F.lit(1 << 20)) < F.lit(int(rate * (1 << 20)) + 1))
    sample = np.array([list(r) for r in drawn.select(*features).collect()], dtype=float).reshape(-1, len(features))
    scale = n / max(len(sample), 1)
    leaf_rows = max(tile // 2, -(-n // MAX_LEAVES))
    tree = build_tree(sample, scale, leaf_rows) if len(sample) else tuple(np.array(x) for x in ([-1], [0.0], [-1], [-1], [0]))

    # Of many copies of one point only the first k+1 by key can be among anyone's nearest.
    copies = Window.partitionBy(*features).orderBy("__p")
    points = (
        points.withColumn("__n", F.row_number().over(copies)).filter(F.col("__n") <= k + 1).drop("__n")
    )
    names = list(features)

    def to_leaves(batches):
        for batch in batches:
            out = batch.copy()
            out["__cell"] = leaf_of(batch[names].to_numpy(dtype=float), tree).astype("int32")
            yield out

    placed = points.mapInPandas(to_leaves, T.StructType([*points.schema.fields, T.StructField("__cell", T.IntegerType())]))
    placed = written(placed, "points-placed")  # read for the boxes and for the search
    boxes = (
        placed.groupBy("__cell")
        .agg(
            F.count("*").alias("n"),
            *[g(f).alias(f"{name}_{f}") for f in features for name, g in (("lo", F.min), ("hi", F.max))],
        )
        .collect()  # one row a leaf: at most MAX_LEAVES
    )
    if not boxes:
        empty = points.select(F.col("__p").alias(key), F.col("__p").alias("neighbour"), *carry)
        return empty.withColumns({"distance2": F.lit(0.0), "rank": F.lit(0)}).limit(0)
    cell_ids = np.array([b["__cell"] for b in boxes])
    counts = np.array([b["n"] for b in boxes])
    n_leaves = int(tree[4].max()) + 1
    leaf_low, leaf_high = np.full((n_leaves, len(names)), np.inf), np.full((n_leaves, len(names)), -np.inf)
    leaf_low[cell_ids] = [[b[f"lo_{f}"] for f in features] for b in boxes]
    leaf_high[cell_ids] = [[b[f"hi_{f}"] for f in features] for b in boxes]
    nodes = node_boxes(tree, leaf_low, leaf_high, np.bincount(cell_ids, counts, n_leaves).astype(np.int64))
    needed = k + 1  # the query itself may be one of the points

    # a step's gaps to the open nodes' boxes stay near 4 million numbers
    most = (1 << 22) // len(names)

    def to_cells(batches):
        for batch in batches:
            rows, cells = leaves_within(batch[names].to_numpy(dtype=float), tree, nodes, needed, most)
            # a row can touch very many leaves: its copies are handed on in parts
            for start in range(0, len(rows), most):
                out = batch.iloc[rows[start : start + most]].copy()
                out["__cell"] = cells[start : start + most].astype("int32")
                yield out

    schema = T.StructType([*queries.schema.fields, T.StructField("__cell", T.IntegerType())])
    sent = written(queries.mapInPandas(to_cells, schema), "queries-sent")  # read for the counts and for the search
    asked = {r["__cell"]: r["n"] for r in sent.groupBy("__cell").agg(F.count("*").alias("n")).collect()}
    if report is not None:
        report["leaves"] = len(boxes)
        report["visited"] = sum(asked.values()) / max(1, queries.count() * len(boxes))
    table = [
        (int(c), -(-int(n) // tile), -(-int(asked.get(int(c), 0)) // tile))
        for c, n in zip(cell_ids, counts)
        if int(c) in asked
    ]
    spark = points.sparkSession
    tiles = F.broadcast(spark.createDataFrame(table, "__cell int, __pt int, __qt int"))

    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    point_tiles = (
        placed.join(tiles, "__cell")
        .withColumn("__pt", F.pmod(hash32(1, "__p"), F.col("__pt")).cast("int"))
        .withColumn("__qt", every("__qt"))
    )
    query_tiles = (
        sent.join(tiles, "__cell")
        .withColumn("__qt", F.pmod(hash32(2, "__q"), F.col("__qt")).cast("int"))
        .withColumn("__pt", every("__pt"))
    )
    carried = list(carry)

    def search(left, right):
        import pandas as pd

        right = right.sort_values("__p", kind="stable")
        p = right[names].to_numpy()
        ids = right["__p"].to_numpy()
        found = []
        for start in range(0, len(left), 256):
            part = left.iloc[start : start + 256]
            q = part[names].to_numpy()
            d = np.zeros((len(q), len(p)))
            for j in range(len(names)):
                diff = q[:, j][:, None] - p[:, j][None]
                d += diff * diff
            d[part["__q"].to_numpy()[:, None] == ids[None]] = np.inf
            # Points up to the k-th distance, then of those the first k by distance and key.
            last = min(k, d.shape[1]) - 1
            within = (d <= np.partition(d, last, axis=1)[:, last : last + 1]) & np.isfinite(d)
            at, pick = np.nonzero(within)
            order = np.lexsort((pick, d[at, pick], at))
            at, pick = at[order], pick[order]
            keep = np.arange(len(at)) - np.searchsorted(at, at) < k
            at, pick = at[keep], pick[keep]
            out = {
                key: part["__q"].to_numpy()[at],
                "neighbour": ids[pick],
                "distance2": d[at, pick],
            }
            for c in carried:
                out[c] = right[c].to_numpy()[pick]
            found.append(pd.DataFrame(out))
        return pd.concat(found) if found else pd.DataFrame(columns=[key, "neighbour", "distance2", *carried])

    dtype = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    result = ", ".join(
        [f"`{key}` {dtype['__p']}", f"neighbour {dtype['__p']}", "distance2 double"]
        + [f"`{c}` {dtype[c]}" for c in carried]
    )
    group = ["__cell", "__pt", "__qt"]
    local = query_tiles.groupBy(*group).cogroup(point_tiles.groupBy(*group)).applyInPandas(search, result)
    order = Window.partitionBy(key).orderBy("distance2", "neighbour")
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
