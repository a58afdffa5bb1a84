"""Shards of near-equal bytes by a k-d tree over document metadata.

Each node is split at the weighted median, by bytes, of its widest dimension, until its leaves hold
the target. All nodes of a level are split together. A median is found on totals only: bytes per
4096th of the key's range, then per 4096th of the part that holds the median, until that part is a
thousandth of a leaf. A key is the coordinate, scaled to 30 bits, followed by 32 bits of a hash of
the row, so that a value which a third of all rows share can be cut as well.

The metadata is written once, without texts; what is joined to it is one row a node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.llm.common import join_small, saved

BITS, TIE, STEP = 30, 32, 12
TOLERANCE = 0.001
SLOT_ROWS = 50_000


def text_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def metadata(size: Column) -> dict[str, Column]:
    """The dimensions of `documents`: source, size, language and id."""
    code = lambda name: F.crc32(F.col(name).cast("binary")).cast("double")
    return {"by_source": code("source"), "by_size": F.log2(size.cast("double")), "by_lang": code("lang"),
            "by_id": F.col("doc_id").cast("double")}


def extents(low: DataFrame, n_dims: int) -> list[tuple[float, float]]:
    """Smallest and largest value of each dimension, NaN and null aside: one row."""
    value = [F.when(~F.isnan(F.col("_dims")[i]), F.col("_dims")[i]) for i in range(n_dims)]
    row = low.agg(*[f(v) for v in value for f in (F.min, F.max)]).first()
    return [(row[2 * i], row[2 * i + 1]) if row[2 * i] is not None else (0.0, 0.0) for i in range(n_dims)]


def keyed(df: DataFrame, bounds: list[tuple[float, float]]) -> DataFrame:
    """Replace `_dims` and `_tie` by `keys`, an array of longs. Null and NaN come first."""
    keys = []
    for i, (lo, hi) in enumerate(bounds):
        v = F.col("_dims")[i]
        place = F.floor((v - F.lit(lo)) / F.lit(hi - lo if hi > lo else 1.0) * float((1 << BITS) - 2)) + 1
        place = F.when(v.isNull() | F.isnan(v), F.lit(0)).otherwise(place).cast("long")
        keys.append(place * F.lit(1 << TIE) + F.pmod(F.col("_tie"), F.lit(1 << TIE)))
    return df.withColumn("keys", F.array(*keys)).drop("_dims", "_tie")


def step_down(df: DataFrame, cut: DataFrame, leaves: int | None = None) -> DataFrame:
    """`node` one level further down; no level has more than `leaves` nodes."""
    at = cut.select(F.col("node").alias("_node"), "dim", "cut")
    df = join_small(df, at, F.col("node") == F.col("_node"), "left", at_most=leaves)
    right = F.coalesce((F.element_at("keys", F.col("dim") + 1) > F.col("cut")).cast("long"), F.lit(0))
    return df.withColumn("node", 2 * F.col("node") + right).drop("_node", "dim", "cut")


def descend(df: DataFrame, cuts: list[DataFrame], leaves: int | None = None) -> DataFrame:
    """Add `node`: where each row arrives after the given levels of cuts."""
    df = df.withColumn("node", F.lit(1).cast("long"))
    for cut in cuts:
        df = step_down(df, cut, leaves)
    return df


def split(rows: DataFrame, nodes: DataFrame, n_dims: int, leaves: int | None = None) -> DataFrame:
    """(node, dim, cut, k, left_k) for the nodes that are to be split, at most `leaves`; `nodes` has (node, k) with k > 1."""
    width = [(F.max(F.shiftright(F.element_at("keys", i + 1), TIE)) - F.min(F.shiftright(F.element_at("keys", i + 1), TIE))) for i in range(n_dims)]
    inside = join_small(rows, nodes.select(F.col("node").alias("_node"), "k"), F.col("node") == F.col("_node"), at_most=leaves).drop("_node")
    stats = inside.groupBy("node", "k").agg(F.sum("size").alias("bytes"), F.array(*width).alias("width"))
    stats = stats.select(
        "node", "k", "bytes", (F.array_position("width", F.array_max("width")) - 1).cast("int").alias("dim"),
        F.floor(F.col("k") / 2).alias("left_k"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("below"))
    state = saved(stats.withColumn("goal", F.col("bytes") * F.col("left_k") / F.col("k")), "nodes")
    shift = BITS + TIE
    while True:
        step = min(STEP, shift)
        shift -= step
        named = state.select(F.col("node").alias("_node"), "dim", "low", "below", "goal")
        key = F.element_at("keys", F.col("dim") + 1)
        part = join_small(rows, named, F.col("node") == F.col("_node"), at_most=leaves).withColumn("bin", F.shiftright(key - F.col("low"), shift))
        part = part.filter(F.col("bin").between(0, (1 << step) - 1)).groupBy("node", "below", "goal", "bin").agg(F.sum("size").alias("held"))
        before = F.sum("held").over(W.partitionBy("node").orderBy("bin")) - F.col("held") + F.col("below")
        part = part.withColumn("before", before).filter(F.col("before") <= F.col("goal"))
        best = part.groupBy("node").agg(F.max("bin").alias("bin"), F.max_by("before", "bin").alias("before"), F.max_by("held", "bin").alias("held"))
        state = saved(
            state.drop("held").withColumnRenamed("below", "_b").join(best, "node")
            .withColumn("low", F.col("low") + F.col("bin") * F.lit(1 << shift)).withColumn("below", F.col("before"))
            .drop("_b", "before", "bin"), "nodes")
        worst = state.agg(F.max(F.col("held") * F.col("k") / F.col("bytes"))).first()[0]
        if shift == 0 or worst is None or worst <= TOLERANCE:
            break
    over = F.col("goal") - F.col("below") >= F.col("held") / 2
    cut = F.when(over, F.col("low") + F.lit((1 << shift) - 1)).otherwise(F.col("low") - 1)
    return saved(state.select("node", "dim", cut.alias("cut"), "k", "left_k"), "cuts")


def grow(rows: DataFrame, n_dims: int, leaves: int) -> tuple[list[DataFrame], DataFrame]:
    """The cuts of every level, and (node, shard) of the leaves. `rows` has (size, keys).

    Rows are written with their node once a level: a median takes several rounds, and each would
    join all levels above again, with a table to broadcast for every one. What is joined has one row a
    node, so the number of leaves bounds it and it is not counted each time.
    """
    spark = rows.sparkSession
    nodes = spark.range(1, 2).select(F.col("id").alias("node"), F.lit(leaves).cast("long").alias("k"))
    cuts: list[DataFrame] = []
    most, here = leaves, descend(rows, [])
    while most > 1:
        if cuts:
            here = saved(step_down(here, cuts[-1], leaves), "placed")
        cut = split(here, nodes.filter("k > 1"), n_dims, leaves)
        cuts.append(cut)
        halves = F.array(F.col("left_k"), F.col("k") - F.col("left_k"))
        children = cut.select(F.posexplode(halves).alias("side", "k"), "node").select((2 * F.col("node") + F.col("side")).alias("node"), "k")
        # Leaves, and nodes that no row has reached.
        done = nodes.join(cut.select("node"), "node", "left_anti").select((2 * F.col("node")).alias("node"), F.lit(1).cast("long").alias("k"))
        nodes = saved(children.union(done), "tree")
        most = nodes.agg(F.max("k")).first()[0]
    # One row a leaf in one task.
    return cuts, saved(nodes.select("node", (F.row_number().over(W.orderBy("node")) - 1).cast("int").alias("shard")), "leaves")


def kd_shards(docs: DataFrame, size: Column, dims: dict[str, Column], tie: Column, target_bytes: int | None = None,
              leaves: int | None = None) -> DataFrame:
    """`docs` with (size, shard): leaves of near-equal bytes, numbered from 0.

    Give `target_bytes`, the most bytes a leaf is to hold, or the number of `leaves`. Null
    coordinates count as lower than all others. Rows that are alike in coordinates and in `tie` are
    not told apart and stay together. An empty table gives an empty one; a table of fewer rows than
    leaves leaves some empty. Columns named like the new ones are replaced.
    """
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    facts = [size.alias("size"), F.array(*[d.cast("double") for d in dims.values()]).alias("_dims"), tie.alias("_tie")]
    low = saved(docs.select(*facts), "metadata")
    bounds = extents(low, len(dims))
    rows = saved(keyed(low, bounds), "keys")
    if leaves is None:
        total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        leaves = max(1, -(-total // target_bytes))
    cuts, shards = grow(rows, len(dims), leaves)
    full = descend(keyed(docs.select(*named, *facts), bounds), cuts, leaves)
    placed = join_small(full, shards.withColumnRenamed("node", "_leaf"), F.col("node") == F.col("_leaf"), at_most=leaves)
    keep = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ("size", "shard")]
    return placed.select(*keep, "size", "shard")


def slots(df: DataFrame, group: str, *order: str) -> DataFrame:
    """`df` with `slot`: numbers from 0 without gaps in every group, in buckets of some 50,000 rows."""
    df = saved(df, "unnumbered")
    n = 1 + df.count() // SLOT_ROWS
    rows = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)))
    sums = rows.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    first = F.sum("_n").over(W.partitionBy(group).orderBy("_bucket")) - F.col("_n")
    starts = saved(sums.withColumn("_first", first).drop("_n"), "starts")
    local = F.row_number().over(W.partitionBy(group, "_bucket").orderBy(*order)) - 1
    out = join_small(rows.withColumn("_local", local), starts, [group, "_bucket"])
    return out.withColumn("slot", F.col("_first") + F.col("_local")).drop("_bucket", "_first", "_local")
