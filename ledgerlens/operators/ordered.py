"""Exact ranks, running totals and order statistics without a one-task sort.

Values are first collapsed to one row each (so copies cost nothing), cut into buckets of
about equal size, totalled per bucket, and only then ordered inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import hash32


BUCKETS, STEP = 64, 8


def _below(bounds: Column, value: str) -> Column:
    return F.size(F.filter(bounds, lambda b: b < F.col(value)))


def with_running_totals(
    df: DataFrame,
    value: str,
    sums: dict[str, str],
    group: str | None = None,
    descending: bool = False,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add `sums` = {output: column} running totals, inclusive, in the order of `value`,
    and `totals` = {output: column} of the whole group.

    `df` holds one row per (`group`, `value`). The bucket table has at most `BUCKETS`
    rows per group.
    """
    cuts = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    bounds = F.percentile_approx(value, cuts, F.lit(1000)).alias("__bounds")
    if group is None:
        placed = df.withColumn("__bounds", df.select(bounds).scalar())
    else:
        placed = df.join(df.groupBy(group).agg(bounds), group, "left")
    # Every STEP-th bound first, then the bounds between two of those.
    coarse = F.array(*[F.get("__bounds", F.lit(i)) for i in range(STEP - 1, BUCKETS - 1, STEP)])
    placed = placed.withColumn("__first", STEP * _below(coarse, value))
    fine = F.slice("__bounds", F.col("__first") + 1, STEP - 1)
    placed = placed.withColumn("__bucket", F.col("__first") + _below(fine, value)).drop(
        "__bounds", "__first"
    )

    keys = [group] if group else []
    order = F.col("__bucket").desc() if descending else F.col("__bucket").asc()
    # With no group these windows hold at most `BUCKETS` rows.
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    before = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals or {}
    opening = (
        placed.groupBy(*keys, "__bucket")
        .agg(*[F.sum(c).alias(f"__t_{o}") for o, c in {**sums, **totals}.items()])
        .select(
            *keys,
            "__bucket",
            *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__o_{o}") for o in sums],
            *[F.sum(f"__t_{o}").over(whole).alias(o) for o in totals],
        )
    )
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = (
        Window.partitionBy(*keys, "__bucket")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    # A left join: an inner one would push a not-null test of the bucket down to every
    # input row. Each bucket has its opening row.
    return placed.join(opening, [*keys, "__bucket"], "left").select(
        *df.columns,
        *[(F.col(f"__o_{o}") + F.sum(c).over(inside)).alias(o) for o, c in sums.items()],
        *totals,
    )


def exact_medians(counted: DataFrame, group: str, value: str, n: str) -> DataFrame:
    """The median of each group from (`group`, `value`, `n`) counts: `group`, `median`."""
    present = counted.filter(F.col(value).isNotNull())
    ranked = with_running_totals(
        present, value, {"__upto": n}, group=group, totals={"__total": n}
    )
    low = F.floor((F.col("__total") + 1) / 2)
    high = F.floor((F.col("__total") + 2) / 2)
    before = F.col("__upto") - F.col(n)

    def covers(rank: Column) -> Column:
        return (before < rank) & (F.col("__upto") >= rank)

    return (
        ranked.filter(covers(low) | covers(high))
        .groupBy(group)
        .agg(
            (
                (F.max(F.when(covers(low), F.col(value))) + F.max(F.when(covers(high), F.col(value))))
                / 2
            ).alias("median")
        )
    )


def with_dense_number(
    df: DataFrame, key: str, seed: int, out: str = "number", buckets: int = 1024
) -> DataFrame:
    """Number the rows 0..n-1 in a repeatable pseudo-random order of the unique `key`."""
    hashed = df.withColumn("__hash", hash32(seed, key)).withColumn(
        "__bucket", F.pmod(F.col("__hash"), F.lit(buckets))
    )
    before = (
        Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    # At most `buckets` rows reach this window.
    opening = (
        hashed.groupBy("__bucket")
        .count()
        .select("__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__opening"))
    )
    inside = Window.partitionBy("__bucket").orderBy("__hash", key)
    return hashed.join(opening, "__bucket", "left").select(
        *df.columns, (F.col("__opening") + F.row_number().over(inside) - 1).alias(out)
    )


def first_by_hash(
    df: DataFrame, key: str, group: str, targets: DataFrame, seed: int, buckets: int = 4096
) -> DataFrame:
    """Mark, as `chosen`, exactly `target` rows of each group, picked by the hash of `key`.

    `targets` has columns `group`, `target`. Only the hash bucket that holds the cut is
    ordered; all other rows are decided by their bucket alone and are not shuffled: the cuts, one
    row a group, go to every task. Groups are classes, few however long the table is; a join dealt
    by class would put a class in one task.
    """
    share = (1 << 32) // buckets
    hashed = df.withColumn("__hash", hash32(seed, key))
    slim = hashed.select(group, F.col(key).alias("__key"), "__hash").withColumn(
        "__bucket", F.floor(F.col("__hash") / share)
    )
    upto = (
        Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    )
    counts = slim.groupBy(group, "__bucket").count().withColumn("__upto", F.sum("count").over(upto))
    crossing = (
        counts.join(targets, group)
        .filter((F.col("__upto") >= F.col("target")) & (F.col("__upto") - F.col("count") < F.col("target")))
        .select(
            group, "__bucket", (F.col("target") - F.col("__upto") + F.col("count")).alias("__take")
        )
    )
    ranked = slim.join(F.broadcast(crossing), [group, "__bucket"]).withColumn(
        "__rank", F.row_number().over(Window.partitionBy(group).orderBy("__hash", "__key"))
    )
    cut = ranked.filter(F.col("__rank") == F.col("__take")).select(
        group, F.struct("__hash", "__key").alias("__cut")
    )
    place = F.struct(F.col("__hash"), F.col(key).alias("__key"))
    return hashed.join(F.broadcast(cut), group, "left").select(
        *df.columns, F.coalesce(place <= F.col("__cut"), F.lit(False)).alias("chosen")
    )
