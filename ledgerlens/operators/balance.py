"""Minority oversampling: borderline classes, interpolation, back-mapping to all columns.

Every random choice is a hash of (seed, id, number), so results do not depend on how the
data is partitioned and a lost executor recomputes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import hash32, hash_unit
from ledgerlens.operators.neighbours import nearest
from ledgerlens.operators.ordered import first_by_hash, with_dense_number
from ledgerlens.session import checkpointed, written

CHUNK = 1000


def borderline_labels(
    df: DataFrame, features: list[str], label: str, key: str = "txn_id", m: int = 10
) -> DataFrame:
    """For each minority row: how many of its m nearest rows are majority, and its kind.

    `noise` when all are, `danger` when at least half are, else `safe`.
    """
    minority = df.filter(F.col(label) == 1)
    near = nearest(minority, df, features, m, key, carry=(label,))
    majority = F.count_if(F.col(label) != 1)
    kind = (
        F.when(F.col("majority_neighbours") == m, "noise")
        .when(F.col("majority_neighbours") >= m / 2, "danger")
        .otherwise("safe")
    )
    return (
        near.groupBy(key).agg(majority.alias("majority_neighbours")).withColumn("kind", kind)
    )


def smote(
    df: DataFrame,
    features: list[str],
    label: str,
    key: str = "txn_id",
    ratio: float = 1.0,
    k: int = 5,
    seed: int = 42,
    seeds: DataFrame | None = None,
) -> DataFrame:
    """Synthetic minority rows: seed_id, copy, neighbour, u and the interpolated features.

    As many rows are made as bring the minority to `ratio` of the majority. They are
    spread evenly over the seeds (all minority rows, or the `key`s in `seeds`); the rest
    goes to the first seeds in hash order. Neighbours come from the whole minority.
    """
    minority = df.filter(F.col(label) == 1).select(key, *[F.col(f).cast("double").alias(f) for f in features])
    chosen = minority if seeds is None else minority.join(seeds.select(key), key, "left_semi")
    near = nearest(chosen, minority, features, k, key)

    counts = df.agg(
        F.count_if(F.col(label) == 1).alias("minority"), F.count_if(F.col(label) != 1).alias("majority")
    ).first()
    wanted = max(int(counts["majority"] * ratio) - counts["minority"], 0)
    n_seeds = chosen.count()
    even, rest = divmod(wanted, n_seeds) if n_seeds else (0, 0)

    one_group = chosen.withColumn("__all", F.lit(0))
    target = df.sparkSession.range(1).select(F.lit(0).alias("__all"), F.lit(rest).alias("target"))
    planned = first_by_hash(one_group, key, "__all", target, seed).select(
        F.col(key).alias("seed_id"),
        *[F.col(f).alias(f"__{f}") for f in features],
        (F.lit(even) + F.col("chosen").cast("int")).alias("__copies"),
    )
    # Two steps, so that a few seeds with very many copies are unfolded by many tasks.
    chunks = planned.filter(F.col("__copies") > 0).withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("__copies") - 1) / CHUNK)))
    )
    copies = chunks.repartition("seed_id", "__chunk").withColumn(
        "copy",
        F.explode(
            F.sequence(
                F.col("__chunk") * CHUNK,
                F.least(F.col("__chunk") * CHUNK + CHUNK, F.col("__copies")) - 1,
            )
        ),
    )
    # The k neighbours of a seed as one small array: picking one needs no further shuffle.
    lists = (
        near.join(
            minority.select(F.col(key).alias("neighbour"), F.array(*features).alias("__point")), "neighbour"
        )
        .groupBy(F.col(key).alias("seed_id"))
        .agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "__point"))).alias("__near"))
    )
    drawn = (
        copies.join(lists, "seed_id")
        .withColumn("u", hash_unit(seed, F.lit("u"), "seed_id", "copy"))
        .withColumn(
            "__pick",
            F.get(
                "__near",
                F.pmod(hash32(seed, F.lit("n"), "seed_id", "copy"), F.size("__near")).cast("int"),
            ),
        )
    )
    made = [
        (F.col(f"__{f}") + F.col("u") * (F.get("__pick.__point", F.lit(i)) - F.col(f"__{f}"))).alias(f)
        for i, f in enumerate(features)
    ]
    return drawn.select("seed_id", "copy", F.col("__pick.neighbour").alias("neighbour"), "u", *made)


def balance(
    train: DataFrame,
    features: list[str],
    label: str,
    key: str = "txn_id",
    ratio: float = 0.5,
    k: int = 5,
    m: int = 10,
    seed: int = 42,
) -> DataFrame:
    """`train` plus synthetic minority rows with every column, marked by `is_synthetic`.

    Only danger rows are seeds; without any, all minority rows are. The columns that are
    not interpolated come from a donor: a minority row drawn by hash.
    """
    # The split is read by every step below: it is made once.
    train = written(train, "balance-train")
    danger = borderline_labels(train, features, label, key, m).filter(F.col("kind") == "danger")
    # The neighbour search is read several times below: keep its result, a few keys.
    seeds = checkpointed(danger.select(key))
    if seeds.isEmpty():
        seeds = None
    made = smote(train, features, label, key, ratio, k, seed, seeds)

    minority = train.filter(F.col(label) == 1)
    others = [c for c in train.columns if c not in [*features, key, label]]
    donors = with_dense_number(minority.select(key, *others), key, seed).drop(key)
    n = minority.agg(F.count("*")).scalar()
    number = F.pmod(hash32(seed, F.lit("d"), "seed_id", "copy"), n)
    # Every number has its donor; a left join leaves the hash out of any pushed-down test.
    synthetic = made.withColumn("number", number).join(donors, "number", "left")
    kinds = {f.name: f.dataType for f in train.schema.fields}
    # Interpolated values lie between whole numbers, so those columns widen to double.
    real = train.withColumns({f: F.col(f).cast("double") for f in features})
    return real.withColumn("is_synthetic", F.lit(False)).unionByName(
        synthetic.select(
            F.lit(None).cast(kinds[key]).alias(key),
            *features,
            F.lit(1).cast(kinds[label]).alias(label),
            *others,
            F.lit(True).alias("is_synthetic"),
        )
    )
