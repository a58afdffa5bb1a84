"""Column statistics, profiles and the F ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.ordered import exact_medians


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _counts(df: DataFrame, cols: list[str], kind: str) -> DataFrame:
    """(column, value, n) of the non-null values, collapsed before the shuffle."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in cols]
    )
    return (
        df.select(F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def bracketed_medians(df: DataFrame, cols: list[str], accuracy: int = 10_000) -> DataFrame:
    """(column, median), exact, by selection in three scans with no row-by-column explode.

    1. One aggregate: each column's count and sketched quantiles just below and above the middle,
       which bracket the median (the sketch's rank error is at most rows / `accuracy`).
    2. One aggregate: how many values of each column lie below its bracket.
    3. Only values inside a bracket, about 4 / `accuracy` of a column, are counted by value and
       ordered per column; the middle ranks are found among them.
    A column whose bracket misses its middle (never with the sketch's guarantee) is ranked whole.
    The median of an even count is the mean of the two middle values; a column without values has
    none. Nulls and NaN-free doubles only: values are cast to double.
    """
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, median double")
    x = {c: F.col(c).cast("double") for c in cols}
    step = 2.0 / accuracy
    first = df.agg(
        *[F.count(x[c]).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.percentile_approx(x[c], [max(0.0, 0.5 - step), min(1.0, 0.5 + step)], accuracy).alias(f"q{i}") for i, c in enumerate(cols)],
    ).first()
    bounds = {c: (first[f"q{i}"] or [None, None]) for i, c in enumerate(cols)}
    live = [c for c in cols if first[f"n{cols.index(c)}"] and bounds[c][0] is not None]
    if not live:
        return spark.createDataFrame([(c, None) for c in cols], "column string, median double")
    below = df.agg(*[F.count_if(x[c] < F.lit(bounds[c][0])).alias(c) for c in live]).first()
    inside = F.filter(
        F.array(*[F.struct(F.lit(c).alias("column"), F.when(x[c].between(bounds[c][0], bounds[c][1]), x[c]).alias("value")) for c in live]),
        lambda e: e["value"].isNotNull(),
    )
    counted = df.select(F.inline(inside)).groupBy("column", "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("column").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranks = spark.createDataFrame(
        [(c, first[f"n{cols.index(c)}"], below[c]) for c in live], "column string, total long, below long")
    low = F.floor((F.col("total") + 1) / 2) - F.col("below")
    high = F.floor((F.col("total") + 2) / 2) - F.col("below")
    ranked = counted.withColumn("upto", upto).join(F.broadcast(ranks), "column")  # one row a column

    def covers(rank):
        return (F.col("upto") - F.col("n") < rank) & (F.col("upto") >= rank)

    found = ranked.groupBy("column").agg(
        ((F.max(F.when(covers(low), F.col("value"))) + F.max(F.when(covers(high), F.col("value")))) / 2).alias("median"),
        F.max("upto").alias("inside"), F.first(low).alias("low"), F.first(high).alias("high"),
    ).collect()  # one row a column
    exact = {r["column"]: r["median"] for r in found if r["low"] >= 1 and r["high"] <= r["inside"] and r["median"] is not None}
    rest = [c for c in live if c not in exact]
    if rest:
        for r in exact_medians(_counts(df, rest, "double"), "column", "value", "n").collect():
            exact[r["column"]] = r["median"]
    return spark.createDataFrame([(c, exact.get(c)) for c in cols], "column string, median double")


def column_medians(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """(column, median). The exact form selects inside sketched brackets; the other sketches."""
    if exact:
        return bracketed_medians(df, cols)
    sketch = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 100000).alias(c) for c in cols])
    lines = [F.struct(F.lit(c).alias("column"), F.col(c).alias("median")) for c in cols]
    return sketch.select(F.inline(F.array(*lines)))


def column_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column, median, mode): medians of numbers, modes of text, lowest value on ties."""
    numbers, texts = numeric_columns(df), text_columns(df)
    medians = column_medians(df, numbers, exact).select(
        "column", "median", F.lit(None).cast("string").alias("mode")
    )
    if not texts:
        return medians
    return medians.unionByName(
        column_modes(df, texts).select("column", F.lit(None).cast("double").alias("median"), "mode")
    )


def column_modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, mode): the most frequent text, lowest on ties."""
    best = F.min_by("value", F.struct((-F.col("n")).alias("less"), "value"))
    return _counts(df, cols, "string").groupBy("column").agg(best.alias("mode"))


def with_lookup(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Add `__known`: a struct of the maps `medians` and `modes`, column name to value.

    `stats` has one row per column of a table, so the maps are small; one scalar subquery
    reads them once for all columns.
    """
    if "mode" not in stats.columns:
        stats = stats.withColumn("mode", F.lit(None).cast("string"))

    def entries(field: str):
        pair = F.struct(F.col("column"), F.col(field))
        return F.map_from_entries(F.collect_list(F.when(F.col(field).isNotNull(), pair)))

    maps = F.struct(entries("median").alias("medians"), entries("mode").alias("modes"))
    return df.withColumn("__known", stats.agg(maps).scalar())


def null_summary(df: DataFrame, n: int = 10) -> DataFrame:
    """The columns with the most nulls, from one pass: column, nulls, pct."""
    counts = df.agg(
        F.count("*").alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    lines = [F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns]
    return (
        counts.select("__rows", F.inline(F.array(*lines)))
        .filter(F.col("nulls") > 0)
        .select("column", "nulls", (F.col("nulls") / F.col("__rows") * 100).alias("pct"))
        .orderBy(F.col("nulls").desc(), "column")
        .limit(n)
    )


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: kind, nulls, distinct values."""
    numbers = set(numeric_columns(df))
    cols = [c for c in df.columns]
    distinct = (
        _counts(df, cols, "string").groupBy("column").agg(F.count("*").alias("distinct"))
        if exact
        else None
    )
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    lines = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit("numeric" if c in numbers else "text").alias("kind"),
            F.col(c).alias("nulls"),
        )
        for c in cols
    ]
    base = nulls.select(F.inline(F.array(*lines)))
    if distinct is None:
        sketch = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
        distinct = sketch.select(
            F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("distinct")) for c in cols]))
        )
    return base.join(distinct, "column", "left").select(
        "column", "kind", "nulls", F.coalesce("distinct", F.lit(0)).alias("distinct")
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    total = df.agg(F.count("*").alias("n")).scalar()
    return (
        df.groupBy(label).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / total)
    )


def anova_f(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    """One-way F of each column between the two classes, with its rank, from one aggregate.

    The class variances come from Spark's one-pass central moments, not from sums of
    squares, so large means do not cancel.
    """
    def of(c: str, k: int):
        return F.when(F.col(label) == k, F.col(c).cast("double"))

    moments = df.agg(
        *[
            agg(of(c, k)).alias(f"{name}{k}_{i}")
            for i, c in enumerate(cols)
            for k in (0, 1)
            for name, agg in (("n", F.count), ("m", F.avg), ("v", F.var_pop))
        ]
    )

    def f_value(i: int):
        n0, n1, m0, m1 = (F.col(f"{x}_{i}") for x in ("n0", "n1", "m0", "m1"))
        within = n0 * F.col(f"v0_{i}") + n1 * F.col(f"v1_{i}")
        between = n0 * n1 / (n0 + n1) * (m0 - m1) * (m0 - m1)
        return F.try_divide(between * (n0 + n1 - 2), within)

    lines = [F.struct(F.lit(c).alias("feature"), f_value(i).alias("f")) for i, c in enumerate(cols)]
    # One row per column reaches the ranking.
    ranked = moments.select(F.inline(F.array(*lines)))
    from pyspark.sql import Window

    order = Window.partitionBy(F.lit(0)).orderBy(F.col("f").desc_nulls_last(), "feature")
    return ranked.withColumn("rank", F.row_number().over(order))


def class_mean_ratio(df: DataFrame, col: str, label: str) -> DataFrame:
    means = df.agg(
        F.avg(F.when(F.col(label) == 1, F.col(col))).alias("mean_1"),
        F.avg(F.when(F.col(label) == 0, F.col(col))).alias("mean_0"),
    )
    return means.withColumn("ratio", F.try_divide("mean_1", "mean_0"))


def dataset_report(df: DataFrame) -> DataFrame:
    """Rows, fraud and rate by source and in total, with the shift against the anchor."""
    lines = df.rollup("data_source").agg(
        F.count("*").alias("rows"), F.sum("is_fraud").cast("long").alias("fraud")
    )
    named = lines.select(
        F.coalesce("data_source", F.lit("total")).alias("source"),
        "rows",
        "fraud",
        (F.col("fraud") / F.col("rows") * 100).alias("rate"),
    )
    from pyspark.sql import Window

    # Three rows reach this window.
    every = Window.partitionBy(F.lit(0))
    anchor = F.max(F.when(F.col("source") == "anchor", F.col("rate"))).over(every)
    return named.withColumn("rate_shift", F.col("rate") - anchor)
