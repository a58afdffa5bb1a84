"""Splits, imputation and encoding fitted on the training part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ordered import first_by_hash
from ledgerlens.operators.stats import column_stats, numeric_columns, text_columns, with_lookup

UNKNOWN, MISSING = -1, -2


def stratified_split(
    df: DataFrame, label: str, key: str, fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add `is_test`: exactly round(fraction x class size) rows of each class."""
    targets = df.groupBy(label).agg(
        F.round(F.count("*") * F.lit(fraction)).cast("long").alias("target")
    )
    return first_by_hash(df, key, label, targets, seed).withColumnRenamed("chosen", "is_test")


def impute(df: DataFrame, stats: DataFrame, keep: tuple[str, ...] = ("txn_id",)) -> DataFrame:
    """Fill nulls with the (column, median, mode) statistics of another frame.

    Columns without statistics keep their nulls; the keys in `keep` are not touched. Whole numbers widen to double, as a
    median can lie between two of them.
    """
    filled = {c: F.coalesce(c, F.try_element_at("__known.modes", F.lit(c))) for c in text_columns(df) if c not in keep}
    for c in [c for c in numeric_columns(df) if c not in keep]:
        filled[c] = F.coalesce(F.col(c).cast("double"), F.try_element_at("__known.medians", F.lit(c)))
    return with_lookup(df, stats).withColumns(filled).drop("__known")


def impute_from_train(split: DataFrame, exact: bool = True) -> DataFrame:
    """Impute train and test rows alike with statistics of the train rows only."""
    train = split.filter(~F.col("is_test")).drop("is_test")
    return impute(split, column_stats(train, exact))


def fit_ordinals(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """The categories of each column in alphabetical order; their place is their code.

    Encodable columns are closed vocabularies, so the lists are short.
    """
    from pyspark.ml.feature import StringIndexer

    model = StringIndexer(
        inputCols=cols,
        outputCols=[f"__{c}" for c in cols],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    ).fit(df.select(*cols))
    return {c: list(labels) for c, labels in zip(cols, model.labelsArray)}


def encode(df: DataFrame, ordinals: dict[str, list[str]]) -> DataFrame:
    """Replace text by its code; unseen text is -1 and missing text -2."""
    coded = {}
    for c, labels in ordinals.items():
        place = F.array_position(F.array(*[F.lit(x) for x in labels]).cast("array<string>"), F.col(c))
        coded[c] = (
            F.when(F.col(c).isNull(), MISSING)
            .when(place == 0, UNKNOWN)
            .otherwise(place - 1)
            .cast("int")
        )
    return df.withColumns(coded)
