"""Keyed state from change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import clean_key


def latest_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The last row of each key in `order`.

    Spark keeps only the best row per key before it shuffles (window group limit), so a
    key with very many rows sends one row per task.
    """
    last_first = [(F.col(c) if isinstance(c, str) else c).desc() for c in order]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*last_first))
    return df.withColumn("__n", number).filter(F.col("__n") == 1).drop("__n")


def current_state(log: DataFrame, keys: list[str], seq: str = "seq", op: str = "op") -> DataFrame:
    """Replay inserts, replacements and deletes: the last change of a key decides."""
    return latest_per_key(log, keys, [seq]).filter(F.col(op) != "delete").drop(op)


def apply_corrections(
    ledger: DataFrame, payee_log: DataFrame, corrections: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """A user's corrections (txn_id, payee, category, seq): the one transaction, and the log
    of remembered payees, which gains a user-labelled change for each correction."""
    last = latest_per_key(corrections, ["txn_id"], ["seq"]).select(
        "txn_id", F.col("category").alias("__category")
    )
    fixed_rows = (
        ledger.join(last, "txn_id", "left")
        .withColumn("category", F.coalesce("__category", "category"))
        .drop("__category")
    )
    changes = corrections.select(
        clean_key("payee").alias("payee_name"),
        "category",
        F.lit("user").alias("source"),
        F.lit(None).cast("double").alias("confidence"),
        "seq",
        F.lit("upsert").alias("op"),
    )
    return fixed_rows, payee_log.unionByName(changes)


def state_counts(payees: DataFrame, budgets: DataFrame, goals: DataFrame) -> DataFrame:
    """User-labelled payees, budgets and active goals as one row."""
    one = lambda df, c, name: df.agg(c.alias(name)).scalar().alias(name)
    return payees.agg(F.count_if(F.col("source") == "user").alias("user_payees")).select(
        "user_payees",
        one(budgets, F.count("*"), "budgets"),
        one(goals, F.count_if(~F.col("is_completed")), "active_goals"),
    )
