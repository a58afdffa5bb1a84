"""Spending categories of payees: remembered payees first, keyword rules next, else ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import fixed
from ledgerlens.functions.text import clean_key

Rules = list[tuple[str, str, float]]


def keyword_match(payee: str | Column, rules: Rules | None = None, whole_words: bool = False) -> Column:
    """Struct (category, confidence) of the first rule found in the payee, or null.

    The rules are a short ordered list, so they fold into one `CASE` instead of a join.
    """
    rules = fixed.KEYWORD_RULES if rules is None else rules
    text = F.lower(F.col(payee) if isinstance(payee, str) else payee)
    found = F.lit(None)
    for keyword, category, confidence in reversed(rules):
        hit = text.rlike(rf"\b{keyword}\b") if whole_words else text.contains(keyword)
        answer = F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"))
        found = F.when(hit, answer).otherwise(found)
    return found


def keyword_category(df: DataFrame, payee: str = "payee", rules: Rules | None = None) -> DataFrame:
    match = keyword_match(payee, rules)
    return df.select(
        "*", match["category"].alias("category"), match["confidence"].alias("confidence")
    )


def resolve_category(
    txn: DataFrame,
    cache: DataFrame,
    rules: Rules | None = None,
    min_confidence: float = fixed.KEYWORD_MIN_CONFIDENCE,
) -> DataFrame:
    """Add category, source, confidence and requires_prompt.

    `cache` holds one row per clean payee name. Spark broadcasts it when its measured
    size allows and otherwise joins by shuffle with skew handling.
    """
    remembered = cache.select(
        F.col("payee_name").alias("__payee"), F.col("category").alias("__cached")
    )
    rule = keyword_match("payee", rules)
    sure = rule["confidence"] >= min_confidence
    cached = F.col("__cached").isNotNull()
    return (
        txn.withColumn("__payee", clean_key("payee"))
        .join(remembered, "__payee", "left")
        .withColumns(
            {
                "category": F.when(cached, F.col("__cached"))
                .when(sure, rule["category"])
                .otherwise("Uncategorized"),
                "source": F.when(cached, "CACHE").when(sure, "NLP").otherwise("PENDING_USER"),
                "confidence": F.when(~cached, rule["confidence"]),
                "requires_prompt": ~cached & ~F.coalesce(sure, F.lit(False)),
            }
        )
        .drop("__payee", "__cached")
    )


def unresolved_payees(txn: DataFrame, cache: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Distinct clean payees neither remembered nor known to a rule.

    Payees are made distinct before the join, so a payee with very many rows is one row.
    """
    names = txn.select(clean_key("payee").alias("payee_name")).distinct()
    return names.filter(keyword_match("payee_name", rules).isNull()).join(
        cache.select("payee_name"), "payee_name", "left_anti"
    )
