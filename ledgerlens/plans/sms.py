"""Bank messages: gates, extraction, quarantine. All row-wise built-ins, so the same
functions serve batch frames and streams without a shuffle.

Message columns: sender, body, ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import fixed
from ledgerlens.functions.times import micros


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def gate(sms: DataFrame) -> DataFrame:
    """Add `gate1` (sender looks like a bank's) and `gate2` (body has a keyword)."""
    return sms.withColumns(
        {
            "gate1": trimmed(F.col("sender")).rlike(fixed.SENDER_PATTERN),
            "gate2": F.col("body").rlike(fixed.KEYWORD_PATTERN),
        }
    )


def passed(sms: DataFrame) -> DataFrame:
    return gate(sms).filter(F.col("gate1") & F.col("gate2")).drop("gate1", "gate2")


def _first_hit(group: int) -> Column:
    hits = F.regexp_extract_all("body", F.lit(fixed.EXTRACT_PATTERN), F.lit(group))
    return F.get(F.filter(hits, lambda hit: hit != ""), F.lit(0))


def extract(sms: DataFrame) -> DataFrame:
    """Add amount, payee, txn_id and date; `amount` is null where none can be read."""
    millis = F.floor(micros("ts") / 1000).cast("string")
    return sms.withColumns(
        {
            "amount": F.regexp_replace(_first_hit(1), ",", "").try_cast("double"),
            "payee": F.coalesce(trimmed(_first_hit(2)), F.lit("Unknown Payee")),
            "txn_id": F.coalesce(trimmed(_first_hit(3)), F.concat(F.lit("TXN_"), millis)),
            "date": F.coalesce(trimmed(_first_hit(4)), F.lit("")),
        }
    )


def split_quarantine(sms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gate-passing messages with an amount, and those without, which get a `reason`."""
    read = extract(passed(sms))
    parsed = read.filter(F.col("amount").isNotNull())
    held = read.filter(F.col("amount").isNull())
    kept = [c for c in sms.columns]
    return parsed, held.select(*kept, F.lit("amount missing").alias("reason"))


def extract_lenient(sms: DataFrame) -> DataFrame:
    """The forgiving profile: five keywords, a default amount, payee up to a stop word."""
    amount = F.regexp_replace(F.regexp_extract("body", fixed.LENIENT_AMOUNT_PATTERN, 1), ",", "")
    payee = trimmed(F.regexp_extract("body", fixed.LENIENT_PAYEE_PATTERN, 1))
    found = F.regexp_extract("body", fixed.LENIENT_PAYEE_PATTERN, 0) != ""
    return sms.filter(F.lower("body").rlike("|".join(fixed.LENIENT_KEYWORDS))).select(
        "*",
        F.when(F.regexp_extract("body", fixed.LENIENT_AMOUNT_PATTERN, 0) == "", fixed.LENIENT_AMOUNT)
        .otherwise(amount.try_cast("double"))
        .alias("amount"),
        F.when(found, payee).otherwise("Unknown Merchant").alias("payee"),
    )
