"""Text and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32


def hash32(*parts: Column | str | int) -> Column:
    """A 32-bit hash of the parts: the same for a row however the data is partitioned."""
    cols = [F.lit(str(p)) if isinstance(p, int) else p for p in parts]
    cols = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    number = F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long")
    return F.coalesce(number, F.lit(0).cast("long"))  # never null


def hash_unit(*parts: Column | str | int) -> Column:
    """A uniform number in [0, 1) from the parts."""
    return hash32(*parts) / F.lit(float(HASH_RANGE))


def clean_key(name: str | Column) -> Column:
    """Lower case without surrounding white space: the form payees are remembered in."""
    name = F.col(name) if isinstance(name, str) else name
    return F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))


def fixed_point(value: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", value)


def format_inr(amount: Column) -> Column:
    """Rupees with lakh grouping: 1234567.5 becomes ₹12,34,567.50."""
    digits = fixed_point(F.abs(amount), 2)
    grouped = F.regexp_replace(digits, r"(?<=\d)(?=(\d{2})*\d{3}\.)", ",")
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("₹"), grouped)


def payment_app(sender: str | Column) -> Column:
    sender = F.upper(F.col(sender) if isinstance(sender, str) else sender)
    return (
        F.when(sender.contains("GPAY"), "GPay")
        .when(sender.contains("PHONEPE"), "PhonePe")
        .when(sender.contains("PAYTM"), "Paytm")
        .otherwise("GPay")
    )
