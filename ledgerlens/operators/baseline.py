"""Each user's own trailing behaviour: amount and hour deviations, velocity."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.trailing import Frame, with_trailing

# What a cold start is given, and the least deviations.
NEUTRAL_HOUR, NEUTRAL_HOUR_STD = 12.0, 6.0
MIN_AMOUNT_STD, MIN_HOUR_STD = 1.0, 0.5


def with_baseline(
    df: DataFrame,
    user: str = "user_id",
    ts: str = "ts",
    amount: str = "amount",
    hour: str = "hour_of_day",
    days: int = 90,
    min_rows: int = 5,
) -> DataFrame:
    """Add n, mean, std, mean_hour, std_hour, is_cold_start, z_amount and z_hour.

    The baseline of a row is the user's strictly earlier rows of the last `days` days;
    deviations are those of the population, with floors. Fewer than `min_rows` rows give
    a cold start with both scores 0.

    Amounts are summed as differences from a middle amount of the user (any value near the
    median does), so that large amounts keep the digits of their deviation, and one outlier
    does not move the others away from zero.
    """
    raw, h = F.col(amount).cast("double"), F.col(hour).cast("double")
    middle = df.groupBy(F.col(user).alias("__user")).agg(
        F.percentile_approx(F.when(~F.isnan(raw), raw), 0.5, F.lit(100)).alias("__centre")
    )
    centred = (
        df.join(middle, F.col(user).eqNullSafe(F.col("__user")), "left")
        .drop("__user")
        .withColumn("__centre", F.coalesce("__centre", F.lit(0.0)))
    )
    x = raw - F.col("__centre")
    summed = with_trailing(
        centred,
        [user],
        ts,
        [
            Frame(
                timedelta(days=days),
                {
                    "__n": F.when(F.col(amount).isNotNull(), 1),
                    "__x": x,
                    "__xx": x * x,
                    "__hn": F.when(F.col(hour).isNotNull(), 1),
                    "__h": h,
                    "__hh": h * h,
                },
            )
        ],
    )
    return finish_baseline(summed, amount, hour, min_rows)


def finish_baseline(summed: DataFrame, amount: str, hour: str, min_rows: int) -> DataFrame:
    """From counts and sums, of amounts less `__centre`, to the deviation columns."""
    def moments(n: str, s: str, ss: str, floor: float):
        mean = F.try_divide(s, n)
        var = F.try_divide(ss, n) - mean * mean
        return mean, F.greatest(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(floor))

    mean, std = moments("__n", "__x", "__xx", MIN_AMOUNT_STD)
    mean_hour, std_hour = moments("__hn", "__h", "__hh", MIN_HOUR_STD)
    cold = F.col("__n") < min_rows
    few_hours = cold | (F.col("__hn") < min_rows)
    return (
        summed.withColumns(
            {
                "n": F.col("__n").cast("long"),
                "is_cold_start": cold,
                "mean": F.when(cold, 0.0).otherwise(F.col("__centre") + mean),
                "std": F.when(cold, MIN_AMOUNT_STD).otherwise(std),
                "mean_hour": F.when(few_hours, NEUTRAL_HOUR).otherwise(mean_hour),
                "std_hour": F.when(few_hours, NEUTRAL_HOUR_STD).otherwise(std_hour),
            }
        )
        .withColumns(
            {
                "z_amount": F.when(F.col("is_cold_start"), 0.0).otherwise(
                    (F.col(amount) - F.col("__centre") - mean) / F.col("std")
                ),
                "z_hour": F.when(F.col("is_cold_start"), 0.0).otherwise(
                    F.abs(F.col(hour) - F.col("mean_hour")) / F.col("std_hour")
                ),
            }
        )
        .drop("__centre", "__n", "__x", "__xx", "__hn", "__h", "__hh")
    )


def with_velocity(
    df: DataFrame,
    user: str = "user_id",
    ts: str = "ts",
    payee: str = "payee",
    amount: str = "amount",
    failed: str = "failed",
) -> DataFrame:
    """Add time_since_last_txn_min, transaction_velocity (earlier rows of the last hour),
    failed_attempts_last_24h and recurring_payment_flag (same user, payee and amount
    25 to 35 days earlier)."""
    recent = with_trailing(
        df,
        [user],
        ts,
        [
            Frame(timedelta(hours=1), {"transaction_velocity": F.lit(1)}),
            Frame(timedelta(hours=24), {"failed_attempts_last_24h": F.col(failed)}),
        ],
        previous="__previous",
    )
    minutes = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("__previous").cast("timestamp"))) / 60e6
    repeated = with_trailing(
        recent.withColumn("time_since_last_txn_min", minutes).drop("__previous"),
        [user, payee, amount],
        ts,
        [Frame(timedelta(days=35), {"__repeats": F.lit(1)}, end=timedelta(days=25))],
        slice_length=timedelta(days=1),
    )
    return repeated.withColumn("recurring_payment_flag", (F.col("__repeats") > 0).cast("int")).drop(
        "__repeats"
    )
