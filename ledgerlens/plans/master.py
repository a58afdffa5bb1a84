"""The training table: enrich transactions with profiles, bridge a second source, stack."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import fixed
from ledgerlens.functions.times import is_night
from ledgerlens.operators.stats import column_medians, column_stats, with_lookup
from ledgerlens.session import written

IMPUTED = ["time_since_last_txn_min", "transaction_velocity", "amount_deviation_score"]
COLUMN_ROLES = {
    "identifier": ["transaction_id", "user_id", "receiver_id"],
    "temporal": ["timestamp", "date"],
    "metadata": ["data_source"],
    "target": ["is_fraud"],
}


def map_vocab(col: str | Column, mapping: dict[str, object]) -> Column:
    """Look a value up in a closed vocabulary; anything else becomes null."""
    col = F.col(col) if isinstance(col, str) else col
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.when(col.isNotNull(), F.try_element_at(pairs, col))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def parse_times(df: DataFrame, *cols: str) -> DataFrame:
    """Text to timestamps; unreadable text becomes null."""
    return df.withColumns({c: F.try_to_timestamp(F.col(c)).cast("timestamp_ntz") for c in cols})


def flag_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "txn_success_flag": flag(F.col("status") == "Success"),
            "kyc_verified_flag": flag(F.col("user_kyc_status") == "Verified"),
        }
    )


def fill_with_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fill nulls with each column's exact median."""
    known = with_lookup(df, column_medians(df, cols))
    return known.withColumns(
        {c: F.coalesce(F.col(c), F.try_element_at("__known.medians", F.lit(c))) for c in cols}
    ).drop("__known")


def enrich_users(txn: DataFrame, users: DataFrame) -> DataFrame:
    """Left join of user profiles under their prefixed names.

    No broadcast hint: the user table grows with the data. Spark measures it and picks
    broadcast or a shuffle join, splitting users with very many rows (AQE skew join).
    """
    profile = users.select(
        "user_id", *[F.col(c).alias(name) for c, name in fixed.USER_COLUMNS.items() if c in users.columns]
    )
    return txn.join(profile, "user_id", "left")


def enrich_merchants(txn: DataFrame, merchants: DataFrame) -> DataFrame:
    """Left join on the receiver; person-to-person rows get fixed defaults, rating stays null."""
    profile = merchants.select(
        F.col("merchant_id").alias("__merchant"),
        *[F.col(c).alias(name) for c, name in fixed.MERCHANT_COLUMNS.items()],
    )
    joined = txn.join(profile, F.col("receiver_id") == F.col("__merchant"), "left").drop("__merchant")
    person = F.coalesce(F.col("receiver_type") == "User", F.lit(False))
    return joined.withColumns(
        {c: F.when(person, F.lit(v)).otherwise(F.col(c)) for c, v in fixed.P2P_DEFAULTS.items()}
    )


#: Anchor columns that the supplement has itself; the others are filled from the anchor.
BRIDGED = [
    "transaction_id", "user_id", "receiver_id", "receiver_type", "data_source", "amount", "is_fraud", "hour_of_day",
    "transaction_type", "mrc_category", "new_device_flag", "ip_location_mismatch", "is_night_transaction",
]


def bridge_stats(anchor: DataFrame) -> DataFrame:
    """The statistics that `bridge` fills columns with: of every column it does not find in the supplement."""
    return column_stats(anchor.select(*[c for c in anchor.columns if c not in BRIDGED]))


def bridge(supplement: DataFrame, anchor: DataFrame, stats: DataFrame) -> DataFrame:
    """Give the supplement the anchor's columns, then its own two risk scores.

    `stats` has columns column, median, mode (see `column_stats`); columns only the
    anchor has are filled with the anchor's mode (text) or median (numbers).
    """
    own = {
        "transaction_id": F.concat(F.lit("SYN_"), F.col("transaction_id").cast("string")),
        "user_id": F.concat(F.lit("SYN_USR_"), F.col("user_id").cast("string")),
        "receiver_id": F.lit("SYN_MRC_UNKNOWN"),
        "receiver_type": F.lit("Merchant"),
        "data_source": F.lit("supplement"),
        "amount": F.col("amount"),
        "is_fraud": F.col("is_fraud"),
        "hour_of_day": F.col("hour"),
        "transaction_type": map_vocab("transaction_type", fixed.TYPE_MAP),
        "mrc_category": F.col("merchant_category"),
        "new_device_flag": flag(F.col("device_risk_score") > fixed.RISK_CUT),
        "ip_location_mismatch": flag(F.col("ip_risk_score") > fixed.RISK_CUT),
        "is_night_transaction": is_night(F.col("hour")),
    }
    plan = []
    for f in anchor.schema.fields:
        if f.name in own:
            value = own[f.name]
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            value = F.lit(None)
        elif isinstance(f.dataType, T.StringType):
            value = F.coalesce(F.try_element_at("__known.modes", F.lit(f.name)), F.lit("Unknown"))
        else:
            value = F.try_element_at("__known.medians", F.lit(f.name))
        # A median can lie between two integers, so whole-number columns widen here.
        wide = isinstance(f.dataType, (T.IntegerType, T.LongType)) and f.name not in own
        plan.append(value.cast("double" if wide else f.dataType).alias(f.name))
    return with_lookup(supplement, stats).select(*plan, "device_risk_score", "ip_risk_score")


def align(df: DataFrame, features: list[str]) -> DataFrame:
    """Exactly `features`, in that order; absent ones are null, others are dropped."""
    return df.select(
        [F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in features]
    )


def stack(anchor: DataFrame, supplement: DataFrame) -> DataFrame:
    """Union by name; columns a side lacks are null."""
    return anchor.unionByName(supplement, allowMissingColumns=True)


def hour_deviation(df: DataFrame, out: str = "transaction_frequency_score") -> DataFrame:
    """|hour - the user's mean hour| / the user's sample deviation (6 for one row, at least 0.5).

    The per-user statistics are aggregated with map-side combine and joined back, so a
    user with very many rows is split by the skew join instead of filling one window.
    """
    stats = df.groupBy("user_id").agg(
        F.avg("hour_of_day").alias("__mean"),
        F.greatest(F.coalesce(F.stddev_samp("hour_of_day"), F.lit(6.0)), F.lit(0.5)).alias("__std"),
    )
    score = F.abs(F.col("hour_of_day") - F.col("__mean")) / F.col("__std")
    return df.join(stats, "user_id", "left").withColumn(out, score).drop("__mean", "__std")


def build_anchor(txn: DataFrame, users: DataFrame, merchants: DataFrame) -> DataFrame:
    ready = fill_with_medians(flag_columns(parse_times(txn, "timestamp", "date")), IMPUTED)
    tagged = ready.withColumn("data_source", F.lit("anchor"))
    return enrich_merchants(enrich_users(tagged, users), merchants)


def build_master(
    txn: DataFrame, users: DataFrame, merchants: DataFrame, supplement: DataFrame
) -> DataFrame:
    """The whole training table: 50 columns, no rows on the driver. The anchor is written once on the way."""
    # The statistics scan the anchor several times: its joins are made once.
    anchor = written(build_anchor(txn, users, merchants), "anchor")
    bridged = bridge(supplement, anchor, bridge_stats(anchor))
    master = stack(anchor, bridged).withColumns(
        {
            "is_fraud": F.col("is_fraud").cast("int"),
            "day_of_week": map_vocab("day_of_week", fixed.WEEKDAY_MAP),
            "user_city_tier": map_vocab("user_city_tier", fixed.TIER_MAP),
            "usr_home_city_tier": map_vocab("usr_home_city_tier", fixed.TIER_MAP),
        }
    )
    return hour_deviation(master)


def write_master(df: DataFrame, path: str) -> None:
    df.write.partitionBy("data_source").mode("errorifexists").parquet(path)


def prune(df: DataFrame) -> DataFrame:
    """Drop the columns that must not reach a model."""
    return df.drop(*fixed.DROPPED_BEFORE_TRAINING)


def overlap_audit(sources: dict[str, DataFrame], key: str, max_rate: float = 0.5) -> DataFrame:
    """Share of keys each pair of sources has in common, fraud rates, and pre-balanced ones.

    All pairs come from one grouping of the keys: each key carries a flag per source.
    """
    names = list(sources)
    tagged = None
    for name, df in sources.items():
        part = df.select(F.col(key).alias("key"), F.lit(name).alias("source"), "is_fraud")
        tagged = part if tagged is None else tagged.unionByName(part)
    per_key = tagged.groupBy("key").agg(
        *[F.count_if(F.col("source") == n).alias(f"n_{n}") for n in names],
        *[
            F.coalesce(F.sum(F.when(F.col("source") == n, F.col("is_fraud"))), F.lit(0)).alias(f"f_{n}")
            for n in names
        ],
    )
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    has = {n: F.col(f"n_{n}") > 0 for n in names}
    totals = per_key.agg(
        *[F.count_if(has[a] & has[b]).alias(f"c_{a}_{b}") for a, b in pairs],
        *[F.count_if(has[n]).alias(f"k_{n}") for n in names],
        *[(F.sum(f"f_{n}") / F.sum(f"n_{n}")).alias(f"r_{n}") for n in names],
    )
    lines = [
        F.struct(
            F.lit(a).alias("a"),
            F.lit(b).alias("b"),
            F.col(f"c_{a}_{b}").alias("common"),
            (F.col(f"c_{a}_{b}") / F.least(f"k_{a}", f"k_{b}")).alias("share"),
            F.col(f"r_{a}").alias("fraud_rate_a"),
            F.col(f"r_{b}").alias("fraud_rate_b"),
            ((F.col(f"r_{a}") >= max_rate) | (F.col(f"r_{b}") >= max_rate)).alias("rejected"),
        )
        for a, b in pairs
    ]
    return totals.select(F.inline(F.array(*lines)))
