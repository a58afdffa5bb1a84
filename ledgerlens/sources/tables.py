"""The four offline tables and the message source, read with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Columns and types of the input tables.
SCHEMAS = {
    "transactions": """
        transaction_id string, user_id string, receiver_id string, timestamp string, date string,
        status string, user_kyc_status string, receiver_type string, transaction_type string,
        payment_app string, device_type string, amount double, hour_of_day int, day_of_week string,
        is_weekend int, is_night_transaction int, time_since_last_txn_min double,
        transaction_velocity double, amount_deviation_score double, failed_attempts_last_24h double,
        recurring_payment_flag int, transaction_frequency_score double, new_device_flag int,
        ip_location_mismatch int, user_city_tier string, user_avg_monthly_txn double,
        user_avg_txn_value double, user_loyalty_score double, balance_after_transaction double,
        is_fraud int""",
    "users": """
        user_id string, age_group string, city string, city_tier string, account_age_days double,
        linked_bank_count double, avg_monthly_transactions double, avg_transaction_value double,
        preferred_app string, preferred_device string, is_high_risk_user int""",
    "merchants": """
        merchant_id string, merchant_name string, merchant_category string, merchant_size string,
        city string, city_tier string, avg_daily_transactions double, is_registered int, rating double""",
    "supplement": """
        transaction_id long, user_id long, amount double, transaction_type string,
        merchant_category string, country string, hour int, device_risk_score double,
        ip_risk_score double, is_fraud int""",
    "messages": "msg_id long, user_id long, ts timestamp_ntz, sender string, body string",
}


def load(spark: SparkSession, folder: str, name: str, form: str = "parquet") -> DataFrame:
    """Read a table from `folder`/`name` as Parquet or as CSV with a header row.

    CSV columns are matched to the schema by header, so files may order or extend them.
    """
    if form == "csv":
        rows = spark.read.option("header", True).csv(f"{folder}/{name}")
        declared = spark.createDataFrame([], SCHEMAS[name]).schema.fields
        return rows.select(
            *[rows[f.name].try_cast(f.dataType).alias(f.name) for f in declared if f.name in rows.columns]
        )
    return spark.read.schema(SCHEMAS[name]).format(form).load(f"{folder}/{name}")


def message_stream(
    spark: SparkSession, folder: str, form: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Messages as files arrive; another connector only has to give the same columns."""
    reader = spark.readStream.schema(SCHEMAS["messages"]).format(form)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(f"{folder}/messages")
