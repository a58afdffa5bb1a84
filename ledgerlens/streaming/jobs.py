"""Streaming forms of the batch operators. The column logic is the batch modules' own."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.text import clean_key
from ledgerlens.operators.state import latest_per_key
from ledgerlens.plans import finance, sms
from ledgerlens.plans.categorize import keyword_match
from ledgerlens.plans.scoring import ensemble, request_features
from ledgerlens.streaming.baseline import baseline_stream

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER, PARTITIONS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"


# --- transformations ------------------------------------------------------------------

def sms_stream(messages: DataFrame) -> DataFrame:
    """Gate-passing messages with their fields; `reason` is set on those to quarantine."""
    return sms.extract(sms.passed(messages)).withColumn(
        "reason", F.when(F.col("amount").isNull(), "amount missing")
    )


def verdict_stream(txn: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Score each row against the user's own earlier history."""
    return ensemble(request_features(baseline_stream(txn)), threshold)


def alert_stream(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(F.col("alert_level").isin("medium", "high"))


def budget_stream(ledger: DataFrame, budgets: DataFrame, as_of: datetime) -> DataFrame:
    """This month's spend per category, sent again whenever it changes, against its budget."""
    return finance.budget_progress(ledger, budgets, as_of)


def prompt_stream(txn: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows whose payee is neither remembered nor known to a rule."""
    known = cache.select(F.col("payee_name").alias("__known"))
    named = txn.withColumn("payee_name", clean_key("payee"))
    return (
        named.join(known, F.col("payee_name") == F.col("__known"), "left")
        .filter(F.col("__known").isNull() & keyword_match("payee").isNull())
        .drop("__known")
    )


def dedup_stream(txn: DataFrame, delay: str = "1 day", key: str = "txn_id", ts: str = "ts") -> DataFrame:
    """The first row of each id; repeats within `delay` are dropped."""
    return _timed(txn, ts, delay).dropDuplicatesWithinWatermark([key])


def weekly_stream(txn: DataFrame, delay: str = "1 day", ts: str = "ts") -> DataFrame:
    """Spend per user and week; a week is sent once no row can still arrive for it."""
    return (
        _timed(txn, ts, delay)
        .groupBy("user_id", F.window(ts, "7 days"))
        .agg(F.sum("amount").alias("total"), F.count("*").alias("txn_count"))
        .select(
            "user_id",
            F.col("window.start").cast("timestamp_ntz").alias("week_start"),
            "total",
            "txn_count",
        )
    )


def _timed(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


# --- running --------------------------------------------------------------------------

class _stream_settings:
    """Keep state in RocksDB, over the given number of partitions or else the session's."""

    def __init__(self, spark: SparkSession, partitions: int | None = None):
        self.spark, self.partitions = spark, partitions

    def __enter__(self):
        conf = self.spark.conf
        self.before = {k: conf.get(k, None) for k in (PROVIDER, PARTITIONS)}
        conf.set(PROVIDER, ROCKSDB)
        if self.partitions is not None:
            conf.set(PARTITIONS, str(self.partitions))

    def __exit__(self, *_):
        for k, value in self.before.items():
            if value is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, value)


def run_available(
    stream: DataFrame,
    folder: str,
    mode: str = "append",
    each_batch: Callable[[DataFrame, int], None] | None = None,
    name: str = "out",
    state_partitions: int | None = None,
) -> list[dict]:
    """Process what is there and stop; progress is kept in `folder`, so a rerun continues.

    Batches go to Parquet under `folder`/`name`. In update mode each batch is a folder
    of its own, written over when a batch is replayed. `state_partitions` is frozen in the
    checkpoint by the first run: set it for the size that the state will reach.
    """
    def write_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/{name}-checkpoint")
    if each_batch is not None:
        writer = writer.foreachBatch(each_batch)
    elif mode == "append":
        writer = writer.format("parquet").option("path", f"{folder}/{name}")
    else:
        writer = writer.foreachBatch(write_batch)
    with _stream_settings(stream.sparkSession, state_partitions):
        running = writer.trigger(availableNow=True).start()
        running.awaitTermination()
    return running.recentProgress


def late_rows(progress: list[dict]) -> int:
    """Rows a run dropped because they came after the watermark had passed them."""
    return sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])


def read_out(stream: DataFrame, folder: str, keys: list[str] | None = None, name: str = "out") -> DataFrame:
    """What a run has written; with `keys`, only the latest batch's row of each key."""
    schema = stream.schema
    if keys is None:
        return stream.sparkSession.read.schema(schema).parquet(f"{folder}/{name}")
    with_batch = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    rows = stream.sparkSession.read.schema(with_batch).parquet(f"{folder}/{name}")
    return latest_per_key(rows, keys, ["batch"]).drop("batch")


def feed(
    parts: Iterable[DataFrame],
    folder: str,
    build: Callable[[DataFrame], DataFrame],
    mode: str = "append",
    keys: list[str] | None = None,
    each_batch: Callable[[DataFrame, int], None] | None = None,
) -> DataFrame:
    """Write the parts one after the other to a watched folder, running the stream after each.

    Every run restarts from the checkpoint of the one before.
    """
    stream = None
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        source = part.sparkSession.readStream.schema(part.schema).parquet(f"{folder}/in")
        stream = build(source)
        run_available(stream, folder, mode, each_batch)
    return read_out(stream, folder, keys)
