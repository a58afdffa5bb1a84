"""Streams run to the end of their input, and held against the batch SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.times import since
from ledgerlens.plans.catalog.finance import AS_OF, PROGRESS
from ledgerlens.plans.catalog.ingest import CACHE, EXTRACT, MATCH, SHOPS, cache, shops
from ledgerlens.plans.catalog.registry import query, r, rounded
from ledgerlens.plans.catalog.scoring import BASE_SQL, FLAGSHIP_SQL, live
from ledgerlens.plans.fixtures import Views
from ledgerlens.sources.evolving import scratch_folder
from ledgerlens.streaming import jobs
from ledgerlens.streaming.baseline import baseline_stream

LEDGER_CUTS = [datetime(1998, 1, 1), datetime(2001, 7, 10)]
EVENT_CUTS = [datetime(2024, 1, 11), datetime(2024, 1, 21)]


def in_parts(df: DataFrame, cuts: list[datetime]) -> list[DataFrame]:
    edges = [datetime(1900, 1, 1), *cuts, None]
    return [df.filter(since("ts", a, b)) for a, b in zip(edges, edges[1:])]


@query("stream_sms", EXTRACT + """
SELECT msg_id, CASE WHEN msg_id % 5 <> 3 THEN billed END AS amount,
       CASE msg_id % 5 WHEN 1 THEN 'Zomato' WHEN 3 THEN 'Unknown Payee' ELSE 'Merchant' END AS payee,
       CASE WHEN msg_id % 5 = 3 THEN 'amount missing' END AS reason
FROM e WHERE msg_id % 5 <> 2""")
def _(v: Views):
    folder = scratch_folder(v.spark, "sms")
    return jobs.feed(in_parts(v.sms, LEDGER_CUTS), folder, jobs.sms_stream).select("msg_id", "amount", "payee", "reason")


@query("stream_baseline", f"""
WITH {BASE_SQL}
SELECT txn_id, n, is_cold_start, round(z_amount, 6) AS z_amount, round(z_hour, 6) AS z_hour FROM y""")
def _(v: Views):
    folder = scratch_folder(v.spark, "baseline")
    out = jobs.feed(in_parts(v.event_txn, EVENT_CUTS), folder, baseline_stream)
    return rounded(out.select("txn_id", "n", "is_cold_start", "z_amount", "z_hour"), 6, "z_amount", "z_hour")


@query("stream_verdicts", f"""
SELECT txn_id, ensemble_score, is_fraud, alert_level FROM ({FLAGSHIP_SQL.replace('amount >= 0.05', 'true')}) f
WHERE alert_level IN ('medium', 'high')""")
def _(v: Views):
    """Scored against streaming state; the high-alert feed is what is kept."""
    folder = scratch_folder(v.spark, "verdicts")

    def build(source):
        return jobs.alert_stream(jobs.verdict_stream(source)).select(
            "txn_id", "ensemble_score", "is_fraud", "alert_level"
        )

    def write(batch, number):
        # One folder per batch, written over on replay: a retry cannot add a row twice.
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    return jobs.feed(in_parts(live(v), EVENT_CUTS), folder, build, each_batch=write).drop("batch")


@query("stream_budget", f"""
WITH {PROGRESS} SELECT user_id, category, round(total, 2) AS total, txn_count, monthly_limit, status FROM p""")
def _(v: Views):
    folder = scratch_folder(v.spark, "budget")
    budgets = v.budgets
    out = jobs.feed(
        in_parts(v.ledger, LEDGER_CUTS), folder,
        lambda s: jobs.budget_stream(s, budgets, AS_OF), mode="update", keys=["user_id", "category"],
    )
    return rounded(out.select("user_id", "category", "total", "txn_count", "monthly_limit", "status"), 2, "total")


@query("stream_prompts", f"""
WITH {SHOPS}, {CACHE}, {MATCH}
SELECT s.txn_id, s.payee, lower(trim(s.payee)) AS payee_name FROM s LEFT JOIN k ON s.payee = k.payee
LEFT JOIN c ON lower(trim(s.payee)) = c.payee_name WHERE k.category IS NULL AND c.payee_name IS NULL""")
def _(v: Views):
    folder = scratch_folder(v.spark, "prompts")
    remembered = cache(v)
    rows = shops(v).select("txn_id", "payee")
    even = [rows.filter(F.col("txn_id") % 2 == i) for i in (0, 1)]
    return jobs.feed(even, folder, lambda s: jobs.prompt_stream(s, remembered)).select("txn_id", "payee", "payee_name")


@query("stream_dedup", "SELECT txn_id, user_id, ts, amount FROM v_event_txn")
def _(v: Views):
    """Every third row is sent twice."""
    folder = scratch_folder(v.spark, "dedup")
    rows = v.event_txn.select("txn_id", "user_id", "ts", "amount")
    again = rows.unionByName(rows.filter(F.col("txn_id") % 3 == 0))
    out = jobs.feed(in_parts(again, EVENT_CUTS), folder, jobs.dedup_stream)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_weekly", """
WITH w AS (SELECT user_id, time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01') AS week_start, amount FROM v_event_txn),
top AS (SELECT max(ts) AS latest FROM v_event_txn)
SELECT user_id, week_start, round(sum(amount), 2) AS total, count(*) AS txn_count FROM w, top
WHERE week_start + INTERVAL 7 DAYS <= latest - INTERVAL 1 DAY GROUP BY 1, 2""")
def _(v: Views):
    folder = scratch_folder(v.spark, "weekly")
    out = jobs.feed(in_parts(v.event_txn, EVENT_CUTS), folder, jobs.weekly_stream)
    return rounded(out, 2, "total")
