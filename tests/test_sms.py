"""Gates and extraction on written-out messages."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.text import format_inr, payment_app
from ledgerlens.plans import categorize, sms

AT = datetime(2025, 4, 26, 2, 14)
SCHEMA = "sender string, body string, ts timestamp_ntz"


def read(spark, body):
    r = sms.extract(spark.createDataFrame([("AD-HDFCBK", body, AT)], SCHEMA)).first()
    return r.amount, r.payee, r.txn_id, r.date


def test_extract(spark):
    none = "TXN_1745633640000"
    assert read(spark, "Your a/c XX1234 debited Rs.500.00 on 26-Apr-25 to Zomato India UPI Ref: 512345678901. Bal: Rs.12,000.") == (500.0, "Zomato India UPI", none, "26-Apr-25")
    assert read(spark, "ALERT: Rs.15000.00 debited to unknown@upi UPI Ref: 987654321098. Time: 02:14 AM.") == (15000.0, "unknown@upi UPI", none, "")
    assert read(spark, "INR 1,250.50 paid to Big Store on 01/02/25 Txn ID: ABCD123456") == (1250.5, "Big Store", "ABCD123456", "01/02/25")
    assert read(spark, "Payment of Rs , failed")[0] is None
    assert read(spark, "₹99 at Cafe ref 1")[:2] == (99.0, "Cafe")


@pytest.mark.parametrize("sender,ok", [("AD-HDFCBK", True), (" vm-icicib ", True), ("+919876543210", False), ("AD-ABC", False), ("AD-ABCDEFG", False)])
def test_sender_gate(spark, sender, ok):
    assert sms.gate(spark.createDataFrame([(sender, "x", AT)], SCHEMA)).first().gate1 is ok


@pytest.mark.parametrize("body,ok", [("Amount DEBITED", True), ("via UPI", True), ("Your Rs. 5", False), ("upiX", False), ("transaction done", True)])
def test_keyword_gate(spark, body, ok):
    assert sms.gate(spark.createDataFrame([("AD-GPAY", body, AT)], SCHEMA)).first().gate2 is ok


def test_quarantine(spark):
    rows = [("AD-HDFCBK", "UPI payment received", AT), ("AD-HDFCBK", "INR 5 debited", AT), ("me", "INR 5 debited", AT)]
    parsed, held = sms.split_quarantine(spark.createDataFrame(rows, SCHEMA))
    assert parsed.count() == 1 and held.first().reason == "amount missing"


def test_lenient(spark):
    rows = [("x", "Spent somewhere", AT), ("x", "Rs 20.00 spent at Star Hotel on Monday", AT), ("x", "hello", AT)]
    got = sms.extract_lenient(spark.createDataFrame(rows, SCHEMA)).select("amount", "payee").collect()
    assert [tuple(r) for r in got] == [(100.0, "Unknown Merchant"), (20.0, "Star Hotel")]


def test_rules_and_cache(spark):
    txn = spark.createDataFrame([("Motorola",), (" ZOMATO ",), ("Someone",), ("Dad ",)], "payee string")
    cache = spark.createDataFrame([("dad", "Family")], "payee_name string, category string")
    got = categorize.resolve_category(txn, cache).collect()
    assert {r.payee: (r.category, r.source, r.requires_prompt) for r in got} == {
        "Motorola": ("Travel", "NLP", False), " ZOMATO ": ("Food", "NLP", False),
        "Someone": ("Uncategorized", "PENDING_USER", True), "Dad ": ("Family", "CACHE", False),
    }
    assert txn.filter(categorize.keyword_match("payee", whole_words=True).isNotNull()).count() == 1
    assert [r.payee_name for r in categorize.unresolved_payees(txn, cache).collect()] == ["someone"]


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(format_inr(F.lit(1234567.5))) == "₹12,34,567.50"
    assert [one(format_inr(F.lit(x))) for x in (0.0, 999.994, 1000.0, -100000.0)] == ["₹0.00", "₹999.99", "₹1,000.00", "-₹1,00,000.00"]
    assert [one(payment_app(F.lit(s))) for s in ("AD-gpay", "vm-PhonePe", "AD-PAYTM", "AD-HDFC")] == ["GPay", "PhonePe", "Paytm", "GPay"]
