"""Messages, manual entries and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import fixed
from ledgerlens.operators.state import current_state
from ledgerlens.operators.validate import manual_entries
from ledgerlens.plans import categorize, sms
from ledgerlens.plans.catalog.registry import query
from ledgerlens.plans.fixtures import Views

GATES = r"""
g AS (SELECT *, regexp_matches(trim(sender), '(?i)^[A-Z]{2}-[A-Z0-9]{4,6}$') AS gate1,
             regexp_matches(body, '(?i)\b(debited|credited|upi|rs\.|inr|transaction|payment)\b') AS gate2 FROM v_sms)"""


@query("sms_gates", f"WITH {GATES} SELECT msg_id, gate1, gate2 FROM g")
def _(v: Views):
    return sms.gate(v.sms).select("msg_id", "gate1", "gate2")


# The extraction pattern uses look-ahead, so the SQL states each template's one reading:
# a payee ends before a number, so `Merchant 15` is read as `Merchant`.
EXTRACT = f"""
WITH {GATES},
e AS (SELECT g.*, l.amount AS billed, 
             'TXN_' || CAST(epoch_ms(g.ts) AS STRING) AS fallback_id
      FROM g JOIN v_ledger l ON g.msg_id = l.txn_id WHERE gate1 AND gate2)"""


@query("sms_extract", EXTRACT + """
SELECT msg_id, billed AS amount,
       CASE msg_id % 5 WHEN 1 THEN 'Zomato' ELSE 'Merchant' END AS payee,
       CASE msg_id % 5 WHEN 0 THEN CAST(100000000000 + msg_id AS STRING) WHEN 1 THEN concat('ABCD', 1000000 + msg_id) ELSE fallback_id END AS txn_id,
       CASE msg_id % 5 WHEN 0 THEN '26-Apr-25' WHEN 1 THEN '01/02/25' ELSE '' END AS date
FROM e WHERE msg_id % 5 IN (0, 1, 4)""")
def _(v: Views):
    parsed, _ = sms.split_quarantine(v.sms)
    return parsed.select("msg_id", "amount", "payee", "txn_id", "date")


@query("sms_quarantine", EXTRACT + """
SELECT msg_id, user_id, ts, sender, body, 'amount missing' AS reason FROM e WHERE msg_id % 5 = 3""")
def _(v: Views):
    return sms.split_quarantine(v.sms)[1]


@query("sms_extract_lenient", r"""
WITH m AS (SELECT msg_id, body, regexp_extract(body, '(?i)(?:Rs\.?|INR|₹)\s*([\d,]+(?:\.\d{2})?)', 1) AS a,
      regexp_extract(body, '(?i)(?:to|towards|at|debited to)\s+([A-Za-z0-9\s]+?)(?:\s+(?:UPI|Ref|on|Bal|a\/c|from|$))', 1) AS p
  FROM v_sms WHERE regexp_matches(lower(body), 'debited|credited|spent|alert|withdrawn'))
SELECT msg_id, CASE WHEN a = '' THEN 100.0e0 ELSE CAST(replace(a, ',', '') AS DOUBLE) END AS amount,
       CASE WHEN p = '' THEN 'Unknown Merchant' ELSE trim(p) END AS payee FROM m""")
def _(v: Views):
    return sms.extract_lenient(v.sms).select("msg_id", "amount", "payee")


@query("manual_entries", """
WITH e AS (SELECT txn_id AS n, ts, payee, amount, txn_id % 30 - 3 AS h FROM v_ledger)
SELECT n, CASE n % 3 WHEN 0 THEN 'AD-GPAY' WHEN 1 THEN 'AD-PHONEPE' ELSE 'AD-AMAZON PAY' END AS sender, payee, amount,
       'TXN' || CAST(epoch_ms(ts) AS STRING) AS txn_id, CASE WHEN n % 11 = 2 THEN CAST(12 AS INT) ELSE CAST(h AS INT) END AS hour_of_day,
       strftime(ts, '%d-%b-%y') AS date
FROM e WHERE n % 13 <> 0 AND n % 17 <> 0 AND n % 19 <> 0 AND (n % 11 = 2 OR h BETWEEN 0 AND 23)""")
def _(v: Views):
    n = F.col("txn_id")
    typed = v.ledger.select(
        n.alias("n"),
        "ts",
        F.when(n % 13 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("payee"))).alias("payee"),
        F.when(n % 17 == 0, "ten").when(n % 19 == 0, "-5").otherwise(F.col("amount").cast("string")).alias("amount_text"),
        F.when(n % 11 == 2, "noon").otherwise((n % 30 - 3).cast("string")).alias("hour_text"),
        F.when(n % 3 == 0, "GPay").when(n % 3 == 1, "PhonePe").otherwise("Amazon Pay").alias("app"),
    )
    return manual_entries(typed).select("n", "sender", "payee", "amount", "txn_id", "hour_of_day", "date")


def shops(v: Views):
    """Ledger rows whose payees carry well-known and unknown names."""
    n = F.col("txn_id")
    return v.ledger.select(
        "txn_id",
        "user_id",
        F.when(n % 10 == 0, "ZOMATO Order").when(n % 10 == 1, "Ola Cabs").when(n % 10 == 2, "Motorola Store")
        .when(n % 10 == 3, "Amazon India").when(n % 10 == 4, "Hotel Plaza").when(n % 10 == 5, "State Electricity")
        .otherwise(F.col("payee")).alias("payee"),
    )


SHOPS = """
s AS (SELECT txn_id, user_id, CASE txn_id % 10 WHEN 0 THEN 'ZOMATO Order' WHEN 1 THEN 'Ola Cabs' WHEN 2 THEN 'Motorola Store'
        WHEN 3 THEN 'Amazon India' WHEN 4 THEN 'Hotel Plaza' WHEN 5 THEN 'State Electricity' ELSE payee END AS payee FROM v_ledger)"""


def _rules_sql(rules) -> str:
    rows = ", ".join(f"({i}, '{k}', '{c}', {x}e0)" for i, (k, c, x) in enumerate(rules))
    return f"(SELECT * FROM (VALUES {rows}) AS r(priority, keyword, category, confidence))"


@query("keyword_category", f"""
WITH {SHOPS}, strict AS (SELECT txn_id, arg_min(r.category, r.priority) AS category, arg_min(r.confidence, r.priority) AS confidence
           FROM s JOIN {_rules_sql(fixed.KEYWORD_RULES)} r ON contains(lower(s.payee), r.keyword) GROUP BY 1),
lenient AS (SELECT txn_id, arg_min(r.category, r.priority) AS category
           FROM s JOIN {_rules_sql(fixed.LENIENT_RULES)} r ON contains(lower(s.payee), r.keyword) GROUP BY 1)
SELECT s.txn_id, s.payee, a.category, a.confidence, coalesce(b.category, 'Uncategorized') AS lenient_category
FROM s LEFT JOIN strict a ON s.txn_id = a.txn_id LEFT JOIN lenient b ON s.txn_id = b.txn_id""")
def _(v: Views):
    loose = categorize.keyword_match("payee", fixed.LENIENT_RULES)["category"]
    return categorize.keyword_category(shops(v)).select(
        "txn_id", "payee", "category", "confidence", F.coalesce(loose, F.lit("Uncategorized")).alias("lenient_category")
    )


def cache(v: Views):
    return current_state(v.payee_log, ["payee_name"])


CACHE = """
c AS (SELECT * FROM (SELECT * FROM v_payee_log QUALIFY row_number() OVER (PARTITION BY payee_name ORDER BY seq DESC) = 1) x WHERE op <> 'delete')"""
MATCH = f"""
k AS (SELECT payee, arg_min(r.category, r.priority) AS category, arg_min(r.confidence, r.priority) AS confidence
      FROM (SELECT DISTINCT payee FROM s) d JOIN {_rules_sql(fixed.KEYWORD_RULES)} r ON contains(lower(d.payee), r.keyword) GROUP BY 1)"""


@query("resolve_category", f"""
WITH {SHOPS}, {CACHE}, {MATCH}
SELECT s.txn_id, coalesce(c.category, k.category, 'Uncategorized') AS category,
       CASE WHEN c.category IS NOT NULL THEN 'CACHE' WHEN k.category IS NOT NULL THEN 'NLP' ELSE 'PENDING_USER' END AS source,
       CASE WHEN c.category IS NULL THEN k.confidence END AS confidence,
       c.category IS NULL AND k.category IS NULL AS requires_prompt
FROM s LEFT JOIN c ON lower(trim(s.payee)) = c.payee_name LEFT JOIN k ON s.payee = k.payee""")
def _(v: Views):
    return categorize.resolve_category(shops(v), cache(v)).select(
        "txn_id", "category", "source", "confidence", "requires_prompt"
    )


@query("unresolved_payees", f"""
WITH {SHOPS}, {CACHE}, {MATCH}
SELECT DISTINCT lower(trim(s.payee)) AS payee_name FROM s LEFT JOIN k ON s.payee = k.payee
WHERE k.category IS NULL AND lower(trim(s.payee)) NOT IN (SELECT payee_name FROM c)""")
def _(v: Views):
    return categorize.unresolved_payees(shops(v), cache(v))
