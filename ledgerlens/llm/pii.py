"""Personal data: four fixed kinds, and identifiers that their contexts lead to.

The fixed kinds are seeds. The words before a seed are a lexical pattern; patterns and the tokens
they stand before form a graph, on which Spark scores both sides in turn: a pattern by how much of
what follows it is known, a token by the patterns that lead to it. Tokens after patterns of high
confidence are identifiers too, of the kind of the pattern's seeds.

Only the texts' digit-bearing tokens are exploded; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.llm.common import join_small, saved
from ledgerlens.llm.spans import let, spans

KINDS = ("email", "ip", "card", "phone")
# What the kinds look like. Runs are possessive, and begin where a run begins or the
# last match ended: the same matches, in time linear in the text.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
SPAN = "array<struct<kind:int,start:bigint,stop:bigint>>"


@dataclass(frozen=True)
class Settings:
    """A pattern needs `support` different seed tokens and a score of `confidence`; `rounds` of scoring."""

    support: int = 3
    confidence: float = 0.8
    rounds: int = 3
    context: int = 80


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check sum of a string of digits is right."""
    each = F.split(F.reverse(number), "")
    values = F.transform(each, lambda d, i: let(
        d.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def valid(kind: str) -> Callable[[Column], Column]:
    if kind == "email":
        return lambda x: F.lit(True)
    if kind == "ip":
        small = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        return lambda x: F.forall(F.split(x["match"], r"\."), lambda p: F.when(small(p), p.cast("bigint") <= 255).otherwise(False))
    if kind == "card":
        return lambda x: F.when(F.length(digits(x["match"])).between(13, 19), luhn(digits(x["match"]))).otherwise(False)
    return lambda x: F.length(digits(x["match"])).between(9, 15)


def as_span(kind: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))


def base_spans(text: Column) -> Column:
    """The spans of the four kinds, by kind as listed, then start: array<struct<kind,start,stop>>."""
    gate = {"email": "@", "ip": ".", "phone": "+"}
    parts = []
    for k, kind in enumerate(KINDS):
        found = F.filter(spans(text, PATTERNS[kind]), valid(kind))
        found = F.transform(found, as_span(k))
        seen = F.contains(text, F.lit(gate[kind])) if kind in gate else text.rlike("[0-9]")
        parts.append(F.when(seen, found).otherwise(F.array().cast(SPAN)))
    return F.coalesce(F.concat(*parts), F.array().cast(SPAN))


def occurrences(docs: DataFrame, s: Settings) -> DataFrame:
    """(row, start, stop, token, pattern, kind) of tokens with a digit or @ after two words; kind null if not base.

    `docs` has (row, text, base).
    """
    x = docs.filter(F.col("text").rlike("[0-9@]")).select("row", "base", F.explode(spans(F.col("text"), TOKEN, s.context)).alias("x"))
    token = F.regexp_replace(F.col("x.match"), r"[.,;:!?)\]}'\"]+$", "")
    x = x.select("row", "base", F.col("x.start").alias("start"), token.alias("token"), F.col("x.left").alias("left"))
    # The part of a token up to its last = or : belongs to the context.
    lead = F.regexp_extract("token", r"^([^=:]*[=:]+)?(.*)$", 1)
    rest = F.regexp_extract("token", r"^([^=:]*[=:]+)?(.*)$", 2)
    words = F.regexp_extract("left", r"(?:^|\s)(\S+\s+\S+)\s+$", 1)
    x = x.withColumns({"lead": lead, "words": words, "token": rest}).withColumn("start", F.col("start") + F.length("lead"))
    x = x.withColumn("stop", F.col("start") + F.length("token")).filter(F.col("token").rlike("[0-9@]"))
    pattern = F.when(F.length("lead") > 0, F.lower("lead")).otherwise(F.lower(F.regexp_replace("words", r"\s+", " ")))
    meets = F.filter("base", lambda b: (b["start"] < F.col("stop")) & (b["stop"] > F.col("start")))
    x = x.withColumn("pattern", pattern).filter(F.length("pattern") > 0)
    return x.select("row", "start", "stop", "token", "pattern", F.get(meets, F.lit(0))["kind"].alias("kind"))


def score_patterns(found: DataFrame, s: Settings) -> DataFrame:
    """(pattern, kind, score) of the patterns that are trusted.

    Edges are distinct pairs of pattern and token, so copies of a text count once. Each round is two
    partial aggregates; skewed patterns are split by the join.
    """
    edges = saved(found.groupBy("pattern", "token").agg(F.max("kind").alias("kind")), "edges")
    seeds = edges.filter("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count("*").alias("n"))
    best = seeds.groupBy("pattern").agg(F.sum("n").alias("support"), F.max_by("kind", F.struct("n", -F.col("kind"))).alias("kind"))
    known = saved(best.filter(F.col("support") >= s.support), "patterns")
    live = saved(edges.withColumnRenamed("kind", "seed").join(known.select("pattern"), "pattern"), "live-edges")
    trust = live.select("pattern", "token", F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0).alias("trust"))
    scores = None
    for _ in range(s.rounds):
        scores = saved(trust.groupBy("pattern").agg((F.sum("trust") / F.count("*")).alias("score")), "scores")
        miss = live.join(scores, "pattern").groupBy("token").agg(
            F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))).alias("miss"), F.max("seed").alias("any_seed"))
        level = F.when(F.col("any_seed").isNotNull(), 1.0).otherwise(1 - F.exp("miss"))
        trust = live.join(miss, "token").select("pattern", "token", level.alias("trust"))
    return known.join(scores.filter(F.col("score") >= s.confidence), "pattern").select("pattern", F.col("kind").alias("found_kind"), "score")


def find_personal_data(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: (doc_id, base, spans), arrays of (kind, start, stop) by kind and start; kind counts from 0.

    Null and empty texts have none. Rows alike in id and text have the same spans. Spans that the
    contexts add never meet a base span; of two that meet the first stays. Without seeds, as in an
    empty table, nothing is added. Extra columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    rows = rows.withColumn("row", F.struct(F.xxhash64("text").alias("a"), F.xxhash64("_id", "text", F.lit(3)).alias("b")))
    base = rows.withColumn("base", base_spans(F.col("text")))
    spotted = saved(occurrences(base, settings), "occurrences")
    trusted = saved(score_patterns(spotted, settings), "trusted")
    new = join_small(spotted.filter("kind IS NULL"), trusted, ["pattern"]).select(
        "row", F.col("found_kind").alias("kind"), "start", "stop").distinct()
    order = W.partitionBy("row").orderBy("start", "stop")
    new = new.withColumn("_before", F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1)))
    new = new.filter("_before IS NULL OR start >= _before")
    added = saved(new.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("added")), "added")
    kept = saved(base.select("_id", "row", "base"), "base")
    out = join_small(kept, added, ["row"], "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPAN))))
    return out.select(F.col("_id").alias(doc_id), "base", every.alias("spans"))


def listed(col: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(col, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["stop"].cast("string"))), ",")
