"""Quality rules whose cutoffs carry a guarantee.

Signals of a text are compared with cutoffs. A cutoff is chosen per stratum from labelled documents:
the strictest of a fixed list for which the exact binomial bound still shows that at most the
allowed share of good documents lies above it. Cutoffs are tested from the most lenient on and the
first that fails ends the line, which keeps the error of one line; the lines, one for each stratum
and signal, share the error evenly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.llm.common import SPACED, join_small, saved
from ledgerlens.llm.spans import let

SIGNALS = ("symbols", "same_lines", "repeats", "capitals", "shouts")
#: Per thousand, the most lenient first.
GRID = (900, 700, 500, 400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20, 10, 5)
MIN_WORDS, MAX_REPEATS = 50, 50


@dataclass(frozen=True)
class Settings:
    """At most `risk` of a stratum's good documents are rejected, with probability 1 - `error` overall."""

    risk: float = 0.05
    error: float = 0.05


def repeated_words(words: Column) -> Column:
    """Words inside a three-word window that the text holds twice or more."""
    n = F.size(words)

    def count(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
            F.xxhash64(h[i], h[i + 1], h[i + 2]).alias("t"), i.alias("i")))

        def covered(s: Column) -> Column:
            # Sorted by window: one that recurs has its like next to it.
            twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["t"] == x["t"])) | ((k < n - 3) & (F.get(s, k + 1)["t"] == x["t"])))
            places = F.sort_array(F.transform(twice, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(places, start, lambda a, p: F.struct(
                (p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).cast("long").alias("n")))["n"]

        return let(F.sort_array(windows), covered)

    return F.when(n >= 3, let(F.transform(words, lambda w: F.xxhash64(w)), count)).otherwise(F.lit(0).cast("long"))


def with_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without the text, with the counts and the signals, per thousand, of every text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    facts = let(F.regexp_extract_all(t, F.lit(SPACED), F.lit(0)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words")))
    counted = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("same")))
    out = docs.withColumns({
        "_w": facts, "_l": counted, "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "_upper": F.regexp_count(t, F.lit(r"\p{Lu}{2}")), "_shout": F.regexp_count(t, F.lit("[!?]{2}"))}).drop(text)
    per = lambda a, b: F.when(b > 0, F.floor(1000 * a / b)).otherwise(F.lit(0)).cast("long")
    w = F.col("_w.n_words")
    return out.select(
        *[c for c in docs.columns if c != text], w.alias("n_words"), F.col("_w.word_chars").alias("word_chars"), "n_symbols",
        F.col("_l.same").alias("n_dup_lines"), F.col("_w.n_repeat_words").alias("n_repeat_words"),
        per(F.col("n_symbols"), F.col("_w.word_chars")).alias("symbols"), per(F.col("_l.same"), F.col("_l.n")).alias("same_lines"),
        per(F.col("_w.n_repeat_words"), w).alias("repeats"), per(F.col("_upper"), w).alias("capitals"), per(F.col("_shout"), w).alias("shouts"))


def log_factorial(n: Column) -> Column:
    """log(n!) to about 14 digits: Stirling's series at n + 9, stepped down."""
    z = n + 9.0
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0)))
    down = F.log(n + 1.0)
    for i in range(2, 9):
        down = down + F.log(n + float(i))
    return series - down


def at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial X of n and p, for k below n * p; 1 above.

    The terms fall from k down by a ratio that falls as well, so what is left out after many terms
    is bounded by a geometric series, which is added: never too small.
    """
    kd, nd = k.cast("double"), n.cast("double")
    top = log_factorial(nd) - log_factorial(kd) - log_factorial(nd - kd) + kd * F.log(F.lit(p)) + (nd - kd) * F.log(F.lit(1 - p))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    steps = F.when(k > 0, F.sequence(F.lit(1), F.least(k, F.lit(20_000)).cast("int"))).otherwise(F.array().cast("array<int>"))

    def step(a: Column, i: Column) -> Column:
        j = kd - i.cast("double") + 1
        term = a["term"] * j / (nd - j + 1) * ((1 - p) / p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    total = F.aggregate(steps, start, step)
    ratio = kd * (1 - p) / ((nd - kd + 1) * p)
    tail = F.when(k > 20_000, total["term"] * ratio / (1 - ratio)).otherwise(0.0)
    return F.when(kd < nd * p, F.least(F.lit(1.0), F.exp(top) * (total["sum"] + tail))).otherwise(1.0)


def choose_cutoffs(holdout: DataFrame, s: Settings = Settings(), signals: tuple[str, ...] = SIGNALS) -> DataFrame:
    """(stratum, cutoffs): a map from signal to cutoff; signals without a safe cutoff are not in it.

    `holdout` has (stratum, signals...) of good documents, one row each.
    """
    ranges = [F.struct(F.lit(x).alias("signal"), F.col(x).alias("value")) for x in signals]
    values = holdout.select("stratum", F.explode(F.array(*ranges)).alias("x")).select("stratum", "x.*")
    above = [F.sum((F.col("value") > g).cast("long")).alias(f"g{g}") for g in GRID]
    counts = saved(values.groupBy("stratum", "signal").agg(F.count("*").alias("n"), *above), "holdout")
    lines = counts.count()
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(g).alias("cutoff"), F.col(f"g{g}").alias("k")) for i, g in enumerate(GRID)]))
    tested = counts.select("stratum", "signal", "n", grid.alias("x")).select("stratum", "signal", "n", "x.*")
    risk = s.risk / len(signals)
    tested = tested.withColumn("fails", (at_most(F.col("k"), F.col("n"), risk) > s.error / max(lines, 1)).cast("int"))
    line = W.partitionBy("stratum", "signal").orderBy("place")
    passed = tested.withColumn("failed", F.max("fails").over(line)).filter("failed = 0")
    chosen = passed.groupBy("stratum", "signal").agg(F.min("cutoff").alias("cutoff"))
    return chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("signal", "cutoff"))).alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text",
          stratum: str = "lang") -> DataFrame:
    """Per row of `docs`: the counts, the signals, base_failed, rejected_by and kept.

    The holdout is every labelled document of `docs` that passes the base rule and that all its
    labels call good (quality 1). A null stratum is one of its own; a stratum with too few labels
    has no cutoffs and rejects nothing. Null and empty texts have no words and fail the base rule.
    Rows that repeat an id each count. Empty tables give empty results. Extra columns are not read.
    """
    rows = docs.select(F.col(doc_id), F.col(text), F.coalesce(F.col(stratum), F.lit("")).alias("stratum"))
    facts = with_signals(rows, text)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATS * F.col("n_words"))
    facts = saved(facts.withColumn("base_failed", failed), "signals")
    good = labels.groupBy(doc_id).agg(F.min("quality").alias("q")).filter("q = 1").select(doc_id)
    holdout = facts.filter("NOT base_failed").join(good, doc_id, "left_semi").select("stratum", *SIGNALS)
    cutoffs = saved(choose_cutoffs(holdout, settings), "cutoffs")
    out = join_small(facts, cutoffs, ["stratum"], "left")
    over = F.filter(F.array(*[F.when(F.col(x) > F.col("cutoffs")[x], F.lit(x)) for x in SIGNALS]), lambda x: x.isNotNull())
    out = out.withColumn("rejected_by", F.coalesce(over, F.array().cast("array<string>")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("cutoffs")
