"""Evaluation of scored rows (columns `label` 0/1 and `score`)."""

from __future__ import annotations

from calendar import monthrange
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import fixed
from ledgerlens.functions.times import since
from ledgerlens.operators.ordered import with_running_totals


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    said, is_one = F.col("score") >= threshold, F.col("label") == 1
    return scored.agg(
        _count(said & is_one).alias("tp"),
        _count(said & ~is_one).alias("fp"),
        _count(~said & is_one).alias("fn"),
        _count(~said & ~is_one).alias("tn"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def classification_report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per class with its own counts and rates, and the common accuracy."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    one = F.struct(F.lit(1).alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    zero = F.struct(F.lit(0).alias("class"), tn.alias("tp"), fn.alias("fp"), fp.alias("fn"), tp.alias("tn"))
    per_class = confusion(scored, threshold).select(F.inline(F.array(zero, one)))
    return with_rates(per_class).withColumns(
        {
            "support": F.col("tp") + F.col("fn"),
            "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
        }
    )


def by_score(scored: DataFrame) -> DataFrame:
    """One row per distinct score: pos, neg."""
    return scored.groupBy("score").agg(
        _count(F.col("label") == 1).alias("pos"), _count(F.col("label") != 1).alias("neg")
    )


def _cumulative(scored: DataFrame) -> DataFrame:
    return with_running_totals(
        by_score(scored), "score", {"cum_pos": "pos", "cum_neg": "neg"}, descending=True
    )


def auc(scored: DataFrame) -> DataFrame:
    """roc_auc (ties count half) and avg_precision (step sum), one row."""
    pos, neg = F.sum("pos"), F.sum("neg")
    lost = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    steps = F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    return _cumulative(scored).agg(
        (1 - F.try_divide(lost, pos * neg)).alias("roc_auc"),
        F.try_divide(steps, pos).alias("avg_precision"),
    )


def curves(scored: DataFrame) -> DataFrame:
    """A point of both curves per distinct score: threshold, tpr, fpr, precision, recall."""
    totals = scored.agg(
        F.struct(
            _count(F.col("label") == 1).alias("pos"), _count(F.col("label") != 1).alias("neg")
        )
    ).scalar()
    tpr = F.try_divide("cum_pos", totals["pos"])
    return _cumulative(scored).select(
        F.col("score").alias("threshold"),
        tpr.alias("tpr"),
        F.try_divide("cum_neg", totals["neg"]).alias("fpr"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        tpr.alias("recall"),
    )


def score_histogram(scored: DataFrame, bins: int = 40) -> DataFrame:
    """Count and density per class and bin over [0, 1]; the last bin holds 1 itself."""
    edge = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    # At most 2 x `bins` rows are left for the class totals.
    per_class = Window.partitionBy("label")
    return (
        scored.groupBy("label", edge.alias("bin"))
        .agg(F.count("*").alias("n"))
        .withColumn("density", F.col("n") / (F.sum("n").over(per_class) / bins))
        .withColumn("lower", F.col("bin") / bins)
    )


def sweep(scored: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """Counts and rates at each threshold, from one pass.

    A row is placed at the highest threshold it reaches; the few (threshold, class)
    counts are then accumulated downwards, instead of repeating each row per threshold.
    """
    thresholds = sorted(thresholds or fixed.SWEEP)
    reached = sum(((F.col("score") >= t).cast("int") for t in thresholds), F.lit(0))
    counts = scored.groupBy(reached.alias("level")).agg(
        _count(F.col("label") == 1).alias("pos"), _count(F.col("label") != 1).alias("neg")
    )
    lines = []
    for i, t in enumerate(thresholds):
        up = F.col("level") > i
        lines.append(
            F.struct(
                F.lit(t).alias("threshold"),
                *[
                    F.coalesce(F.sum(F.when(side, F.col(n))), F.lit(0)).alias(out)
                    for out, side, n in (
                        ("tp", up, "pos"), ("fp", up, "neg"), ("fn", ~up, "pos"), ("tn", ~up, "neg"),
                    )
                ],
            )
        )
    table = with_rates(counts.agg(F.array(*lines).alias("l")).select(F.inline("l")))
    return table.withColumns(
        {
            "meets": (F.col("recall") >= fixed.MIN_RECALL)
            & (F.col("precision") >= fixed.MIN_PRECISION),
            # One row per threshold reaches this window.
            "recall_ceiling": F.max("recall").over(Window.partitionBy(F.lit(0))),
        }
    )


def pick_threshold(table: DataFrame) -> DataFrame:
    """The best f1 among rows that meet both limits, else of all; the higher threshold on ties."""
    best = Window.partitionBy(F.lit(0)).orderBy(
        F.col("meets").desc(), F.col("f1").desc(), F.col("threshold").desc()
    )
    return table.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") == 1).drop("__n")


def retrain_gate(scored: DataFrame, as_of: datetime, min_ap: float = 0.45, months: int = 12) -> DataFrame:
    """Average precision over the last `months` months and whether a new model is accepted."""
    start = _months_before(as_of, months)
    return auc(scored.filter(since("ts", start, as_of))).withColumn(
        "accepted", F.col("avg_precision") >= min_ap
    )


def _months_before(moment: datetime, months: int) -> datetime:
    index = moment.year * 12 + moment.month - 1 - months
    year, month = index // 12, index % 12 + 1
    return moment.replace(year=year, month=month, day=min(moment.day, monthrange(year, month)[1]))
