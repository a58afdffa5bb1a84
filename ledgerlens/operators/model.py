"""Boosted trees, calibration, ablation, importance, and the frozen model."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import fixed
from ledgerlens.operators.evaluate import auc, sweep
from ledgerlens.operators.stats import with_lookup
from ledgerlens.session import keep_checkpoints


def train_trees(train: DataFrame, features: list[str], label: str = "label", **params) -> PipelineModel:
    """Gradient-boosted trees; `params` override the fixed settings.

    Each tree's residuals stand on those of the tree before, a lineage too deep to send to tasks after
    some hundred trees; MLlib cuts it every ten trees, but only where it has a folder for checkpoints.
    """
    keep_checkpoints(train.sparkSession)
    settings = {**fixed.TREE_PARAMS, **params}
    assembler = VectorAssembler(inputCols=features, outputCol="__features")
    trees = GBTClassifier(
        featuresCol="__features", labelCol=label, predictionCol="__prediction", **settings
    )
    trees.set(trees.rawPredictionCol, "__raw")
    trees.set(trees.probabilityCol, "__probability")
    return Pipeline(stages=[assembler, trees]).fit(train.select(*features, label))


def tree_score(df: DataFrame, model: PipelineModel, out: str = "score") -> DataFrame:
    scored = model.transform(df).withColumn(out, vector_to_array("__probability")[1])
    return scored.drop("__features", "__prediction", "__raw", "__probability")


def train_light(train: DataFrame, features: list[str], label: str = "label") -> PipelineModel:
    """The trained form of the five-feature logistic scorer."""
    assembler = VectorAssembler(inputCols=features, outputCol="__features")
    logistic = LogisticRegression(
        featuresCol="__features", labelCol=label, predictionCol="__prediction",
        rawPredictionCol="__raw", probabilityCol="__probability",
    )
    return Pipeline(stages=[assembler, logistic]).fit(train.select(*features, label))


def platt(scored: DataFrame, held_out: DataFrame) -> DataFrame:
    """Add `calibrated`: a logistic fit of the label on the score of the held-out part."""
    return tree_score(scored, train_light(held_out, ["score"]), "calibrated")


def save_model(model: PipelineModel, threshold: float, features: list[str], path: str) -> None:
    """The pipeline in Spark's format with a small table for threshold and feature order."""
    model.write().overwrite().save(f"{path}/model")
    spark = _session()
    frozen = json.dumps({"threshold": threshold, "features": features})
    spark.createDataFrame([(frozen,)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/settings"
    )


def load_model(path: str) -> tuple[PipelineModel, float, list[str]]:
    settings = json.loads(_session().read.text(f"{path}/settings").first()["value"])
    return PipelineModel.load(f"{path}/model"), settings["threshold"], settings["features"]


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.active()


def ablate(
    model: PipelineModel, test: DataFrame, medians: DataFrame, features: list[str], label: str = "label"
) -> DataFrame:
    """Score with some features fixed at their training medians, model unchanged.

    One row: both metrics and the recall ceiling before and after, and what is left.
    """
    masked = with_lookup(test, medians)
    masked = masked.withColumns(
        {c: F.try_element_at(F.col("__known.medians"), F.lit(c)) for c in features}
    ).drop("__known")

    def measure(df: DataFrame, tag: str) -> DataFrame:
        scored = tree_score(df, model).select("score", F.col(label).alias("label"))
        ceiling = sweep(scored).agg(F.max("recall")).scalar()
        return auc(scored).select(
            F.col("avg_precision").alias(f"ap_{tag}"),
            F.col("roc_auc").alias(f"roc_{tag}"),
            ceiling.alias(f"recall_ceiling_{tag}"),
        )

    before, after = measure(test, "base"), measure(masked, "masked")
    left = F.col("ap_masked")
    return before.select(
        "*", *[after.select(c).scalar().alias(c) for c in after.columns]
    ).withColumns(
        {
            "ap_drop_pct": (F.col("ap_base") - left) / F.greatest("ap_base", F.lit(1e-9)) * 100,
            "verdict": F.when(left < 0.10, "rule engine")
            .when(left < 0.20, "partial learner")
            .otherwise("genuine model"),
        }
    )


def tree_importance(model: PipelineModel, features: list[str], top: int = 15) -> list[tuple[str, float]]:
    weights = model.stages[-1].featureImportances.toArray()
    ranked = sorted(zip(features, weights), key=lambda fw: (-fw[1], fw[0]))
    return [(f, float(w)) for f, w in ranked[:top]]


def linear_importance(df: DataFrame, weights: dict[str, float], top: int = 15) -> DataFrame:
    """Mean |weight x (value - mean)| per feature: exact contributions of a linear score.

    Two passes of plain aggregates: the means first, as one scalar row.
    """
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in weights])).scalar()
    sums = df.select(
        *[F.abs((F.coalesce(F.col(c), F.lit(0)) - means[c]) * w).alias(c) for c, w in weights.items()]
    ).agg(*[F.avg(c).alias(c) for c in weights])
    lines = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("contribution")) for c in weights]
    return (
        sums.select(F.inline(F.array(*lines))).orderBy(F.col("contribution").desc(), "feature").limit(top)
    )
