"""Alignment with the gold labels, confusion counts and agreement metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kappaloom.fixed_values import UNKNOWN

METRICS = ["accuracy", "precision", "recall", "f1", "kappa"]
ITEM_KEY = ["dataset", "item_id"]


def known(pred: Column | str) -> Column:
    """A missing prediction counts as a class of its own."""
    return F.coalesce(F.col(pred) if isinstance(pred, str) else pred, F.lit(UNKNOWN))


def align(gold: DataFrame, preds: DataFrame, on: list[str] = ITEM_KEY) -> DataFrame:
    """Predictions with their gold label, matched by item and not by position."""
    return preds.join(gold.select(*on, "gold"), on)


def alignment_audit(gold: DataFrame, preds: DataFrame, on: list[str] = ITEM_KEY) -> DataFrame:
    """(status, items): how many items only one side has."""
    g = gold.select(*on).withColumn("_g", F.lit(True))
    p = preds.select(*on).distinct().withColumn("_p", F.lit(True))
    status = (
        F.when(F.col("_g").isNull(), "prediction_only")
        .when(F.col("_p").isNull(), "gold_only")
        .otherwise("matched")
    )
    return g.join(p, on, "full_outer").groupBy(status.alias("status")).agg(
        F.count("*").alias("items")
    )


def confusion_counts(
    df: DataFrame, keys: list[str], gold: str = "gold", pred: str = "pred"
) -> DataFrame:
    """``keys``, gold, pred, n. Counts combine inside each task before the shuffle."""
    return df.groupBy(*keys, F.col(gold).alias("gold"), known(pred).alias("pred")).agg(
        F.count("*").alias("n")
    )


def metrics_from_confusion(confusion: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, macro precision, recall, F1 and Cohen's kappa per ``keys``.

    Works on confusion cells only. Classes are those of either side; a class one side
    never uses scores 0. Kappa is null where chance agreement is 1.
    """
    n = F.col("n").cast("double")
    hit = F.when(F.col("gold") == F.col("pred"), n).otherwise(F.lit(0.0))
    zero = F.lit(0.0)
    sides = F.array(
        F.struct(F.col("gold").alias("label"), n.alias("t"), zero.alias("p"), hit.alias("tp")),
        F.struct(F.col("pred").alias("label"), zero.alias("t"), n.alias("p"), zero.alias("tp")),
    )
    per_class = (
        confusion.select(*keys, F.inline(sides))
        .groupBy(*keys, "label")
        .agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    )

    def macro(above: Column, below: Column) -> Column:
        return F.avg(F.coalesce(F.try_divide(above, below), zero))

    sums = per_class.groupBy(*keys).agg(
        F.sum("t").alias("_n"),
        F.sum("tp").alias("_hits"),
        F.sum(F.col("t") * F.col("p")).alias("_chance"),
        macro(F.col("tp"), F.col("p")).alias("precision"),
        macro(F.col("tp"), F.col("t")).alias("recall"),
        macro(2 * F.col("tp"), F.col("t") + F.col("p")).alias("f1"),
    )
    agree = F.col("_hits") / F.col("_n")
    # Kappa from whole counts: exact zero in the denominator when chance agreement is 1.
    square = F.col("_n") * F.col("_n")
    kappa = F.try_divide(F.col("_hits") * F.col("_n") - F.col("_chance"), square - F.col("_chance"))
    return sums.select(
        *keys, F.col("_n").cast("long").alias("items"),
        agree.alias("accuracy"), "precision", "recall", "f1", kappa.alias("kappa"),
    )


def agreement_metrics(df: DataFrame, keys: list[str], gold="gold", pred="pred") -> DataFrame:
    return metrics_from_confusion(confusion_counts(df, keys, gold, pred), keys)


def per_label_accuracy(df: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each gold label that was found."""
    correct = F.count(F.when(F.col("gold") == F.col("pred"), 1))
    return (
        df.groupBy(*keys, F.col("gold").alias("label"))
        .agg(F.count("*").alias("total"), correct.alias("correct"))
        .withColumn("accuracy", F.col("correct") / F.col("total"))
    )


def rater_agreement(df: DataFrame, rater_a: str, rater_b: str, keys: list[str]) -> DataFrame:
    """Kappa and accuracy between two raters of the same items."""
    return agreement_metrics(df, keys, rater_a, rater_b).select(*keys, "items", "accuracy", "kappa")
