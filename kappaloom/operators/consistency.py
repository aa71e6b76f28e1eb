"""Agreement of repeated runs: mean and SD of kappa, ICC(2,1), best run, summary.

All of it follows from how often each pattern (gold, answer of run 0, run 1, ...)
occurs. There are few patterns; only forming them touches the predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kappaloom.fixed_values import UNKNOWN
from kappaloom.operators.joins import lookup_join
from kappaloom.operators.scoring import METRICS, known, metrics_from_confusion
from kappaloom.session import materialize


def item_mark():
    """A hash of an item and its gold label; the exclusive or of many tells one set of them from another."""
    return F.xxhash64("dataset", "item_id", "gold")


def rating_patterns(preds: DataFrame, keys: list[str], marked: bool = False) -> DataFrame:
    """``keys``, gold, ratings (struct run_idx, pred in run order), n.

    One shuffle by item, whose groups hold one row per run, then a count of equal
    patterns that combines inside each task. ``marked`` adds the exclusive or of the item marks.
    """
    rating = F.struct("run_idx", known("pred").alias("pred"))
    return (
        preds.groupBy(*keys, "dataset", "item_id", "gold")
        .agg(F.array_sort(F.collect_list(rating)).alias("ratings"))
        .groupBy(*keys, "gold", "ratings")
        .agg(F.count("*").alias("n"), *[F.bit_xor(item_mark()).alias("mark")] * marked)
    )


def merge_patterns(patterns: DataFrame, keys: list[str]) -> DataFrame:
    """Marked pattern counts of several parts of the items as those of all: counts add up."""
    return patterns.groupBy(*keys, "gold", "ratings").agg(F.sum("n").alias("n"), F.bit_xor("mark").alias("mark"))


def covers(patterns: DataFrame, keys: list[str], gold: DataFrame, n_runs: int) -> bool:
    """Whether merged patterns hold each row of ``gold`` (dataset, item_id, gold) once in every one of
    their ``keys``, with all ``n_runs`` answers, and nothing else."""
    wanted = gold.groupBy("dataset").agg(F.count("*").alias("items"), F.bit_xor(item_mark()).alias("items_mark"))
    held = patterns.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.bit_xor("mark").alias("mark"), F.max(F.size("ratings") != n_runs).alias("short"))
    return held.join(wanted, "dataset", "left").where(
        "short or items is null or n <> items or mark <> items_mark").isEmpty()


def _long(patterns: DataFrame, keys: list[str]) -> DataFrame:
    return patterns.select(*keys, "gold", "n", F.inline("ratings"))


def run_metrics(patterns: DataFrame, keys: list[str]) -> DataFrame:
    """The five metrics of every run."""
    by_run = [*keys, "run_idx"]
    cells = _long(patterns, keys).groupBy(*by_run, "gold", "pred").agg(F.sum("n").alias("n"))
    return metrics_from_confusion(cells, by_run)


def label_codes(patterns: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, label, code: rank among gold labels, predictions and the unknown class."""
    labels = (
        _long(patterns, keys)
        .select(*keys, F.explode(F.array("gold", "pred", F.lit(UNKNOWN))).alias("label"))
        .distinct()
    )
    order = Window.partitionBy(*keys).orderBy("label")
    return labels.withColumn("code", F.row_number().over(order) - 1)


def icc_two_way(patterns: DataFrame, keys: list[str]) -> DataFrame:
    """ICC(2,1), two-way random effects, absolute agreement, one rater.

    Ratings are the codes of nominal labels, so the value depends on the order of the
    label names. Null with fewer than two runs, with runs of unequal coverage, or
    where no rating differs.
    """
    codes = materialize(label_codes(patterns, keys), "label_codes")
    numbered = patterns.withColumn("_pattern", F.sha2(F.to_json(F.struct("gold", "ratings")), 256))
    rated = numbered.select(*keys, "_pattern", "n", F.inline("ratings"))
    coded = lookup_join(
        rated, codes.withColumnRenamed("label", "pred"), [*keys, "pred"], salt_by="_pattern"
    )
    x, w = F.col("code").cast("double"), F.col("n").cast("double")
    subjects = coded.groupBy(*keys, "_pattern", "n").agg(
        F.sum(x).alias("_s"), F.count("*").alias("_k")
    )
    subject_sums = subjects.groupBy(*keys).agg(
        F.sum(w).alias("subjects"),
        F.max("_k").alias("_k"), F.min("_k").alias("_k_min"),
        F.sum(w * F.col("_s")).alias("_sum"),
        F.sum(w * F.col("_s") * F.col("_s")).alias("_ss_subject"),
    )
    run_sums = (
        coded.groupBy(*keys, "run_idx")
        .agg(F.sum(w * x).alias("_r"), F.sum(w * x * x).alias("_sq"))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("_runs"),
            F.sum(F.col("_r") * F.col("_r")).alias("_ss_run"),
            F.sum("_sq").alias("_sq"),
        )
    )
    n, k = F.col("subjects"), F.col("_k").cast("double")
    # Sums of squares, each times n*k.
    grand = F.col("_sum") * F.col("_sum")
    between_subjects = F.col("_ss_subject") * n - grand
    between_runs = F.col("_ss_run") * k - grand
    total = F.col("_sq") * n * k - grand
    rest = total - between_subjects - between_runs
    msr = F.try_divide(between_subjects, n - 1)
    msc = F.try_divide(between_runs, k - 1)
    mse = F.try_divide(rest, (n - 1) * (k - 1))
    icc = F.try_divide(msr - mse, msr + (k - 1) * mse + k * (msc - mse) / n)
    balanced = (F.col("_k") == F.col("_k_min")) & (F.col("_k") == F.col("_runs"))
    differ = total > 1e-12 * F.col("_sq") * n * k
    return subject_sums.join(run_sums, keys).select(
        *keys, F.col("_runs").alias("runs"),
        F.when(balanced & differ & (F.col("_runs") >= 2), icc).alias("icc"),
    )


def kappa_consistency(per_run: DataFrame, keys: list[str]) -> DataFrame:
    """Mean kappa, sample SD (0 for a single run) and kappas in run order.

    Where the kappa of any run is undefined, so are mean and SD.
    """
    by_run = F.array_sort(F.collect_list(F.struct("run_idx", "kappa")))
    whole = F.count("kappa") == F.count("*")
    spread = F.when(F.count("*") == 1, F.lit(0.0)).otherwise(F.stddev_samp("kappa"))
    return per_run.groupBy(*keys).agg(
        F.when(whole, F.avg("kappa")).alias("mean_kappa"),
        F.when(whole, spread).alias("std_kappa"),
        F.transform(by_run, lambda r: r.kappa).alias("kappas_per_run"),
    )


def best_run(per_run: DataFrame, keys: list[str]) -> DataFrame:
    """The run with the highest kappa, first on ties; undefined kappas come last."""
    order = Window.partitionBy(*keys).orderBy(F.col("kappa").desc_nulls_last(), "run_idx")
    return (
        per_run.withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") == 1)
        .drop("_place")
        .withColumnRenamed("run_idx", "best_run_idx")
    )


def condition_summary(preds: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, best_run_idx, best_metrics, consistency: one row per condition."""
    patterns = materialize(rating_patterns(preds, keys), "patterns")
    return summary_from_patterns(patterns, keys)


def summary_from_patterns(patterns: DataFrame, keys: list[str]) -> DataFrame:
    per_run = materialize(run_metrics(patterns, keys), "run_metrics")
    return (
        best_run(per_run, keys)
        .join(kappa_consistency(per_run, keys), keys)
        .join(icc_two_way(patterns, keys).select(*keys, "icc"), keys)
        .select(
            *keys, "best_run_idx",
            F.struct(*METRICS).alias("best_metrics"),
            F.struct("mean_kappa", "std_kappa", "icc", "kappas_per_run").alias("consistency"),
        )
    )


def metrics_table(summary: DataFrame) -> DataFrame:
    """Flat metrics columns from the nested summary, other columns kept."""
    keep = [c for c in summary.columns if c not in ("best_metrics", "consistency")]
    return summary.select(
        *keep, *[F.col(f"best_metrics.{m}") for m in ("kappa", "accuracy", "precision", "recall", "f1")],
        *[F.col(f"consistency.{m}") for m in ("mean_kappa", "std_kappa", "icc")],
    )
