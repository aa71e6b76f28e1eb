"""Report tables over the metrics of all conditions: pivots on a dense, ordered index.

A layout orders and names axis values; it never leaves any out. Measured values it does not
list follow those it lists, in alphabetical order.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kappaloom import fixed_values as fixed
from kappaloom.functions.ids import CONDITION, experiment_id
from kappaloom.session import literal_table


@dataclass(frozen=True)
class Layout:
    """Order and display names of every report axis; by itself it lists no dataset or model."""

    datasets: tuple[str, ...] = ()
    models: tuple[str, ...] = ()
    shot_types: tuple[str, ...] = fixed.SHOT_TYPES
    lengths: tuple[str, ...] = fixed.LENGTHS
    context_levels: tuple[str, ...] = fixed.CONTEXT_LEVELS
    covers_all: bool = False
    names: dict[str, str] = field(default_factory=lambda: {
        **fixed.DATASET_NAMES, **fixed.MODEL_NAMES, **fixed.SHOT_NAMES,
        **fixed.LENGTH_NAMES, **fixed.CONTEXT_NAMES,
    })

    AXES = {
        "dataset": "datasets", "model": "models", "shot_type": "shot_types",
        "length": "lengths", "context_level": "context_levels",
    }

    def values(self, axis: str) -> tuple[str, ...]:
        return getattr(self, self.AXES[axis])

    def name(self, value: str) -> str:
        return self.names.get(value, value)

    def covering(self, metrics: DataFrame) -> "Layout":
        """This layout with the values of ``metrics`` it does not list behind those it lists."""
        if self.covers_all:
            return self
        found = metrics.agg(*[F.sort_array(F.collect_set(a)).alias(a) for a in self.AXES]).first()
        return replace(self, covers_all=True, **{
            attribute: (*self.values(a), *[v for v in found[a] if v not in self.values(a)])
            for a, attribute in self.AXES.items()
        })


#: The order of the published tables.
PUBLISHED = Layout(datasets=fixed.DATASET_ORDER, models=fixed.MODEL_ORDER)


def rounded(c: Column | str) -> Column:
    """Three places, half to even; missing stays missing."""
    return F.bround(c, 3)


def defined(c: str) -> Column:
    """NaN reads as missing, so that max, sort and pivot skip it."""
    return F.nullif(F.col(c), F.lit(float("nan")))


def display(axis: str, layout: Layout) -> Column:
    """Display name of an axis value, the value itself where it has none."""
    out = F.col(axis)
    for value in layout.values(axis):
        out = F.when(F.col(axis) == value, layout.name(value)).otherwise(out)
    return out.alias(axis)


def position(axis: str, layout: Layout) -> Column:
    """Place of an axis value in the layout."""
    places = F.lit(None).cast("int")
    for i, value in enumerate(layout.values(axis)):
        places = F.when(F.col(axis) == value, i).otherwise(places)
    return places


def dense(table: DataFrame, axes: list[str], layout: Layout) -> DataFrame:
    """One row per combination of the layout's axis values, missing cells null."""
    spark = table.sparkSession
    rows = [()]
    for axis in axes:
        rows = [(*row, v) for row in rows for v in layout.values(axis)]
    index = literal_table(spark, pa.schema([(a, pa.string()) for a in axes]), rows)
    return index.join(table, axes, "left")


def ordered(table: DataFrame, axes: list[str], layout: Layout) -> DataFrame:
    """Rows in the layout's order, axis values replaced by their display names."""
    rest = [c for c in table.columns if c not in axes]
    return table.orderBy(*[position(a, layout) for a in axes]).select(
        *[display(a, layout) for a in axes], *rest
    )


def _pivot(metrics: DataFrame, axes: list[str], columns: str, layout: Layout) -> DataFrame:
    values = list(layout.values(columns))
    return (
        metrics.withColumn("kappa", defined("kappa"))
        .groupBy(*axes).pivot(columns, values).agg(F.max("kappa"))
        .select(*axes, *[rounded(F.col(f"`{v}`")).alias(layout.name(v)) for v in values])
    )


def kappa_by_shot(metrics: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Best kappa per dataset and shot type, one column per model."""
    layout = layout.covering(metrics)
    axes = ["dataset", "shot_type"]
    return ordered(dense(_pivot(metrics, axes, "model", layout), axes, layout), axes, layout)


def kappa_by_length(metrics: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Best kappa per dataset and model, one column per prompt length.

    Holds the dataset-model pairs that were measured, in alphabetical order.
    """
    layout = layout.covering(metrics)
    axes = ["dataset", "model"]
    names = [layout.name(v) for v in layout.lengths]
    measured = _pivot(metrics, axes, "length", layout).where(
        F.coalesce(*[F.col(f"`{n}`") for n in names]).isNotNull()
    )
    return measured.orderBy(*axes).select(
        *[F.col(a) for a in axes], *[F.col(f"`{n}`") for n in names]
    )


def kappa_by_context(metrics: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Best kappa per dataset and context level, one column per model."""
    layout = layout.covering(metrics)
    axes = ["dataset", "context_level"]
    return ordered(dense(_pivot(metrics, axes, "model", layout), axes, layout), axes, layout)


def consistency_report(metrics: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """SD and ICC per dataset and model under few-shot, long, full-context prompts."""
    layout = layout.covering(metrics)
    axes = ["dataset", "model"]
    rows = metrics.where(
        (F.col("length") == "long") & (F.col("context_level") == "full_context")
        & (F.col("shot_type") == "few_shot")
    ).select(
        *axes, rounded(defined("std_kappa")).alias("SD"), rounded(defined("icc")).alias("ICC")
    )
    return ordered(dense(rows, axes, layout), axes, layout)


REPORTED = {"accuracy": "Accuracy", "precision": "Precision", "recall": "Recall", "f1": "F1"}


def full_metrics(metrics: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Best value of each metric per dataset, shot type and model.

    Each metric is maximised by itself, so one row may mix conditions.
    """
    layout = layout.covering(metrics)
    axes = ["dataset", "shot_type", "model"]
    best = metrics.groupBy(*axes).agg(
        *[rounded(F.max(defined(m))).alias(name) for m, name in REPORTED.items()]
    )
    return ordered(dense(best, axes, layout), axes, layout)


def full_metrics_best_condition(metrics: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Like ``full_metrics``, with all values from the condition of highest kappa."""
    layout = layout.covering(metrics)
    axes = ["dataset", "shot_type", "model"]
    best = _highest_kappa(metrics, axes).select(
        *axes, *[rounded(defined(m)).alias(name) for m, name in REPORTED.items()]
    )
    return ordered(dense(best, axes, layout), axes, layout)


def _highest_kappa(metrics: DataFrame, axes: list[str]) -> DataFrame:
    order = Window.partitionBy(*axes).orderBy(
        F.col("kappa").desc_nulls_last(), experiment_id(*CONDITION)
    )
    return (
        metrics.withColumn("kappa", defined("kappa"))
        .withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") == 1)
        .drop("_place")
    )


def best_conditions(metrics: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """The condition of highest kappa per dataset and model, for pairs that have one."""
    layout = layout.covering(metrics)
    axes = ["dataset", "model"]
    best = _highest_kappa(metrics, axes).where(F.col("kappa").isNotNull()).select(
        *CONDITION, rounded("kappa").alias("kappa")
    )
    return ordered(best, axes, layout)


def shot_comparison(
    metrics: DataFrame, layout: Layout = Layout(), length: str = "long",
    context_level: str = "full_context",
) -> DataFrame:
    """All five metrics by shot type at one prompt length and context level."""
    layout = layout.covering(metrics)
    axes = ["dataset", "model", "shot_type"]
    rows = metrics.where(
        (F.col("length") == length) & (F.col("context_level") == context_level)
    ).select(*axes, *[rounded(defined(m)).alias(m) for m in ("kappa", *REPORTED)])
    return ordered(rows, axes, layout)


def shot_by_length(
    metrics: DataFrame, layout: Layout = Layout(), context_level: str = "full_context"
) -> DataFrame:
    """Kappa matrix shot type x prompt length at one context level."""
    layout = layout.covering(metrics)
    axes = ["dataset", "model", "shot_type"]
    rows = metrics.where(F.col("context_level") == context_level)
    return ordered(_pivot(rows, axes, "length", layout), axes, layout)


REPORTS = {
    "kappa_by_shot": kappa_by_shot,
    "kappa_by_length": kappa_by_length,
    "consistency": consistency_report,
    "kappa_by_context": kappa_by_context,
    "full_metrics": full_metrics,
    "best_conditions": best_conditions,
    "shot_comparison": shot_comparison,
    "shot_by_length": shot_by_length,
}
