"""The condition grid: dataset x model x shot type x prompt length x context x run."""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kappaloom.fixed_values import (
    CONTEXT_LEVELS, DEFAULT_RUNS, LENGTHS, PROMPT_KEY_SEPARATOR, SHOT_TYPES,
)
from kappaloom.functions.ids import CONDITION, experiment_id, run_id
from kappaloom.session import literal_table

CONDITION_SCHEMA = pa.schema(
    [("cond_id", pa.int32()), *((name, pa.string()) for name in CONDITION)]
)


@dataclass(frozen=True)
class Grid:
    """Axes of an experiment; order is report order."""

    datasets: tuple[str, ...]
    models: tuple[str, ...]
    shot_types: tuple[str, ...] = SHOT_TYPES
    lengths: tuple[str, ...] = LENGTHS
    context_levels: tuple[str, ...] = CONTEXT_LEVELS
    n_runs: int = DEFAULT_RUNS

    def __post_init__(self):
        for given, known in (
            (self.shot_types, SHOT_TYPES),
            (self.lengths, LENGTHS),
            (self.context_levels, CONTEXT_LEVELS),
        ):
            unknown = set(given) - set(known)
            if unknown:
                raise ValueError(f"unknown values {sorted(unknown)}, expected some of {known}")

    def restrict(self, n_runs: int | None = None, **axes) -> "Grid":
        """Keep only the named values of an axis; axes not named stay whole."""
        kept = {
            axis: tuple(v for v in getattr(self, axis) if v in set(values))
            for axis, values in axes.items()
            if values is not None
        }
        return replace(self, **kept, n_runs=self.n_runs if n_runs is None else n_runs)

    def rows(self) -> list[tuple]:
        axes = product(
            self.datasets, self.models, self.shot_types, self.lengths, self.context_levels
        )
        return [(i, *row) for i, row in enumerate(axes)]

    def table(self, spark: SparkSession) -> DataFrame:
        return literal_table(spark, CONDITION_SCHEMA, self.rows())


def with_runs(conditions: DataFrame, n_runs: int) -> DataFrame:
    """One row per condition and run, with both ids."""
    runs = F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1)))
    return (
        conditions.withColumn("run_idx", runs)
        .withColumn("exp_id", experiment_id())
        .withColumn("run_id", run_id("exp_id", "run_idx"))
    )


def expand(items: DataFrame, conditions: DataFrame) -> DataFrame:
    """Every item under every condition of its dataset.

    An equi-join on the dataset with the literal grid, whose known size makes it a
    broadcast: items are not shuffled.
    """
    return items.join(conditions, "dataset")


def prompt_key():
    return F.concat_ws(PROMPT_KEY_SEPARATOR, "shot_type", "length", "context_level")
