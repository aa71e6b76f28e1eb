"""Experiment and run ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kappaloom.fixed_values import ID_SEPARATOR, RUN_MARK

CONDITION = ["dataset", "model", "shot_type", "length", "context_level"]


def experiment_id(*parts: Column | str) -> Column:
    return F.concat_ws(ID_SEPARATOR, *(parts or CONDITION))


def run_id(exp_id: Column | str, run_idx: Column | str) -> Column:
    exp_id = F.col(exp_id) if isinstance(exp_id, str) else exp_id
    run_idx = F.col(run_idx) if isinstance(run_idx, str) else run_idx
    return F.concat(exp_id, F.lit(RUN_MARK), run_idx.cast("string"))


def parse_experiment_ids(df: DataFrame, id_col: str = "exp_id") -> DataFrame:
    """Add the five condition columns; rows whose id has fewer than five parts drop out."""
    parts = F.split(F.col(id_col), ID_SEPARATOR)
    return df.where(F.size(parts) >= len(CONDITION)).withColumns(
        {name: F.get(parts, F.lit(i)) for i, name in enumerate(CONDITION)}
    )
