"""Cleaning of labelled items and the label vocabulary."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from kappaloom.fixed_values import NA_TOKENS
from kappaloom.functions.text import strip_space


def na_to_null(c: Column, tokens: Iterable[str] = NA_TOKENS) -> Column:
    """Cell texts that mean "missing" become null."""
    return F.when(~c.isin(*tokens), c)


def clean_items(items: DataFrame, na_tokens: Iterable[str] | None = None) -> DataFrame:
    """Drop rows without text or gold label, trim both, drop rows that are then empty."""
    columns = ("text", "gold")
    if na_tokens is not None:
        tokens = tuple(na_tokens)
        items = items.withColumns({c: na_to_null(F.col(c), tokens) for c in columns})
    return (
        items.dropna(subset=list(columns))
        .withColumns({c: strip_space(F.col(c)) for c in columns})
        .where((F.col("text") != "") & (F.col("gold") != ""))
    )


def label_vocabulary(items: DataFrame) -> DataFrame:
    """(dataset, label, label_ord): distinct gold labels in code-point order.

    Only the distinct pairs reach the window, so its groups are as small as a codebook.
    """
    order = Window.partitionBy("dataset").orderBy("label")
    return (
        items.select("dataset", F.col("gold").alias("label"))
        .distinct()
        .withColumn("label_ord", F.row_number().over(order) - 1)
    )
