"""Item sources: labelled CSV files and tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kappaloom.fixed_values import LABEL_COLUMN, NA_TOKENS, TEXT_COLUMN
from kappaloom.operators.cleaning import na_to_null
from kappaloom.session import materialize, spread


def read_items_csv(
    spark: SparkSession, path: str, dataset: str, *, text_col: str = TEXT_COLUMN,
    label_col: str = LABEL_COLUMN, id_col: str | None = None, encoding: str = "UTF-8",
    na_tokens: Iterable[str] = NA_TOKENS, multi_line: bool = True,
) -> DataFrame:
    """(dataset, item_id, text, gold) from CSV with a header; a missing path is an error.

    Cells may hold quotes (doubled) and line breaks. A byte order mark is skipped. Large
    files whose cells hold no line breaks are split among tasks with ``multi_line=False``.
    ``item_id`` is the number in ``id_col``. Without one it is 60 bits of a hash of text, label
    and copy number, so it holds however the file is split or ordered: rows of one content are
    interchangeable. The content is hashed as it is in the file, before any trimming.
    """
    raw = (
        spark.read.option("header", True).option("quote", '"').option("escape", '"')
        .option("multiLine", multi_line).option("encoding", encoding)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    header = {name.removeprefix("﻿").strip('"'): name for name in raw.columns}
    missing = [c for c in (text_col, label_col, *filter(None, [id_col])) if c not in header]
    if missing:
        raise ValueError(f"columns {missing} not in the header of {path}")
    tokens = tuple(na_tokens)
    cells = raw.select(
        na_to_null(F.col(f"`{header[text_col]}`"), tokens).alias("text"),
        na_to_null(F.col(f"`{header[label_col]}`"), tokens).alias("gold"),
        *[F.col(f"`{header[id_col]}`").cast("long").alias("item_id")] if id_col else [],
    )
    if not id_col:
        cells = _with_content_ids(cells)
    return cells.select(F.lit(dataset).alias("dataset"), "item_id", "text", "gold")


def _with_content_ids(cells: DataFrame) -> DataFrame:
    """Number the copies of each content part by part, so that none is ranked in one task."""
    content = F.sha2(F.concat_ws("|", F.coalesce(F.concat(F.lit("t"), "text"), F.lit("-")), F.coalesce(F.concat(F.lit("l"), "gold"), F.lit("-"))), 256)
    held = materialize(
        cells.withColumn("_content", content).withColumn("_part", F.spark_partition_id()), "csv_cells")
    before = Window.partitionBy("_content").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = held.groupBy("_content", "_part").agg(F.count("*").alias("_n")).select(
        "_content", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_content", "_part").orderBy(F.lit(0)))
    copy = (F.col("_before") + inside).cast("string")
    number = F.conv(F.substring(F.md5(F.concat_ws("|", "_content", copy)), 1, 15), 16, 10)
    return held.join(parts, ["_content", "_part"]).withColumn("item_id", number.cast("long"))


def read_table_items(
    spark: SparkSession, path: str, dataset: Column, item_id: Column, text: Column, gold: Column
) -> DataFrame:
    """(dataset, item_id, text, gold) from a Parquet table with a key of its own."""
    scan = spark.read.parquet(path).select(
        dataset.alias("dataset"), item_id.cast("long").alias("item_id"),
        text.alias("text"), gold.alias("gold"),
    )
    return spread(scan, "item_id")
