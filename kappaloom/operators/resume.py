"""What is still to do: skip finished runs and finished items.

Runs are numbered. What an item still needs is a short list of run numbers beside its key:
the grid is never laid over the items, and each saved answer is looked at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ITEM = ["dataset", "item_id"]


def runs_of_dataset(runs: DataFrame) -> DataFrame:
    """(dataset, runs): the numbers of all wanted runs, from (dataset, run_no); a few rows."""
    return runs.groupBy("dataset").agg(F.sort_array(F.collect_set("run_no")).alias("runs"))


def finished_by_item(saved: DataFrame, keep_failed: bool = False) -> DataFrame:
    """(dataset, item_id, done): run numbers that need no further request.

    ``saved`` has dataset, item_id, run_no and error. Failed requests are tried again unless
    ``keep_failed``. One shuffle by item, whose groups are as small as the grid.
    """
    rows = saved if keep_failed else saved.where(F.col("error").isNull())
    return rows.groupBy(*ITEM).agg(F.sort_array(F.collect_set("run_no")).alias("done"))


def open_runs(items: DataFrame, runs: DataFrame, saved: DataFrame, keep_failed: bool = False) -> DataFrame:
    """``items`` with ``open``: the numbers of the wanted runs without a usable saved answer.

    Items with none left are dropped. ``runs`` has dataset and run_no.
    """
    done = F.coalesce(F.col("done"), F.array().cast("array<int>"))
    return (
        items.join(finished_by_item(saved, keep_failed).hint("shuffle_merge"), ITEM, "left")
        .join(F.broadcast(runs_of_dataset(runs)), "dataset")
        .withColumn("open", F.array_except(F.col("runs"), done))
        .where(F.size("open") > 0)
        .drop("done", "runs")
    )


def run_number(n_runs: int) -> Column:
    """Number of a run within the grid, from cond_id and run_idx."""
    return (F.col("cond_id") * n_runs + F.col("run_idx")).cast("int")


def open_rows(open_items: DataFrame) -> DataFrame:
    """(dataset, item_id, run_no), one row for each request still to make."""
    return open_items.select(*ITEM, F.explode("open").alias("run_no"))


def unfinished_runs(open_items: DataFrame) -> DataFrame:
    """(run_no): runs that some item still needs; counted inside each task first."""
    return open_items.select(F.explode("open").alias("run_no")).distinct()
