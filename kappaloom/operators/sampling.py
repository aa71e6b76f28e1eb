"""Reproducible draws: stratified pool, test set, uniform sample, round-robin examples.

Every draw orders rows by a hash of (seed, item id). The result depends on neither
the order, the partitioning nor the other datasets of a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kappaloom.fixed_values import DEFAULT_POOL_PER_LABEL, DEFAULT_SEED
from kappaloom.session import materialize

BUCKET_HEX_DIGITS = 4  # 65,536 hash buckets per group
#: draws of up to so many rows are one pass: the planner's group limit leaves as many of a task's rows
SMALL_DRAW, SALTS = 100, 64


def draw_key(seed: int, item_col: str = "item_id") -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(item_col).cast("string")))


def first_by_hash(df: DataFrame, groups: list[str], n: int, seed: int) -> DataFrame:
    """The ``n`` rows of every group with the smallest draw key, and their ``draw_rank``.

    Rows are counted per hash bucket, which combines inside each task. A running sum over a
    group's buckets, not its rows, tells how many rows lie before each bucket; buckets that
    begin beyond the n-th row are left out and the rows of the others are ranked bucket by
    bucket. So no group is ever ranked in one task, whatever its size and ``n``.

    A small ``n`` needs one pass and no table: each task sends its ``n`` smallest of every group and
    salt, the salts of a group keep ``n`` each, and at most SALTS * ``n`` rows are ranked.
    """
    if n <= SMALL_DRAW:
        return _few_by_hash(df, groups, n, seed)
    keyed = df.withColumn("_key", draw_key(seed)).withColumn(
        "_bucket", F.substring("_key", 1, BUCKET_HEX_DIGITS))
    per_bucket = keyed.groupBy(*groups, "_bucket").agg(F.count("*").alias("_rows"))
    running = Window.partitionBy(*groups).orderBy("_bucket")
    before = F.coalesce(F.sum("_rows").over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = materialize(
        per_bucket.withColumn("_before", before).where(F.col("_before") < n).drop("_rows"), "draw_buckets")
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_key", "item_id")
    return (
        keyed.join(needed, [*groups, "_bucket"])
        .withColumn("draw_rank", (F.col("_before") + F.row_number().over(inside)).cast("int"))
        .where(F.col("draw_rank") <= n)
        .select(*df.columns, "draw_rank")
    )


def _few_by_hash(df: DataFrame, groups: list[str], n: int, seed: int) -> DataFrame:
    keyed = df.withColumn("_key", draw_key(seed)).withColumn(
        "_salt", F.pmod(F.xxhash64("item_id"), F.lit(SALTS)).cast("int"))
    for inside in ([*groups, "_salt"], groups):
        order = Window.partitionBy(*inside).orderBy("_key", "item_id")
        keyed = keyed.withColumn("draw_rank", F.row_number().over(order)).where(F.col("draw_rank") <= n)
    return keyed.select(*df.columns, "draw_rank")


def stratified_pool(
    items: DataFrame, n_per_label: int = DEFAULT_POOL_PER_LABEL, seed: int = DEFAULT_SEED
) -> DataFrame:
    """(dataset, item_id, label, rank_in_label): the example pool, keys only.

    Reads ids and labels, never the texts.
    """
    keys = items.select("dataset", "item_id", F.col("gold").alias("label"))
    drawn = first_by_hash(keys, ["dataset", "label"], n_per_label, seed)
    return drawn.withColumnRenamed("draw_rank", "rank_in_label")


def test_split(items: DataFrame, pool: DataFrame) -> DataFrame:
    """Items outside the pool.

    Pass a pool that was written once (``materialize``): its size is then known, the
    planner broadcasts it while it is small, and the texts never move.
    """
    return items.join(pool.select("dataset", "item_id"), ["dataset", "item_id"], "left_anti")


test_split.__test__ = False  # not a pytest case


def uniform_sample(items: DataFrame, size: int | None, seed: int = DEFAULT_SEED) -> DataFrame:
    """Exactly ``size`` items of every dataset, or all of them where there are fewer.

    The sample is drawn on the keys, so that texts are not sorted; while the sample is small
    enough to be broadcast they are not moved either.
    """
    if size is None:
        return items
    keys = first_by_hash(items.select("dataset", "item_id"), ["dataset"], size, seed)
    drawn = materialize(keys.drop("draw_rank"), "sample")
    return items.join(drawn, ["dataset", "item_id"], "left_semi")


def round_robin_examples(pool: DataFrame, n: int) -> DataFrame:
    """(dataset, item_id, label, pos): ``n`` examples, one per label and round.

    A pool of at most ``n`` items is used whole and in label order. Strict rounds take a
    label's first n at most, and n + 1 rows tell whether a pool is larger than ``n``: the
    planner's group limit leaves that many per task and dataset before the shuffle.
    """
    whole = Window.partitionBy("dataset")
    rounds = whole.orderBy("rank_in_label", "label")
    by_label = whole.orderBy("label", "rank_in_label")
    first = (
        pool.where(F.col("rank_in_label") <= n + 1)
        .withColumn("round_pos", F.row_number().over(rounds))
        .where(F.col("round_pos") <= n + 1)
    )
    pos = F.when(
        F.count("*").over(whole) <= n, F.row_number().over(by_label)
    ).otherwise(F.col("round_pos"))
    return (
        first.withColumn("pos", pos)
        .where(F.col("pos") <= n)
        .select("dataset", "item_id", "label", "pos")
    )
