"""Mixing sources to target weights by Pareto order sampling; built-in functions only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window, functions as F

from kappaloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: cells of one level of the rank histogram; two levels narrow a cut to 1 / CELLS^2 of a source
CELLS = 4096
#: how strongly longer texts are preferred among those that can get one more copy, 0 to 1
LEAN = 0.5
TYPICAL_WORDS = 200


def _numbered(sources: DataFrame) -> DataFrame:
    """The sources with their place ``no`` in code-point order, null last, from 0.

    Places come from a range exchange and the sizes of its parts, never from one task.
    """
    spark = sources.sparkSession
    order = F.col("source").asc_nulls_last()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(
        sources.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return dealt.join(F.broadcast(offsets), "part").withColumn(
        "no", F.col("offset") + inside - 1).drop("part", "offset")


def _water_level(sources: DataFrame, cap: int) -> tuple[int, int]:
    """(words, weight) that the sources below their cap share, once none is above it."""
    words, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    words, weight = int(words or 0), int(weight or 0)
    total = words
    while True:
        capped = _capped(words, weight, cap)
        row = sources.agg(
            F.sum(F.when(capped, F.col("source_size") * cap)), F.sum(F.when(~capped, F.col("weight")))).first()
        level = total - int(row[0] or 0), int(row[1] or 0)
        if level == (words, weight):
            return level
        words, weight = level


def _capped(words: int, weight: int, cap: int):
    """Whether a source's share of the level is above ``cap`` times its size, in whole numbers."""
    size, own = F.col("source_size").cast("decimal(19,0)"), F.col("weight").cast("decimal(9,0)")
    return size * F.lit(Decimal(cap * max(weight, 1))) < own * F.lit(Decimal(words))


def source_targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """``sources`` (source, source_size, ...) with no, weight and target (double).

    All sizes together are shared by weight; a target stops at ``cap`` times the source's size
    and the excess is shared again until none is above.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    weighted = materialize(_numbered(sources).withColumn(
        "weight", F.element_at(cycle, (F.pmod("no", F.lit(len(weights))) + 1).cast("int"))), "weights")
    words, weight = _water_level(weighted, cap)
    return weighted.withColumn("target", F.when(
        _capped(words, weight, cap), (F.col("source_size") * cap).cast("double"),
    ).otherwise(F.lit(float(words)) * F.col("weight") / F.lit(float(max(weight, 1)))))


def _cut(cells: DataFrame, cell: str, start) -> DataFrame:
    """(no, cell, before): the cell of each source in which its wanted words are reached."""
    order = Window.partitionBy("no").orderBy(cell)
    upto = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return cells.withColumn("upto", start + upto).where("upto > wanted").withColumn(
        "first", F.row_number().over(order)).where("first = 1").select(
        "no", cell, (F.col("upto") - F.col("words")).alias("before"))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, ``keep`` columns): how often each row is taken.

    Size is the number of words, 0 for null. ``target`` is the share of the row's source, see
    ``source_targets``; null is a source, the last one. Every row gets the whole part of
    target / source_size as certain copies. For the rest of the target, rows come in Pareto
    order: random odds over inclusion odds. The inclusion probability of one more copy leans to
    longer texts around the source's fraction such that the expected words are the rest. Rows
    are taken in that order until their words come nearest to the rest: a sample of fixed size
    in words. No row gets more than ``cap`` copies.

    Random numbers are a hash of seed and id, or text without one: reruns agree, whatever the partitioning. Repeated
    rows have one place in the order, rows of one id too; ties are taken in any order. A row
    without words is taken with 0. An empty table gives an empty one.
    """
    picked = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.when(F.col(id_col).isNull(), F.concat(F.lit("-"), F.xxhash64(text_col).cast("string"))).alias("stand_in"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep])
    sized = materialize(picked, "sizes")
    # Whole thousandths: their sums are the same in any order.
    merit = F.floor(F.col("size") * 1000 / (F.col("size") + TYPICAL_WORDS))
    sources = sized.withColumn("merit", merit).groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("merit") * F.col("size")).alias("merits"))
    targets = source_targets(sources, weights, cap)
    some = F.col("source_size") > 0
    whole = F.when(some, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("whole", whole.cast("long")).withColumn(
        "wanted", F.col("target") - F.col("whole") * F.col("source_size")).withColumn(
        "share", F.when(some, F.col("wanted") / F.col("source_size")).otherwise(F.lit(0.0))).withColumn(
        "mean_merit", F.when(some, F.col("merits") / F.col("source_size")).otherwise(F.lit(0.0)))
    targets = materialize(targets.withColumnRenamed("source", "_source").drop("merits", "weight"), "targets")
    drawn = F.conv(F.substring(F.md5(F.concat(
        F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.col("stand_in"), F.lit("")))), 1, 13), 16, 10).cast("long")
    u = (drawn + F.lit(0.5)) / F.lit(float(1 << 52))
    lean = F.lit(LEAN) * F.least(F.col("share"), 1 - F.col("share")) * (
        (merit - F.col("mean_merit")) / 1000)
    chance = F.col("share") + lean
    rank = F.when(F.col("share") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (1 - F.col("chance"))))
    ranked = (
        sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
        .withColumn("u", u).withColumn("chance", chance).withColumn("rank", rank)
        .withColumn("place", F.col("rank") / (1 + F.col("rank")))
        .withColumn("cell", F.floor(F.col("place") * CELLS).cast("int"))
        .withColumn("fine", F.floor(F.col("place") * (CELLS * CELLS)).cast("int"))
        .drop("u", "chance", "rank", "share", "mean_merit", "stand_in")
    )
    ranked = materialize(ranked, "ranked")
    sums = lambda rows, *by: rows.groupBy("no", *by).agg(
        F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
    cut = materialize(_cut(sums(ranked.where("cell is not null"), "cell"), "cell", F.lit(0)), "cuts")
    edge = cut.select("no", F.col("cell").alias("edge"), F.col("before").alias("ahead"))
    near = ranked.join(edge, "no").where("cell = edge")
    cells = sums(near, "fine", "ahead")
    fine = materialize(_cut(cells, "fine", F.col("ahead")), "fine_cuts").select(
        "no", F.col("fine").alias("fine_edge"), F.col("before").alias("fine_ahead"))
    # A source whose wanted words are never passed is taken whole up to its last row.
    placed = ranked.join(edge.drop("ahead"), "no", "left").join(fine, "no", "left")
    inside = F.col("fine") == F.col("fine_edge")
    order = Window.partitionBy("no", "inside").orderBy("place", "doc_id", "size")
    last = placed.withColumn("inside", inside).where("inside").withColumn(
        "upto", F.col("fine_ahead") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    crossing = (F.col("upto") - F.col("wanted")) <= (F.col("wanted") - (F.col("upto") - F.col("size")))
    last = last.withColumn("extra", ((F.col("upto") <= F.col("wanted")) | (
        crossing & (F.col("upto") - F.col("size") < F.col("wanted")))).cast("long"))
    rest = placed.where(~F.coalesce(inside, F.lit(False))).withColumn(
        "extra", (F.col("place").isNotNull() & (
            F.col("fine_edge").isNull() | (F.col("fine") < F.col("fine_edge")))).cast("long"))
    out = ["doc_id", "size", "source_size", "target", "extra", "whole", *[f"_keep_{c}" for c in keep]]
    copies = F.col("whole") + F.col("extra")
    return rest.select(*out).unionByName(last.select(*out)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"),
        copies.alias("copies"), *[F.col(f"_keep_{c}").alias(c) for c in keep])
