"""Connected components of a link table, by alternating stars on Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kappaloom.session import materialize


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")),
                    F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of every node below its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours below the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def star_roots(links: DataFrame) -> DataFrame:
    """(a, b): every node ``a`` of ``links`` (a, b) but the smallest of its component, and that one, b.

    Nodes are longs; self-links and repeats do no harm. Minima combine before the shuffle and
    the joins can be split by the planner, so a node with very many links is no single task.
    Each round is written to the shared folder and read back; rounds grow with the logarithm
    of the components' size.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(), "links")
    before = _fingerprint(edges)
    while before[0]:
        edges = materialize(_small_star(_large_star(edges).distinct()).distinct(), "stars")
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    return edges
