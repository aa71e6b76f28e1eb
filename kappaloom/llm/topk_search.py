"""Exact top-k inner products with a pivot-distance index.

Vectors of whole numbers get one more coordinate that makes them equally long; then the largest
inner products are the smallest distances. Each vector is keyed by its nearest pivot and its
distance to it. A search looks at a pivot's annuli, sorted by distance, outwards from the
query's own distance, and stops where the triangle inequality rules out anything better than
the k-th best so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kappaloom.session import materialize

#: vectors of one block of a pivot, and queries that visit it together
BLOCK_ROWS = 8192
QUERY_ROWS = 4096
#: vectors of one annulus, looked at together
ANNULUS = 256


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null for a vector that is null or holds a component
    that is null or not finite."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(as_double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    whole = F.transform(as_double, lambda x: F.floor(x * scale).cast("long"))
    return F.when(vector.isNotNull() & ~bad, whole)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; shorter ones end in zeros."""
    size = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy().astype(np.float64)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class Pivots:
    """Pivots in the lifted space, and the squared length ``top`` that all vectors are lifted to."""

    def __init__(self, sample: np.ndarray, number: int, top: float):
        self.top = top
        lifted = self.lift(sample)
        # Far points first: each next pivot is the sample row farthest from those chosen.
        chosen = [0] if len(lifted) else []
        far = ((lifted - lifted[:1]) ** 2).sum(1)
        while len(chosen) < min(number, len(lifted)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((lifted - lifted[chosen[-1]]) ** 2).sum(1))
        self.points = lifted[chosen]

    def lift(self, rows: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(rows)) if query else np.sqrt(np.maximum(self.top - (rows ** 2).sum(1), 0.0))
        return np.column_stack([rows, rest])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        square = (lifted ** 2).sum(1)[:, None] - 2 * lifted @ self.points.T + (self.points ** 2).sum(1)
        return np.sqrt(np.maximum(square, 0.0))


def _exact(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products as longs; in doubles where these hold them exactly."""
    bound = np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * max(rows.shape[1], 1)
    if bound < 2 ** 53:
        return (rows @ queries.T).astype(np.int64)
    return rows.astype(np.int64) @ queries.astype(np.int64).T


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, pivots: int | None = None, sample_rows: int = 4096,
    id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query row the k best other rows.

    Vectors are ``quantised``; the score is their inner product, ties go to the smaller id. A
    row is no candidate for itself. Equal rows count once; rows of one id with different vectors
    are candidates each, also for one another, and a query id with several vectors is a query
    with ranks of its own for each. Vectors of unequal lengths compare as if zeros followed the
    shorter ones. Null ids and unusable vectors take no part. Fewer than k candidates are all told;
    an empty table gives an empty result. Sums beyond a long wrap around.

    The pivots, as many as the square root of the rows, 64 at least and a quarter of the sample at
    most unless ``pivots`` says so, are chosen from ``sample_rows`` rows at most, drawn by a hash;
    every row is indexed. Equal vectors are one entry with its k + 1 smallest ids, which decide every
    search, so a very common vector is no large group. A pivot's entries are cut into blocks of
    about ``BLOCK_ROWS`` by a hash, sorted by distance; the queries that cannot rule out a pivot
    visit its blocks in portions of about ``QUERY_ROWS``; a block is sent to the portions that visit it. What is known to the driver is the
    bounded sample and a row of bounds for each pivot.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("q"),
    ).where("id is not null and v is not null").groupBy("id", "v").agg(F.max("q").alias("q"))
    rows = materialize(rows, "vectors")
    measure = rows.agg(
        F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x.cast("double"))),
        F.count(F.when(F.col("q"), 1))).first()
    n, width, top, n_queries = measure[0], int(measure[1] or 0), float(measure[2] or 0.0), measure[3]
    out_schema = "query_id long, rank int, vec_id long, score long"
    if not n or not n_queries:
        return spark.createDataFrame([], out_schema)
    drawn = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(max(n // sample_rows, 1))) == 0).select("id", "v")
    sample = drawn.limit(2 * sample_rows).collect() or rows.select("id", "v").limit(1).collect()
    matrix = np.zeros((len(sample), width))
    for i, row in enumerate(sorted(sample)):
        matrix[i, :len(row["v"])] = row["v"]
    index = Pivots(matrix, pivots or max(64, min(math.isqrt(n), sample_rows // 4)), top)

    by_id = Window.partitionBy("v").orderBy("id")
    entries = rows.select("v", "id").withColumn("nth", F.row_number().over(by_id)).where(
        F.col("nth") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # Equal query vectors are one search; its number is fixed by being written.
    queries = materialize(rows.where("q").select("v").distinct().withColumn("q_id", F.monotonically_increasing_id()), "queries")

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = index.distances(index.lift(_matrix(batch.column("v"), width)))
            near = away.argmin(1) if len(away) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(near)), near])],
                [*batch.schema.names, "pivot", "away"])

    keyed = materialize(entries.mapInArrow(key_rows, "v array<long>, ids array<long>, pivot int, away double"), "keyed")
    bounds = {r["pivot"]: (r["n"], r["near"], r["far"]) for r in keyed.groupBy("pivot").agg(
        F.count("*").alias("n"), F.min("away").alias("near"), F.max("away").alias("far")).collect()}
    blocks = {p: -(-b[0] // BLOCK_ROWS) for p, b in bounds.items()}
    parts = -(-n_queries // QUERY_ROWS)
    slack = 1e-6 * (1.0 + math.sqrt(top))

    def visits(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        """The pivots (and blocks) a query visits: the nearest, then all others in its reach."""
        for batch in batches:
            away = index.distances(index.lift(_matrix(batch.column("v"), width), query=True))
            reach = None if first else batch.column("reach").to_numpy(zero_copy_only=False)
            order = sorted(bounds)
            gap = np.stack([np.maximum(np.maximum(bounds[p][1] - away[:, p], away[:, p] - bounds[p][2]), 0)
                            for p in order], 1)
            nearest = np.stack([np.where(gap[:, i] == gap.min(1), away[:, p], np.inf) for i, p in enumerate(order)], 1).argmin(1)
            hit = np.zeros(gap.shape, bool)
            hit[np.arange(len(hit)), nearest] = True
            if not first:
                hit = ~hit & (gap <= reach[:, None] + slack)
            q, i = np.nonzero(hit)
            p = np.array(order, np.int32)[i]
            times = np.array([blocks[x] for x in p.tolist()], np.int64)
            q, p, i = np.repeat(q, times), np.repeat(p, times), np.repeat(i, times)
            block = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays(
                [batch.column("q_id").take(pa.array(q)), batch.column("v").take(pa.array(q)),
                 pa.array(p), pa.array(block.astype(np.int32)),
                 pa.array(away[q, p]),
                 pa.array(np.full(len(q), np.inf) if first else reach[q])],
                ["q_id", "v", "pivot", "block", "q_away", "reach"])

    visit_schema = "q_id long, v array<long>, pivot int, block int, q_away double, reach double"

    def search(key, entry: pa.Table, query: pa.Table) -> pa.Table:
        found = {"q_id": [], "ids": [], "score": [], "same": []}
        if entry.num_rows and query.num_rows:
            entry = entry.sort_by("away")
            away = entry["away"].to_numpy()
            vectors_ = _matrix(entry["v"].combine_chunks(), width)
            size, asked_size = (x["v"].combine_chunks().value_lengths().to_numpy() for x in (entry, query))
            ids = entry["ids"].to_pylist()
            count = np.array([len(x) for x in ids])
            first_id = np.array([x[0] for x in ids])
            asked = _matrix(query["v"].combine_chunks(), width)
            square = (asked ** 2).sum(1) + top
            for j, (q_id, at, reach) in enumerate(zip(
                    query["q_id"].to_pylist(), query["q_away"].to_numpy(), query["reach"].to_numpy())):
                score, pick = _expand_annuli(vectors_, away, count, first_id, asked[j], square[j], at, reach + slack, k, slack)
                found["q_id"] += [q_id] * len(pick)
                found["ids"] += [ids[i] for i in pick.tolist()]
                found["score"] += score.tolist()
                same = (size[pick] == asked_size[j]) & (vectors_[pick] == asked[j]).all(1)
                found["same"] += same.tolist()
        return pa.table(found, pa.schema([
            ("q_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.int64()), ("same", pa.bool_())]))

    def run(asked: DataFrame, first: bool) -> DataFrame:
        part = F.pmod(F.xxhash64("q_id"), F.lit(parts)).cast("int").alias("part")
        visit = materialize(asked.mapInArrow(lambda b: visits(b, first), visit_schema).withColumn("part", part), "visits")
        wanted = visit.select("pivot", "block", F.col("part").alias("to")).distinct()
        cut = F.create_map(*[x for p, b in blocks.items() for x in (F.lit(p), F.lit(b))])
        held = keyed.withColumn("block", F.pmod(F.xxhash64("v"), F.element_at(cut, F.col("pivot"))).cast("int"))
        held = held.join(wanted, ["pivot", "block"])
        found = held.groupBy("pivot", "block", "to").cogroup(
            visit.groupBy("pivot", "block", "part")).applyInArrow(
            search, "q_id long, ids array<long>, score long, same boolean")
        return found.select("q_id", "score", "same", F.explode("ids").alias("vec_id"))

    best = Window.partitionBy("q_id").orderBy(F.desc("score"), "vec_id")
    keep = lambda found: found.withColumn("nth", F.row_number().over(best)).where(
        F.col("nth") <= k + 1).drop("nth")
    start = materialize(keep(run(queries, True)), "nearest")
    # The row itself may be among the k + 1: the k-th best other row is not below the (k + 1)-th.
    floor = start.groupBy("q_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x.cast("double"))
    reach = F.when(F.col("n") > k, F.sqrt(F.greatest(
        norm + F.lit(top) - 2 * F.col("low"), F.lit(0.0)))).otherwise(F.lit(math.inf))
    asked = queries.join(floor, "q_id", "left").select("q_id", "v", reach.alias("reach"))
    found = keep(start.unionByName(run(asked, False)))
    # Back to every query row; equal query vectors were searched once.
    each = rows.where("q").select(F.col("id").alias("query_id"), F.col("v")).join(queries, "v").drop("v")
    mine = Window.partitionBy("query_id", "q_id").orderBy(F.desc("score"), "vec_id")
    return each.join(found, "q_id").where("not (same and vec_id = query_id)").withColumn(
        "rank", F.row_number().over(mine).cast("int")).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _expand_annuli(vectors, away, count, first_id, query, square, at, reach, k, slack):
    """(scores, entries) that can be among the k + 1 best ids of one query.

    ``away`` is sorted. Annuli of ``ANNULUS`` entries are taken by their gap to the query's own
    distance, nearest first, until the gap exceeds the reach, which shrinks to the distance of
    the (k + 1)-th best id found.
    """
    cut = np.arange(0, len(away), ANNULUS)
    low, high = away[cut], away[np.minimum(cut + ANNULUS, len(away)) - 1]
    gap = np.maximum(np.maximum(low - at, at - high), 0.0)
    scores, picks = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a in np.argsort(gap, kind="stable").tolist():
        if gap[a] > reach:
            break
        some = np.arange(cut[a], min(cut[a] + ANNULUS, len(away)))
        scores = np.concatenate([scores, _exact(vectors[some], query[None, :])[:, 0]])
        picks = np.concatenate([picks, some])
        order = np.lexsort((first_id[picks], -scores))[:k + 1]
        scores, picks = scores[order], picks[order]
        enough = np.searchsorted(np.cumsum(count[picks]), k + 1)
        if enough < len(picks):
            reach = min(reach, math.sqrt(max(square - 2.0 * float(scores[enough]), 0.0)) + slack)
    return scores, picks
