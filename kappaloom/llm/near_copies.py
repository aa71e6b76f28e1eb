"""Near copies by word shingles: SimHash and MinHash bands name the candidates, exact Jaccard similarity decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kappaloom.llm.arrow_text import portions, starts_of
from kappaloom.llm.components import star_roots
from kappaloom.llm.simhash import majorities, near_links, shingle_hashes
from kappaloom.session import materialize

#: Two sets of Jaccard similarity s share a band with chance 1 - (1 - s^BAND)^BANDS: 0.999997 at 0.8.
BANDS, BAND = 24, 4
#: fingerprints that link within so many bits meet, with all that hang together by such links
RADIUS = 4
#: shingles of one bucket above which it is cut into pairs of parts
UNIT_SHINGLES = 1 << 21
#: bytes of sets that a task holds besides its last unit
BUFFER_BYTES = 32 << 20

_DRAWN = np.random.default_rng(42).integers(0, 1 << 63, (BANDS * BAND, 2), dtype=np.uint64)
_TIMES, _PLUS = 2 * _DRAWN[:, 0] + np.uint64(1), _DRAWN[:, 1]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def band_keys(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(a row of ``BANDS`` keys for each text, shingles of each text); texts without words are alike."""
    hashes, counts = shingle_hashes(texts, width)
    return band_rows(hashes, counts), counts


def band_rows(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The keys from what ``shingle_hashes`` gives."""
    some = np.flatnonzero(counts)
    first = starts_of(counts)[:-1][some]
    keys = np.zeros((len(counts), BANDS), np.uint64)
    least = np.full(len(counts), ~np.uint64(0))
    for k in range(BANDS * BAND):
        if len(some):
            least[some] = np.minimum.reduceat(hashes * _TIMES[k] + _PLUS[k], first)
        band = keys[:, k // BAND]
        mixed = band * _MIX + least
        keys[:, k // BAND] = mixed ^ (mixed >> np.uint64(32))
    return keys


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text."""
    hashes, counts = shingle_hashes(texts, width)
    edge = starts_of(counts)
    return [np.unique(hashes[lo:hi]) for lo, hi in zip(edge[:-1], edge[1:])]


def _spread(edge: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nth list, place) of every entry of the lists that lie between the edges."""
    size = edge[lists + 1] - edge[lists]
    nth = np.repeat(np.arange(len(lists)), size)
    return nth, edge[lists][nth] + np.arange(len(nth)) - starts_of(size)[:-1][nth]


def set_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A forest of pairs with Jaccard ``similarity`` or more; its trees are the components of all such pairs.

    Similar sets share one of the rarest entries of both, as many as either can have beside the
    other. So one set at a time is held against those that share such an entry and are not known
    to hang together with it, until every set outside the largest component has had its turn.
    Sets that have only common entries alike meet few others, however many they are.
    """
    n = np.array([len(s) for s in sets], np.int64)
    _, codes, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    edge = starts_of(n)
    owner = np.repeat(np.arange(len(sets)), n)
    codes = codes[np.lexsort((codes, often[codes], owner))]
    heads = np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)
    head = np.flatnonzero(np.arange(len(codes)) - edge[owner] < heads[owner])
    head = head[np.argsort(codes[head], kind="stable")]
    holders, held = owner[head], np.searchsorted(codes[head], np.arange(len(often) + 1))
    mark = np.zeros(len(often), bool)
    part, done, links = np.arange(len(sets)), np.zeros(len(sets), bool), []
    while True:
        largest = np.argmax(np.bincount(part, minlength=len(sets)))
        turn = np.flatnonzero(~done & (part != largest))
        if not len(turn):
            return links
        at = turn[0]
        done[at] = True
        mine = codes[edge[at]:edge[at + 1]]
        met = np.unique(holders[_spread(held, mine[:heads[at]])[1]]) if n[at] else np.flatnonzero(n == 0)
        met = met[~done[met] & (part[met] != part[at]) & (
            np.minimum(n[met], n[at]) >= similarity * np.maximum(n[met], n[at]) - 1e-9)]
        if not len(met):
            continue
        mark[mine] = True
        nth, place = _spread(edge, met)
        shared = np.bincount(nth, mark[codes[place]], len(met))
        mark[mine] = False
        near = met[shared * (1 + similarity) >= similarity * (n[met] + n[at]) - 1e-9]
        _, one = np.unique(part[near], return_index=True)
        links += [(int(at), int(near[i])) for i in one]
        part[np.isin(part, part[near])] = part[at]


def near_copy_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(least, sign, component_id) of each distinct text of ``docs`` (doc_id, text).

    ``sign`` is its hash, ``least`` the smallest id of its rows. Texts whose sets of lower-case
    word shingles (see ``shingle_hashes``) have Jaccard ``similarity`` or more are linked,
    ``component_id`` is the smallest id reachable over links. Texts meet where their SimHash
    fingerprints hang together by links of ``RADIUS`` bits (see ``near_links``), and, as texts of that similarity
    may differ in more bits, where a band of their MinHash is equal; buckets with the same texts are one. Only texts that share a bucket send
    their shingles. Within a bucket every pair is decided on them, those that hang together
    already apart; a bucket with very many shingles is cut into pairs of parts.
    """

    def bands_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            hashes, counts = shingle_hashes(part.column("text"), width)
            keys, prints = band_rows(hashes, counts), majorities(hashes, counts)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(counts) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("sign"), pa.array(counts, pa.int64()),
                 pa.array(prints.view(np.int64)), lists],
                ["doc_id", "sign", "n", "fp", "bands"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            sets = [s.tobytes() for s in shingle_sets(part.column("text"), width)]
            yield pa.RecordBatch.from_arrays([part.column("sign"), pa.array(sets, pa.binary())], ["sign", "shingles"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sign"), "text")
    rows = materialize(picked.mapInArrow(bands_of, "doc_id long, sign long, n long, fp long, bands array<long>"), "bands")
    texts = materialize(rows.groupBy("sign").agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"),
        F.first("bands").alias("bands")), "texts")
    hung = star_roots(near_links(texts.select("fp").distinct(), RADIUS)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    prints = texts.select("sign", "n", "fp").join(hung, "fp", "left").select(
        "sign", "n", F.lit(BANDS).alias("band"), F.coalesce("root", "fp").alias("key"))
    keys = texts.select("sign", "n", F.posexplode("bands").alias("band", "key")).unionByName(prints)
    shared = keys.groupBy("band", "key").agg(
        F.count("*").alias("count"), F.sum(F.col("n") + 1).alias("size"),
        F.bit_xor(F.xxhash64("sign")).alias("mark")).where("count > 1")
    buckets = materialize(
        shared.groupBy("count", "size", "mark").agg(F.min(F.struct("band", "key")).alias("at")).select(
            "at.*", F.ceil(F.col("size") / UNIT_SHINGLES).cast("int").alias("parts")), "buckets")
    members = materialize(keys.join(buckets, ["band", "key"]).select("band", "key", "parts", "sign"), "members")
    needed = members.select("sign").distinct().join(texts.select("sign", "least"), "sign").select(
        F.col("sign").alias("_sign"), F.col("least").alias("_id"))
    sets = picked.join(
        needed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sign") == F.col("_sign")), "left_semi"
    ).dropDuplicates(["doc_id", "sign"]).mapInArrow(sets_of, "sign long, shingles binary")
    own = F.pmod(F.xxhash64("sign"), F.col("parts")).cast("int")
    other = F.expr("filter(sequence(0, parts - 1), x -> x <> own or parts = 1)")
    units = members.withColumn("own", own).withColumn("other", F.explode(other)).select(
        "band", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "sign")
    dealt = units.join(materialize(sets, "shingles"), "sign").select(
        "band", "key", "lo", "hi", "sign", "shingles").repartition("band", "key", "lo", "hi").sortWithinPartitions(
        "band", "key", "lo", "hi")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BUFFER_BYTES:
                table = pa.Table.from_batches(held)
                edge = unit_edges(table)
                yield from unit_links(table, edge[:-1])
                held = table.slice(edge[-2]).to_batches()
                size = 0  # what a unit has so far is not looked at again before as much has come
        if held:
            table = pa.Table.from_batches(held)
            yield from unit_links(table, unit_edges(table))

    def unit_edges(table: pa.Table) -> np.ndarray:
        place = np.column_stack([table[c].to_numpy() for c in ("band", "key", "lo", "hi")])
        fresh = (np.diff(place, axis=0) != 0).any(axis=1)
        return np.concatenate([[0], np.flatnonzero(fresh) + 1, [len(place)]])

    def unit_links(table: pa.Table, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
        sign = table["sign"].to_numpy()
        found: list[tuple[int, int]] = []
        for lo, hi in zip(edge[:-1], edge[1:]):
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table["shingles"].slice(lo, hi - lo)]
            found += [(sign[lo + a], sign[lo + b]) for a, b in set_links(sets, similarity)]
        if found:
            a, b = np.array(found, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    roots = star_roots(dealt.mapInArrow(judge, "a long, b long"))
    member = texts.select("sign", "least").join(
        roots.select(F.col("a").alias("sign"), F.col("b").alias("root")), "sign", "left").select(
        "sign", "least", F.coalesce("root", "sign").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return member.join(least, "root").select("least", "sign", "component_id")


def one_of_each_near_group(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that stand for their group: its smallest id.

    Of rows with that id and one text one stays; a group without ids keeps one row for each of
    its texts. Texts move by id and hash, so that no group is a large partition.
    """
    heads = near_copy_groups(docs, width, similarity).where(F.col("least").eqNullSafe(F.col("component_id"))).select(
        F.col("least").alias("_id"), F.col("sign").alias("_sign"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_key"), F.xxhash64("text").alias("_own"))
    kept = rows.join(
        heads, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sign")), "left_semi")
    kept = kept.dropDuplicates(["_key", "_own"])
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
