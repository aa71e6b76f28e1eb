"""Benchmark decontamination: SimHash of item-sized windows, then exact shingle similarity.

A window has as many words as a benchmark item, or is the whole text if that is shorter. A
window similar to an item holds most of its shingles, so it holds one of the item's rarest: these
anchors lead from the words of a text to the few items, and to the windows around the place, that
can be similar at all. Such windows get a fingerprint. Of a window and an item of its anchors, 64
bits are compared in radius + 1 blocks (fingerprints within the radius agree on one of them), then
in whole. What is within the radius is verified on the words themselves by weighted shingle
similarity, the sum of the lesser counts over the sum of the greater.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kappaloom.llm.arrow_text import portions, starts_of, words
from kappaloom.llm.lookup import LongTable
from kappaloom.llm.substring_dedup import _rolling, _word_hashes

LEAK_SCHEMA = "doc_id long, item_id long, similarity double, start long, n_words long"
#: text of benchmark items that is held by every task at a time; more items take more scans
BLOCK_BYTES = 16 << 20
#: pairs of window and item that are compared at a time
PAIRS = 1 << 19
_POSITIVE = np.uint64((1 << 63) - 1)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _fold(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def _expand(at: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, position) of every entry of the lists ``at``; -1 is the empty list."""
    size = np.where(at >= 0, offsets[at + 1] - offsets[at], 0)
    query = np.repeat(np.arange(len(at)), size)
    inner = np.arange(len(query)) - np.repeat(starts_of(size)[:-1], size)
    return query, offsets[at[query]] + inner


class _Lists:
    """Values grouped by key, found by arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        distinct, first = np.unique(keys[order], return_index=True)
        self.table = LongTable(distinct)
        self.offsets = np.append(first, len(keys)).astype(np.int64)
        self.values = values[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        query, at = _expand(self.table.find(keys).astype(np.int64), self.offsets)
        return query, self.values[at]


class LeakFinder:
    """Finds a block of benchmark items in texts; all items of one shingle width ``k``."""

    def __init__(self, items: list[tuple[int, list[str]]], k: int, radius: int, threshold: float):
        self.k, self.radius, self.threshold = k, radius, threshold
        self.ids = np.array([i for i, _ in items], np.int64)
        self.size = np.array([len(ws) for _, ws in items], np.int64)
        self.shingles = [Counter(tuple(ws[j:j + k]) for j in range(len(ws) - k + 1)) for _, ws in items]
        flat = pa.array([w for _, ws in items for w in ws], pa.string())
        sums = _rolling(_word_hashes(flat), k)
        start = starts_of(self.size)[:-1]
        n = self.size - k + 1
        at = np.repeat(start - starts_of(n)[:-1], n) + np.arange(n.sum())
        owner = np.repeat(np.arange(len(items)), n)
        place = (sums[at] & _POSITIVE).astype(np.int64)
        self.of_anchor = _Lists(*self._anchors(place, owner, n, threshold))
        votes = np.add.reduceat(_bits(sums[at]).astype(np.int64), starts_of(n)[:-1], axis=0)
        self.prints = _fold(2 * votes > n[:, None])
        self.cuts = [64 * b // (radius + 1) for b in range(radius + 2)]
        self.lengths, self.length_of = np.unique(self.size, return_inverse=True)

    @staticmethod
    def _anchors(place: np.ndarray, owner: np.ndarray, n: np.ndarray, threshold: float):
        """(shingle, item) of the rarest shingles of each item, which no similar window is without.

        Of an item's n shingles such a window holds at least threshold * n; those left out as
        anchors, with their counts, are fewer.
        """
        pair, count = np.unique(np.column_stack([place, owner]), axis=0, return_counts=True)
        _, which, items_of = np.unique(pair[:, 0], return_inverse=True, return_counts=True)
        order = np.lexsort((pair[:, 0], -items_of[which], pair[:, 1]))  # the commonest first
        pair, count = pair[order], count[order]
        total = np.cumsum(count)
        first = np.searchsorted(pair[:, 1], np.arange(len(n)))
        upto = total - (total - count)[first][pair[:, 1]]
        spare = np.ceil(threshold * n - 1e-9)[pair[:, 1]]
        anchor = pair[upto >= spare]
        return anchor[:, 0], anchor[:, 1]

    def _near(self, prints: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The pairs within the radius, found among those that agree on a block."""
        differ = prints ^ self.prints[item]
        agree = np.zeros(len(differ), bool)
        for lo, hi in zip(self.cuts[:-1], self.cuts[1:]):
            agree |= differ & np.uint64(((1 << (hi - lo)) - 1) << lo) == 0
        at = np.flatnonzero(agree)
        return at[np.bitwise_count(differ[at]) <= self.radius]

    def find(self, flat: pa.Array, hashes: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(text, item, similarity, start, words) of the best window for each text and item."""
        first = starts_of(counts)[:-1]
        if len(flat) < self.k:
            return []
        sums = _rolling(hashes, self.k)
        places = (sums & _POSITIVE).astype(np.int64)
        hit = np.flatnonzero(self.of_anchor.table.find(places) >= 0)
        owner = np.searchsorted(first, hit, "right") - 1
        inside = hit + self.k <= first[owner] + counts[owner]
        hit, owner = hit[inside], owner[inside]
        q, item = self.of_anchor.find(places[hit])
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for item, owner, start in self._windows(item, hit[q], owner[q], first, counts):
            n = np.minimum(self.size[item], counts[owner]) - self.k + 1
            window, which = np.unique(start * (len(self.lengths) + 1) + self.length_of[item], return_inverse=True)
            one = np.zeros(len(window), np.int64)
            one[which] = np.arange(len(which))
            near = self._near(self._window_prints(sums, start[one], n[one])[which], item)
            self._verify(best, flat, first, owner[near], start[near], n[near], item[near])
        return [(text, int(self.ids[item]), -b[0], b[1], b[2]) for (text, item), b in sorted(best.items())]

    def _windows(self, item, hit, owner, first, counts):
        """(item, text, start) of every window of the item's size around an anchor, once, some at a time."""
        order = np.lexsort((hit, owner, item))
        item, hit, owner = item[order], hit[order], owner[order]
        n = np.minimum(self.size[item], counts[owner])
        lo = np.maximum(hit - (n - self.k), first[owner])
        hi = np.minimum(hit, first[owner] + counts[owner] - n)
        again = np.flatnonzero((item[1:] == item[:-1]) & (owner[1:] == owner[:-1])) + 1
        lo[again] = np.maximum(lo[again], hi[again - 1] + 1)
        size = np.maximum(hi - lo + 1, 0)
        edge = starts_of(size)
        begin = 0
        while begin < len(size):
            end = max(int(np.searchsorted(edge, edge[begin] + PAIRS, "right")) - 1, begin + 1)
            row = np.repeat(np.arange(begin, end), size[begin:end])
            start = lo[row] + np.arange(len(row)) - (edge[row] - edge[begin])
            if len(row):
                yield item[row], owner[row], start
            begin = end

    @staticmethod
    def _window_prints(sums: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """SimHash of windows of n shingles, from vote sums over the places that windows cover."""
        edge = np.zeros(len(sums) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + n, -1)
        covered = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        out = np.empty(len(start), np.uint64)
        order = np.argsort(start, kind="stable")
        for lo in range(0, len(order), 1 << 14):
            some = order[lo:lo + (1 << 14)]
            reach = covered[np.searchsorted(covered, start[some[0]]):
                            np.searchsorted(covered, (start[some] + n[some]).max())]
            total = np.zeros((len(reach) + 1, 64), np.int32)
            np.cumsum(_bits(sums[reach]), axis=0, out=total[1:], dtype=np.int32)
            at = np.searchsorted(reach, start[some])
            out[some] = _fold(2 * (total[at + n[some]] - total[at]) > n[some][:, None])
        return out

    def _verify(self, best, flat, first, owner, start, n, items):
        """Note in ``best`` what the words themselves say of pairs of window and item."""
        for text, at, size, item in zip(owner.tolist(), start.tolist(), n.tolist(), items.tolist()):
            ws = flat.slice(at, size + self.k - 1).to_pylist()
            seen = Counter(tuple(ws[j:j + self.k]) for j in range(size))
            own = self.shingles[item]
            common = sum((seen & own).values())
            similarity = common / (size + sum(own.values()) - common)
            if similarity < self.threshold:
                continue
            place = (-similarity, at - int(first[text]), len(ws))
            best[text, item] = min(best.get((text, item), place), place)


class Benchmark:
    """The finders of one block of items, one for each shingle width that occurs."""

    def __init__(self, items: list[tuple[int, str]], width: int, radius: int, threshold: float):
        flat, counts = words(pa.array([t for _, t in items], pa.string()), lower=True)
        edge = starts_of(counts)
        each = [(i, flat.slice(int(a), int(b - a)).to_pylist()) for (i, _), a, b in zip(items, edge, edge[1:])]
        widths = sorted({min(width, len(ws)) for _, ws in each if ws})
        self.finders = [LeakFinder(
            [x for x in each if x[1] and min(width, len(x[1])) == k], k, radius, threshold) for k in widths]

    def find(self, texts: pa.Array) -> list[tuple[int, int, float, int, int]]:
        flat, counts = words(texts, lower=True)
        if not len(flat) or not self.finders:
            return []
        hashes = _word_hashes(flat)
        return [x for finder in self.finders for x in finder.find(flat, hashes, counts)]


def benchmark_blocks(
    items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = 5,
    radius: int = 24, threshold: float = 0.8,
) -> list[Benchmark]:
    """The items in blocks of at most about ``BLOCK_BYTES`` of text, measured beforehand."""
    known = items.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = known.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = -(-size // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("id", "text"), F.lit(max(n, 1)))
    blocks = (known.where(block == b).distinct().orderBy("id", "text").collect() for b in range(n))
    return [Benchmark([(r["id"], r["text"]) for r in rows], width, radius, threshold) for rows in blocks if rows]


def benchmark_leaks(
    docs: DataFrame, blocks: list[Benchmark], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): each text's best window for each item in it.

    Words are compared in lower case (A-Z); ``start`` counts words from 0; of windows of the
    same similarity the first is told. Items without words match nothing, an item of fewer
    words than a shingle is one shingle. Null and empty texts hold nothing. Repeated rows of
    either table give repeated results (equal rows of items once); an empty table gives an empty
    result; other columns are not read. One scan of the texts for each block, no shuffle.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in blocks:
        def find(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for part in portions(batches):
                found = block.find(part.column("text"))
                row, item, similarity, start, n = zip(*found) if found else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(item, pa.int64()),
                     pa.array(similarity, pa.float64()), pa.array(start, pa.int64()), pa.array(n, pa.int64())],
                    ["doc_id", "item_id", "similarity", "start", "n_words"])

        leaks = picked.mapInArrow(find, LEAK_SCHEMA)
        out = leaks if out is None else out.unionByName(leaks)
    return out if out is not None else docs.sparkSession.createDataFrame([], LEAK_SCHEMA)


def without_leaks(docs: DataFrame, blocks: list[Benchmark]) -> DataFrame:
    """The rows of ``docs`` (with a column text) in which no item is found, all columns kept."""
    names, at = docs.columns, docs.columns.index("text")
    numbers = [f"_{i}" for i in range(len(names))]  # names of the caller's table may clash
    kept = docs.toDF(*numbers)
    for block in blocks:
        def keep(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for part in portions(batches, numbers[at]):
                stay = np.ones(part.num_rows, bool)
                stay[[x[0] for x in block.find(part.column(at))]] = False
                yield part.filter(pa.array(stay))

        kept = kept.mapInArrow(keep, kept.schema)
    return kept.toDF(*names)
