"""SimHash near-duplicates by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kappaloom.llm.arrow_text import offsets_of, portions, starts_of, words
from kappaloom.llm.components import star_roots
from kappaloom.llm.xxh64 import xxh64_slices
from kappaloom.session import materialize

BITS = 64
SEED = 42
#: distinct fingerprints of one trie above which its top levels become units of their own
UNIT_ROWS = 1 << 16
#: rows that a task joins at a time, whole units
BUFFER_ROWS = 1 << 17
#: node pairs with at most so many key pairs are compared directly
LEAF_PAIRS = 64
#: node pairs that are expanded together
FRONTIER = 1 << 16

_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 with seed 42 of every shingle, shingles of each text).

    A text with fewer words than ``width`` has its whole sequence as one shingle, a text
    without words none.
    """
    flat, counts = words(texts, lower=True)
    offsets, data = offsets_of(flat)
    # One space behind every word: each byte moves on by the number of words before its own.
    joined = np.full(int(offsets[-1] - offsets[0]) + len(flat), 0x20, np.uint8)
    place = np.arange(offsets[0], offsets[-1]) - offsets[0]
    joined[place + np.repeat(np.arange(len(flat)), np.diff(offsets))] = data[offsets[0]:offsets[-1]]
    begin = (offsets[:-1] - offsets[0]).astype(np.int64) + np.arange(len(flat))
    end = begin + np.diff(offsets)
    shingles = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    first = starts_of(counts)[:-1]
    at = np.repeat(first - starts_of(shingles)[:-1], shingles) + np.arange(shingles.sum())
    last = at + np.repeat(np.minimum(counts, width), shingles) - 1
    return xxh64_slices(joined.tobytes(), begin[at], end[last], SEED), shingles


def fingerprints(texts: pa.Array, width: int) -> np.ndarray:
    """64-bit SimHash of each text: a bit is 1 if set in over half of the shingle hashes."""
    return majorities(*shingle_hashes(texts, width))


def majorities(hashes: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """The fingerprints from what ``shingle_hashes`` gives."""
    n = len(shingles)
    owner = np.repeat(np.arange(n) * 256, shingles)
    out = np.zeros(n, np.uint64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):  # votes by byte value, then by bit
        seen = np.bincount(owner + octets[:, k], minlength=n * 256).reshape(n, 256)
        ones = 2 * (seen @ _BIT_OF_BYTE) > shingles[:, None]
        out |= (ones @ (1 << np.arange(8))).astype(np.uint64) << np.uint64(8 * k)
    return out


class TrieJoin:
    """Self-join of sorted keys: which keys differ in at most ``budget`` bits.

    A trie node at depth d is a range of the sorted keys that share d bits. Pairs of nodes go
    down together; a pair is dropped once the bits it differs in exceed the budget, and once
    both its ranges are known to hang together already.
    """

    def __init__(self, keys: np.ndarray, budget: int, depth: int):
        self.keys, self.budget, self.top = keys, budget, depth
        self.root = np.arange(len(keys))
        self._changes = np.arange(len(keys) + 1)
        self._ones: dict[int, np.ndarray] = {}

    def run(self, pairs: np.ndarray) -> np.ndarray:
        """``pairs``: columns a_lo, a_hi, b_lo, b_hi. The smallest linked position of each key."""
        pairs = np.column_stack([pairs, np.zeros(len(pairs), np.int64)])
        stack = [(self.top, pairs)]
        while stack:
            depth, pairs = stack.pop()
            if len(pairs) > FRONTIER:
                stack += [(depth, pairs[FRONTIER:]), (depth, pairs[:FRONTIER])]
                continue
            pairs = pairs[~self._joined(pairs)]
            size = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
            leaf = (size <= LEAF_PAIRS) | (depth >= BITS)
            self._compare(pairs[leaf])
            if not leaf.all():
                stack.append((depth + 1, self._down(depth, pairs[~leaf])))
        return self.root

    def _joined(self, pairs: np.ndarray) -> np.ndarray:
        a_lo, a_hi, b_lo, b_hi = pairs[:, :4].T
        c = self._changes
        return ((c[a_hi - 1] == c[a_lo]) & (c[b_hi - 1] == c[b_lo])
                & (self.root[a_lo] == self.root[b_lo]) & ((a_lo != b_lo) | (a_hi - a_lo > 1)))

    def _down(self, depth: int, pairs: np.ndarray) -> np.ndarray:
        if depth not in self._ones:
            bit = (self.keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            self._ones[depth] = starts_of(bit.astype(np.int64))
        ones = self._ones[depth]
        a_lo, a_hi, b_lo, b_hi, diff = pairs.T
        a_mid = a_hi - (ones[a_hi] - ones[a_lo])
        b_mid = b_hi - (ones[b_hi] - ones[b_lo])
        same = a_lo == b_lo  # ranges of one depth are equal or apart
        children = [np.column_stack(x) for x in (
            (a_lo, a_mid, b_lo, b_mid, diff), (a_mid, a_hi, b_mid, b_hi, diff),
            (a_lo, a_mid, b_mid, b_hi, diff + 1))]
        children.append(np.column_stack((a_mid, a_hi, b_lo, b_mid, diff + 1))[~same])
        below = np.concatenate(children)
        return below[(below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3])
                     & (below[:, 4] <= self.budget)]

    def _compare(self, pairs: np.ndarray) -> None:
        for lo in range(0, len(pairs), FRONTIER // 4):
            a_lo, a_hi, b_lo, b_hi = pairs[lo:lo + FRONTIER // 4, :4].T
            wide = b_hi - b_lo
            size = (a_hi - a_lo) * wide
            k = np.arange(size.sum()) - np.repeat(starts_of(size)[:-1], size)
            wide = np.repeat(wide, size)
            i, j = np.repeat(a_lo, size) + k // wide, np.repeat(b_lo, size) + k % wide
            near = (i < j) & (np.bitwise_count(self.keys[i] ^ self.keys[j]) <= self.budget)
            self._link(i[near], j[near])

    def _link(self, i: np.ndarray, j: np.ndarray) -> None:
        changed = False
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                break
            changed = True
            np.minimum.at(self.root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up
        if changed:
            self._changes = np.concatenate([[0, 0], np.cumsum(self.root[1:] != self.root[:-1])])[
                1:] if len(self.root) else self._changes


def near_links(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that span the groups of the distinct ``fp`` within ``radius`` bits.

    64 bits are cut into radius + 1 blocks; two fingerprints within the radius agree on a
    block. Each block in turn is moved to the front, so that its value names a trie whose top
    levels match exactly, and the tries are the groups of the shuffle. There are at most
    2^13 tries a block at radius 4, so the table of large ones is bounded; such a trie is cut
    into pairs of its next nodes, each pair a unit of its own. A task emits a forest of each
    unit's links, never all pairs.
    """
    cuts = [BITS * k // (radius + 1) for k in range(radius + 2)]
    width = min(hi - lo for lo, hi in zip(cuts, cuts[1:]))
    turned = F.array(*[
        F.struct(F.lit(lo).alias("shift"), (
            F.shiftleft("fp", lo).bitwiseOR(F.shiftrightunsigned("fp", BITS - lo)) if lo
            else F.col("fp")).alias("key"))
        for lo in cuts[:-1]])
    keys = prints.select(F.inline(turned)).withColumn(
        "trie", F.shiftrightunsigned("key", BITS - width))
    big = keys.groupBy("shift", "trie").count().where(F.col("count") > UNIT_ROWS).select(
        "shift", "trie", F.least(F.ceil(F.log2(F.col("count") / F.lit(UNIT_ROWS))), F.lit(8)).cast("int").alias("more"))
    child = F.shiftrightunsigned(F.shiftleft("key", width), 1)
    child = F.when(F.col("more") > 0, F.expr(
        f"shiftrightunsigned(shiftleft(key, {width}), {BITS} - more)")).otherwise(F.lit(0)).cast("int")
    other = F.expr(f"filter(sequence(0, shiftleft(1, more) - 1), x -> bit_count(x ^ child) <= {radius})")
    units = (
        keys.join(F.broadcast(big), ["shift", "trie"], "left")
        .withColumn("more", F.coalesce("more", F.lit(0))).withColumn("child", child)
        .withColumn("other", F.explode(other))
        .select("shift", "trie", F.least("child", "other").alias("lo"),
                F.greatest("child", "other").alias("hi"), "key", "child")
    )
    dealt = units.repartition("shift", "trie", "lo", "hi").sortWithinPartitions(
        "shift", "trie", "lo", "hi", "key")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            held.append(np.column_stack([
                batch.column(c).to_numpy().astype(np.int64) for c in range(6)]))
            rows += batch.num_rows
            if rows < BUFFER_ROWS:
                continue
            all_rows = np.concatenate(held)
            fresh = np.flatnonzero((np.diff(all_rows[:, :4], axis=0) != 0).any(axis=1))
            if len(fresh):
                yield from unit_links(all_rows[:fresh[-1] + 1])
                held = [all_rows[fresh[-1] + 1:]]
            else:
                held = [all_rows]
            rows = len(held[0])
        if rows:
            yield from unit_links(np.concatenate(held))

    def unit_links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = rows[:, 4].view(np.uint64) if rows[:, 4].flags.c_contiguous else np.ascontiguousarray(
            rows[:, 4]).view(np.uint64)
        edge = np.concatenate([[True], (np.diff(rows[:, :4], axis=0) != 0).any(axis=1), [True]])
        cut = np.flatnonzero(edge)
        lo, hi = cut[:-1], cut[1:]
        cross = rows[lo, 2] != rows[lo, 3]
        below = starts_of((rows[:, 5] == rows[:, 2]).astype(np.int64))
        mid = lo + below[hi] - below[lo]
        pairs = np.column_stack([lo, np.where(cross, mid, hi), np.where(cross, mid, lo), hi])
        pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])]
        root = TrieJoin(key, radius, width).run(pairs)
        linked = np.flatnonzero(root != np.arange(len(root)))
        shift = rows[:, 0].astype(np.uint64)
        back = (key >> shift) | np.where(shift > 0, key << ((np.uint64(BITS) - shift) % np.uint64(BITS)), np.uint64(0))
        if len(linked):
            yield pa.RecordBatch.from_arrays(
                [pa.array(back[linked].view(np.int64)), pa.array(back[root[linked]].view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(join, "a long, b long")


def simhash_groups(
    docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text",
    signed: bool = False,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every whole text; ``sign``, its hash, if ``signed``.

    Fingerprints take word shingles of ``width`` (see ``shingle_hashes``) and link within
    ``radius`` bits; ``component_id`` is the smallest id reachable over links, itself included.
    Null and empty texts have fingerprint zero and are linked like any other. Rows with equal
    text and repeated rows share a fingerprint and so a component; every row comes back. A row
    without id takes part, its component is the smallest id there is in it, null if there is
    none. An empty table gives an empty one; other columns are not read.
    """

    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            fp = fingerprints(part.column("text"), width)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(fp.view(np.int64)), part.column("sign")],
                ["doc_id", "fp", "sign"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                         F.xxhash64(text_col).alias("sign"))
    rows = materialize(picked.mapInArrow(prints_of, "doc_id long, fp long, sign long"), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    roots = star_roots(near_links(prints.select("fp"), radius))
    member = prints.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        *["sign"] * signed)


def one_of_each_group(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that stand for their group: its smallest id.

    Of rows with that id and one text one stays; a group without ids keeps one row for each of
    its texts. Texts move once, by id and hash, so that no group is a large partition.
    """
    groups = simhash_groups(docs, width, radius, signed=True)
    heads = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("_id"), F.col("sign").alias("_sign")).distinct()
    kept = docs.withColumn("_own", F.xxhash64("text")).join(
        heads, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sign")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_own"]).drop("_own")
