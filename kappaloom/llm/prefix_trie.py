"""The trie of conversation beginnings, by ROLLUP over columns of turn ids.

A conversation lies in rows of eight turns, a column for each. Every row carries the node at
which the row before it ended, so ROLLUP over the columns of all rows at once aggregates all
prefixes of all conversations, however long: there is no round for each depth or block. A node
is known by 128 bits, the exclusive or of one pseudo-random number for each (position, turn) on
its path. That can be taken in any order and in parts, so no conversation has to lie in one task.

Sums over subtrees need no walk either. A node is owned by its smallest member, and what a
conversation owns is the lower end of its own path. A subtree's repeated texts are therefore
those that its members read before their own part begins, and its leaves are the members that
own a childless end: both are sums over members, which the same ROLLUP gives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from kappaloom.operators.joins import skew_join
from kappaloom.session import materialize

BLOCK = 8
#: blocks whose running sums are taken together; longer conversations are cut there
SUPER = 1024


def _turn_rows(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, chars): 128 bits of role and text, and the text's length."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    content = F.sha2(F.concat_ws(":", F.char_length(role).cast("string"), F.concat(role, text)), 256)
    return convs.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        content.alias("_content"), F.char_length(text).cast("long").alias("chars"),
    ).select("conv_id", "turn", F.xxhash64("_content").alias("a"),
             F.xxhash64(F.lit(1), "_content").alias("b"), "chars")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each conversation inside a sorted task, from 1."""
    task = TaskContext.get().partitionId()
    last, before = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_numpy()
        n = len(ids)
        starts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
        at = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n))) + 1
        if last == ids[0]:
            at[:starts[1] if len(starts) > 1 else n] += before
        last, before = ids[-1], int(at[-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, task, np.int32)), pa.array(at.astype(np.int64)),
             *[batch.column(c) for c in ("conv_id", "a", "b", "chars")]],
            ["part", "at", "conv_id", "a", "b", "chars"])


def number_turns(convs: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, chars): the turns of every conversation in order, from 1.

    Ordered by turn, null first, then by the hash of role and text; equal rows in any order. The
    rows are dealt by ranges of this order, so that a conversation may span tasks. Each boundary
    between tasks is inside one conversation at most: the offsets to add are fewer than the
    tasks, whatever the data, and are broadcast.
    """
    rows = materialize(_turn_rows(convs), "turn_rows")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "a", "b", "u"]
    dealt = rows.withColumn("u", F.xxhash64(F.monotonically_increasing_id()))
    ranged = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "a", "b", "chars")
    placed = materialize(ranged.mapInArrow(
        _places, "part int, at long, conv_id long, a long, b long, chars long"), "placed_turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn(
        "before", F.sum("n").over(before)).where("before > 0").select("conv_id", "part", "before")
    return placed.join(F.broadcast(offsets), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "a", "b", "chars")


def borrow_heads(turns: DataFrame, every: int = 100, below: int = 6) -> tuple[DataFrame, DataFrame]:
    """(members, turns) with the first turns of conversation c taken from c - c % every.

    h = crc32 of c in decimal, modulo ``below``: the first h turns of that conversation (all if it
    is shorter, none if there is no such one), then c's own after its first h. ``members`` has
    every conv_id and the new ``length``, which may be 0. At most ``below - 1`` turns of a
    conversation are lent, to fewer than ``every`` others.
    """
    c = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    cells = F.array_sort(F.collect_list(F.struct("pos", "a", "b", "chars")))
    lent = turns.where((F.col("pos") < below) & (c % every == 0)).groupBy(c.alias("base")).agg(cells.alias("lent"))
    none = F.array().cast("array<struct<pos:long,a:long,b:long,chars:long>>")
    plan = (
        sizes.withColumn("base", c - c % every)
        .withColumn("h", (F.crc32(c.cast("string")) % below).cast("int"))
        .join(lent, "base", "left")
        .withColumn("head", F.slice(F.coalesce("lent", none), F.lit(1), F.col("h")))
        .select("conv_id", "n", "h", "head", F.size("head").alias("m"))
    )
    plan = materialize(plan, "heads")
    own = turns.join(plan.select("conv_id", "h", "m"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "a", "b", "chars")
    heads = plan.select("conv_id", F.inline("head"))
    members = plan.select("conv_id", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return members, heads.unionByName(own)


def turn_blocks(members: DataFrame, turns: DataFrame) -> DataFrame:
    """Rows of eight turns: t0a, t0b, c0, ... and, from the blocks before, the node and characters.

    (pa, pb) is the node where the block before ended, ``chars_before`` the characters up to
    there, (ea, eb) the node where this one ends. Running values are taken within ``SUPER`` blocks,
    then over these, so that a task never holds a whole long conversation.
    """
    slot = (F.col("pos") - 1) % BLOCK
    block = F.expr(f"(pos - 1) div {BLOCK}")
    numbered = turns.select(
        "conv_id", block.alias("block"), F.expr(f"(pos - 1) div {BLOCK * SUPER}").alias("super"), slot.alias("slot"), "chars",
        F.xxhash64(F.lit(0), "pos", "a", "b").alias("ta"), F.xxhash64(F.lit(1), "pos", "a", "b").alias("tb"),
    ).repartition("conv_id", "super")
    cells = [
        F.max(F.when(F.col("slot") == j, F.col(c))).alias(name)
        for j in range(BLOCK) for c, name in (("ta", f"t{j}a"), ("tb", f"t{j}b"), ("chars", f"c{j}"))
    ]
    wide = numbered.groupBy("conv_id", "super", "block").agg(
        *cells, F.bit_xor("ta").alias("xa"), F.bit_xor("tb").alias("xb"), F.sum("chars").alias("s"))
    running = Window.partitionBy("conv_id", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.select("*", *_running(running))
    over = Window.partitionBy("conv_id").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    supers = numbered.groupBy("conv_id", "super").agg(
        F.bit_xor("ta").alias("xa"), F.bit_xor("tb").alias("xb"), F.sum("chars").alias("s"))
    supers = supers.select("conv_id", "super", *_running(over)).where("super > 0").select(
        "conv_id", "super", *[F.col(c).alias(f"more_{c}") for c in ("pa", "pb", "chars_before")])
    wide = wide.join(supers, ["conv_id", "super"], "left")
    pa_, pb_ = (F.col(c).bitwiseXOR(F.coalesce(f"more_{c}", F.lit(0))) for c in ("pa", "pb"))
    columns = [x for j in range(BLOCK) for x in (f"t{j}a", f"t{j}b", f"c{j}")]
    full = wide.select(
        "conv_id", "block", pa_.alias("pa"), pb_.alias("pb"),
        pa_.bitwiseXOR(F.col("xa")).alias("ea"), pb_.bitwiseXOR(F.col("xb")).alias("eb"),
        (F.col("chars_before") + F.coalesce("more_chars_before", F.lit(0))).alias("chars_before"), *columns)
    zero = F.lit(0).cast("long")
    turnless = members.where("length = 0").select(
        "conv_id", *[zero.alias(c) for c in ("block", "pa", "pb", "ea", "eb", "chars_before")],
        *[F.lit(None).cast("long").alias(c) for c in columns])
    return materialize(full.unionByName(turnless), "turn_blocks")


def _running(window) -> list[Column]:
    return [F.coalesce(F.bit_xor("xa").over(window), F.lit(0)).alias("pa"),
            F.coalesce(F.bit_xor("xb").over(window), F.lit(0)).alias("pb"),
            F.coalesce(F.sum("s").over(window), F.lit(0)).alias("chars_before")]


ROLLUP = ", ".join(f"(t{j}a, t{j}b)" for j in range(BLOCK))


def all_prefixes(blocks: DataFrame, sums: str) -> DataFrame:
    """(node, parent, depth, in_block) and ``sums`` for each prefix: one ROLLUP over all blocks.

    Each pair of columns is one turn. grouping_id tells how many of them are rolled up, hence the
    depth in the block. A depth at which the conversation has ended, and the start of a later
    block, which is the end of the one before, are no nodes of their own.
    """
    rolled = blocks.sparkSession.sql(f"""
        SELECT block, pa, pb, CAST({BLOCK} - bit_count(grouping_id()) / 2 AS INT) AS in_block,
          {', '.join(f't{j}a, t{j}b' for j in range(BLOCK))}, {sums}
        FROM {{blocks}} GROUP BY block, pa, pb, ROLLUP ({ROLLUP})""", blocks=blocks)
    last = [F.coalesce(*[F.when(F.col("in_block") == j + 1, F.col(f"t{j}{x}")) for j in range(BLOCK)]) for x in "ab"]
    key = []
    for x in "ab":
        value = F.col(f"p{x}")
        for j in range(BLOCK):
            value = value.bitwiseXOR(F.coalesce(f"t{j}{x}", F.lit(0)))
        key.append(value)
    real = F.when(F.col("in_block") == 0, F.col("block") == 0).otherwise(last[0].isNotNull())
    above = [k.bitwiseXOR(v) for k, v in zip(key, last)]
    own = {"block", "pa", "pb", "in_block", *[f"t{j}{x}" for j in range(BLOCK) for x in "ab"]}
    return rolled.where(real).select(
        F.struct(key[0].alias("a"), key[1].alias("b")).alias("node"),
        F.when(F.col("in_block") > 0, F.struct(above[0].alias("a"), above[1].alias("b"))).alias("parent"),
        (F.col("block") * BLOCK + F.col("in_block")).alias("depth"),
        *[c for c in rolled.columns if c not in own])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node in a sorted task as one comma-joined text for each batch."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
        starts = np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1])
        ids = batch.column("conv_id")
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), pc.cast(ids, pa.string()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(a[starts]), pa.array(b[starts]), ids.take(pa.array(starts)), pc.binary_join(lists, ",")],
            ["a", "b", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node from its pieces in order; nothing but the digest is held."""
    now, running = None, None
    for batch in batches:
        done = []
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
            if (a, b) == now:
                running.update(b"," + ids.encode())
                continue
            if now:
                done.append((*now, running.hexdigest()))
            now, running = (a, b), hashlib.sha256(ids.encode())
        yield _digest_rows(done)
    if now:
        yield _digest_rows([(*now, running.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
        ["a", "b", "ends_sha256"])


def ends_of(blocks: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end.

    The ids are sorted by ranges of (node, id), so many tasks share those of a hot node. What
    reaches the task that digests it is a piece of some thousand ids for each row, in order.
    """
    ends = blocks.groupBy("conv_id").agg(F.max_by(F.struct("ea", "eb"), "block").alias("e")).select(
        F.col("e.ea").alias("a"), F.col("e.eb").alias("b"), "conv_id")
    order = ["a", "b", "conv_id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _pieces, "a long, b long, first long, ids string")
    order = ["a", "b", "first"]
    digests = pieces.repartition("a", "b").sortWithinPartitions(*order).mapInArrow(
        _digests, "a long, b long, ends_sha256 string")
    return digests.select(F.struct("a", "b").alias("node"), "ends_sha256")


def prefix_trie(members: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each node of the trie of all beginnings of the conversations.

    ``members`` (conv_id, length) names every conversation, ``turns`` (conv_id, pos, a, b, chars)
    their turns numbered from 1. Returns conv_id (smallest member), depth, parent_conv_id (the
    parent's conv_id, null at the root), n_convs, n_children, n_leaves (childless nodes of the
    subtree, the node included), saved_tokens (over the subtree, (n_convs - 1) times the code
    points of a node's last text) and ends_sha256 (of the ids that end there, ascending).

    Conversations of the same turns share all nodes. One without turns is a member of the root. An empty
    table has no members, hence no root and no rows.
    """
    blocks = turn_blocks(members, turns)
    nodes = materialize(all_prefixes(
        blocks, "min(conv_id) AS conv_id, count(*) AS n_convs"), "nodes")
    children = nodes.where("depth > 0").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed(
        "parent", "node")
    nodes = materialize(nodes.join(children, "node", "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))), "nodes_with_children")
    owners = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("owned_from"), F.max_by(F.col("n_children") == 0, "depth").alias("leaf"))
    blocks = blocks.join(owners, "conv_id", "left")
    # Turns before the first owned node are repeats of what a smaller member has.
    first = F.coalesce("owned_from", F.lit(2**62))
    repeated = sum((F.when(F.col("block") * BLOCK + j + 1 < first, F.coalesce(f"c{j}", F.lit(0))).otherwise(0)
                    for j in range(BLOCK)), F.lit(0))
    credit = blocks.groupBy("conv_id").agg(F.sum(repeated).alias("repeated"))
    weighed = blocks.join(credit, "conv_id").withColumn("leaf", F.coalesce("leaf", F.lit(False)).cast("int"))
    read = F.col("chars_before")
    for j in range(BLOCK):
        weighed = weighed.withColumn(f"s{j}", F.greatest(F.col("repeated") - read, F.lit(0)))
        read = read + F.coalesce(f"c{j}", F.lit(0))
    sums = ", ".join(f"sum(s{j}) AS sum_s{j}" for j in range(BLOCK))
    subtree = all_prefixes(weighed, f"sum(leaf) AS n_leaves, {sums}")
    depth = F.col("depth") % BLOCK
    # The turn of depth d is the (d - 1)-th column; the root begins with the first.
    saved = F.when(F.col("depth") == 0, F.col("sum_s0"))
    for j in range(BLOCK):
        saved = saved.when(depth == (j + 1) % BLOCK, F.col(f"sum_s{j}"))
    subtree = subtree.select("node", "n_leaves", saved.alias("saved_tokens"))
    total = nodes.count()
    owner = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    below = skew_join(nodes.where("depth > 0"), owner.withColumnRenamed("n_children", "copies").where("copies > 0"),
                      "parent", "copies", total, "node")
    placed = root.unionByName(below).drop("parent")
    nobody = hashlib.sha256(b"").hexdigest()
    return placed.join(subtree, "node").join(ends_of(blocks), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"))


def conversation_trie(convs: DataFrame, every: int = 100, below: int = 6) -> DataFrame:
    """``prefix_trie`` of conversations (conv_id, turn, role, text) with borrowed heads.

    Turns are ordered by turn, null first, ties by the hash of their content. A null role or text
    is empty, rows without conv_id take no part, repeated rows are repeated turns, other columns
    are not read.
    """
    return prefix_trie(*borrow_heads(number_turns(convs), every, below))
