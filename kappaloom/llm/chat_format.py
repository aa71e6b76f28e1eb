"""Chat formatting by columnar byte assembly, and reading it back.

A turn is written as

    ### role:
    text</turn>

and a line feed. Inside roles and texts a backslash goes before every backslash, ``#`` and ``<``
(in roles before ``:`` and line feeds, too), so that neither a header nor an end of turn can
occur in them, and taking the backslashes out again gives back what was written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from kappaloom.llm.arrow_text import offsets_of, portions, starts_of

# Fixed values of the template.
HEAD, MIDDLE, TAIL = b"### ", b":\n", b"</turn>\n"
ESCAPE = 0x5C
IN_TEXT, IN_ROLE = b"\\#<", b"\\#<:\n"
LEARNED_ROLE = "assistant"

#: bytes of turns that are assembled at a time; a longer conversation comes in several parts
PORTION_BYTES = 4 << 20
FORMAT_SCHEMA = "conv_id long, part int, formatted string, loss array<struct<start:long,end:long>>"


def escaped(values: pa.Array, special: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length of each) of the values with a backslash before every special byte."""
    offsets, data = offsets_of(values)
    data = data[offsets[0]:offsets[-1]]
    marked = np.isin(data, np.frombuffer(special, np.uint8))
    place = np.arange(len(data)) + np.cumsum(marked)
    out = np.full(len(data) + int(marked.sum()), ESCAPE, np.uint8)
    out[place] = data
    more = starts_of(marked.astype(np.int64))
    at = (offsets - offsets[0]).astype(np.int64)
    return out, np.diff(at + more[at])


def unescaped(data: bytes) -> bytes:
    """The bytes without the escaping backslashes."""
    raw = np.frombuffer(data, np.uint8)
    slash = raw == ESCAPE
    if not slash.any():
        return data
    # In a run of backslashes the 1st, 3rd, ... escape what follows them.
    at = np.arange(len(raw))
    run = np.maximum.accumulate(np.where(~slash, at, -1))
    return raw[~(slash & ((at - run) % 2 == 1))].tobytes()


def _scatter(out: np.ndarray, begin: np.ndarray, data: np.ndarray, length: np.ndarray) -> None:
    """Copy ragged ``data`` to the places that begin at ``begin``."""
    source = starts_of(length)[:-1]
    out[np.arange(len(data)) + np.repeat(begin - source, length)] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, end of each turn in it, begin and end of each text in it), in bytes."""
    n = len(texts)
    role, role_size = escaped(roles, IN_ROLE)
    text, text_size = escaped(texts, IN_TEXT)
    size = len(HEAD) + role_size + len(MIDDLE) + text_size + len(TAIL)
    edge = starts_of(size)
    out = np.empty(int(edge[-1]), np.uint8)
    role_at = edge[:-1] + len(HEAD)
    middle = role_at + role_size
    text_at = middle + len(MIDDLE)
    tail = text_at + text_size
    for at, fixed in ((edge[:-1], HEAD), (middle, MIDDLE), (tail, TAIL)):
        out[(at[:, None] + np.arange(len(fixed))).ravel()] = np.tile(np.frombuffer(fixed, np.uint8), n)
    _scatter(out, role_at, role, role_size)
    _scatter(out, text_at, text, text_size)
    return out, edge[1:], text_at, tail


def _by_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Turns in portions of some ``PORTION_BYTES`` and at most one longer turn, that end with a
    conversation where that is possible."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in portions(batches, limit=PORTION_BYTES):
        held.append(part)
        size += part.nbytes
        if size < PORTION_BYTES:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        key = pc.fill_null(rows["conv"], 0).to_numpy() * 2 + pc.is_null(rows["conv"]).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(key != key[-1])
        cut = int(other[-1]) + 1 if len(other) else rows.num_rows
        yield rows.slice(0, cut)
        rows = rows.slice(cut).combine_chunks()
        held, size = rows.to_batches(), rows.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, part, formatted, loss): conversations in the template, with their loss mask.

    Rows go by turn, ties by role and text. ``loss`` are the places of the assistant's escaped
    texts in ``formatted``, in code points, the end exclusive. A null role or text is empty; a
    null turn comes first; rows of null conversations are one conversation. Repeated rows are
    turns of their own. An empty table gives an empty one; other columns are not read.

    Conversations are dealt by hash and stream in order: a task holds a few megabytes. A
    conversation that is larger comes in several parts, in order, cut between turns.
    """
    picked = turns.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = picked.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = object(), 0
        for rows in _by_turns(batches):
            if not rows.num_rows:
                continue
            conv = rows["conv"].to_pylist()
            roles, texts = rows["role"].combine_chunks(), rows["text"].combine_chunks()
            out, end, text_at, tail = assemble(_flat(roles), _flat(texts))
            first = [i for i in range(len(conv)) if i == 0 or conv[i] != conv[i - 1]]
            cut = np.append(np.array(first)[1:], len(conv)) - 1
            edge = np.concatenate([[0], end[cut]])
            if edge[-1] > np.iinfo(np.int32).max:
                raise OverflowError(f"a turn of conversation {conv[-1]} is too long for a string")
            # Code points before a byte: bytes that do not continue a character.
            points = starts_of(((out & 0xC0) != 0x80).astype(np.int64))
            learned = np.flatnonzero(pc.equal(roles, LEARNED_ROLE).to_numpy(zero_copy_only=False))
            owner = np.searchsorted(cut, learned)
            base = points[edge[:-1]][owner]
            spans = pa.StructArray.from_arrays(
                [pa.array(points[text_at[learned]] - base), pa.array(points[tail[learned]] - base)], ["start", "end"])
            loss = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(owner, np.arange(len(first) + 1)).astype(np.int32)), spans)
            formatted = pa.StringArray.from_buffers(
                len(first), pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(out))
            part = part + 1 if conv[0] == last else 0
            parts = np.zeros(len(first), np.int32)
            parts[0] = part
            if len(first) > 1:
                part = 0
            last = conv[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv[i] for i in first], pa.int64()), pa.array(parts), formatted, loss],
                ["conv_id", "part", "formatted", "loss"])

    return dealt.mapInArrow(write, FORMAT_SCHEMA)


def _flat(values: pa.Array) -> pa.Array:
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values


def read_turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of every turn of a formatted conversation."""
    raw = np.frombuffer(formatted, np.uint8)
    found = []
    at = 0
    for end in _unescaped_ends(raw):
        body = formatted[at + len(HEAD):end]
        middle = _first_middle(body)
        found.append((unescaped(body[:middle]), unescaped(body[middle + len(MIDDLE):])))
        at = end + len(TAIL)
    return found


def _unescaped_ends(raw: np.ndarray) -> list[int]:
    """Where turns end: the places of ``<`` without a backslash."""
    at = np.flatnonzero(raw == 0x3C)
    place = np.arange(len(raw))
    run = np.maximum.accumulate(np.where(raw != ESCAPE, place, -1))
    before = at - 1 - run[np.maximum(at - 1, 0)]
    return at[(at == 0) | (before % 2 == 0)].tolist()


def _first_middle(body: bytes) -> int:
    at = body.find(MIDDLE)
    while (at - len(body[:at].rstrip(b"\\"))) % 2:
        at = body.find(MIDDLE, at + 1)
    return at


def chat_digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back.

    ``formatted`` is a result of ``format_chats``: the parts of a conversation follow each other.
    The hashes grow part by part, so no conversation is held as a whole.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["part"] == 0:
                    if state is not None:
                        done.append(state)
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["formatted"]
                for role, said in read_turns(text.encode()):
                    state[1] += 1
                    state[2].update(role + b"\n" + said + b"\n")
                for span in row["loss"]:
                    learned = unescaped(text[span["start"]:span["end"]].encode())
                    state[3] += len(learned.decode())
                    state[4].update(learned)
                state[5] += len(text)
            yield _digest_rows(done)
        if state is not None:
            yield _digest_rows([state])

    return formatted.mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long")


def _digest_rows(states: list) -> pa.RecordBatch:
    columns = list(zip(*states)) if states else [()] * 6
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([
        pa.array([x.hexdigest() for x in c] if k == pa.string() else list(c), k)
        for c, k in zip(columns, kinds)], names)
