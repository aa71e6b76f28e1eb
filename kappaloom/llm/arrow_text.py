"""Whole texts as Arrow arrays inside a task: bounded portions, words, ragged views."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PORTION_BYTES = 4 << 20


def portions(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PORTION_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of ``column`` each.

    Every row comes in exactly one slice and whole; a longer text has a slice of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        slot = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = np.flatnonzero(np.diff(slot)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(lo, hi - lo)


def words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts and how many each text has; null has none."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0)  # a blank edge of a text gives an empty piece
    if pc.all(real, min_count=0).as_py():
        return flat, counts
    kept = real.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(counts)), counts)
    return flat.filter(real), np.bincount(owner[kept], minlength=len(counts))


def offsets_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array without nulls, as numpy views."""
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, kind, len(array) + 1 + array.offset)[array.offset:]
    return offs, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def starts_of(counts: np.ndarray) -> np.ndarray:
    """First position of each ragged row, and the total as the last entry."""
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each ragged row; an empty row gives 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    starts = starts_of(counts)
    return total[starts[1:]] - total[starts[:-1]]
