"""Ratcliff-Obershelp matching, the one string measure Spark has no expression for."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F

CACHE_LIMIT = 100_000


def best_label(candidate: str, labels: Sequence[str], threshold: float) -> str | None:
    """Most similar label, first on ties, or None below ``threshold``."""
    best, best_ratio = None, 0.0
    for label in labels:
        matcher = SequenceMatcher(None, candidate, label.lower())
        floor = max(best_ratio, threshold)
        # Both quick ratios are upper bounds, so skipping on them loses nothing.
        if matcher.real_quick_ratio() < floor or matcher.quick_ratio() < floor:
            continue
        ratio = matcher.ratio()
        if ratio > best_ratio:
            best, best_ratio = label, ratio
    return best if best_ratio >= threshold else None


def length_window(labels: Sequence[str], threshold: float) -> tuple[int, int]:
    """Candidate lengths for which 2*min/(a+b) can still reach ``threshold``.

    One character of slack on both sides keeps rounding out of the decision.
    """
    sizes = [len(label.lower()) for label in labels]
    if threshold <= 0:
        return 0, 2**31 - 1
    low = math.floor(min(sizes) * threshold / (2 - threshold)) - 1
    high = math.ceil(max(sizes) * (2 - threshold) / threshold) + 1
    return max(low, 0), high


def fuzzy_label(
    book: Column, candidate: Column, books: Mapping[str, Sequence[str]], threshold: float
) -> Column:
    """Arrow-batched lookup in the labels of each row's book; null candidates cost nothing.

    Hot answers repeat: a batch compares its distinct answers, and each Python worker remembers
    a bounded number of them. That keeps the stage free of any shuffle, whatever the skew.
    """
    books = {name: list(labels) for name, labels in books.items()}
    memory: dict[tuple[str, str], str | None] = {}

    @F.pandas_udf("string")
    def match(names: pd.Series, candidates: pd.Series) -> pd.Series:
        asked = pd.DataFrame({"book": names, "candidate": candidates})
        known = asked.dropna().drop_duplicates()
        if len(memory) + len(known) > CACHE_LIMIT:
            memory.clear()
        for key in known.itertuples(index=False, name=None):
            if key not in memory:
                memory[key] = best_label(key[1], books[key[0]], threshold)
        return pd.Series([memory.get(key) for key in zip(names, candidates)], dtype=object)

    size = F.length(candidate)
    fits = F.lit(False)
    for name, labels in books.items():
        low, high = length_window(labels, threshold)
        fits = F.when(book == name, (size >= low) & (size <= high)).otherwise(fits)
    return match(book, F.when(fits, candidate))
