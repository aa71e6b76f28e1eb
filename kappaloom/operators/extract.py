"""One canonical label from a noisy raw answer: exact, whole word, token, fuzzy.

The labels of all datasets are one lookup table of keys. What a stage reads from an answer, by
one regular expression for the whole vocabulary, is a key; its label comes from a join. So the
cost of an answer hardly depends on the number of labels.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kappaloom.fixed_values import FUZZY_CHARS, FUZZY_THRESHOLD
from kappaloom.functions.fuzzy import fuzzy_label
from kappaloom.functions.text import (
    WORD, clean_answer, is_word_char, normal_form, normal_form_py, quoted, strip_space,
)
from kappaloom.operators.joins import BROADCAST_BYTES, skew_join, table_bytes
from kappaloom.session import literal_table, materialize

STAGES = ("exact", "scan", "token", "fuzzy")
Vocabulary = Sequence[str]
KEY_SCHEMA = pa.schema([("_book", pa.string()), ("_kind", pa.string()), ("_key", pa.string()),
                        ("_label", pa.string()), ("_ord", pa.int32())])


def label_keys(book: str, labels: Vocabulary) -> list[tuple]:
    """(book, kind, key, label, ord): how a label may be written, by stage.

    normal: lower case, a-z and 0-9 only; as: lower case; word: lower case, found by the scan;
    token: a run of letters and digits. Of labels with one key the last counts for an equal
    answer, the first for a scanned word.
    """
    keys: dict[tuple[str, str], tuple[str, int]] = {}
    for i, label in enumerate(labels):
        lower, normal = label.lower(), normal_form_py(label)
        keys["as", lower] = (label, i)
        keys.setdefault(("word", lower), (label, i))
        if normal:
            keys["normal", normal] = (label, i)
            keys.setdefault(("token", normal), (label, i))
        if re.fullmatch("[a-z0-9]+", lower):
            keys["token", lower] = (label, i)
    return [(book, kind, key, label, i) for (kind, key), (label, i) in keys.items()]


def any_of(words: Mapping[str, str]) -> str:
    """Regex for the longest of the words at a place, each with what must follow it.

    Words share their beginnings: a place is left at the first letter that no word has there.
    """
    root: dict = {}
    for word, end in words.items():
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = end

    def regex(node: dict) -> str:
        ways = [(ch if ch.isalnum() else quoted(ch)) + regex(below) for ch, below in sorted(node.items()) if ch]
        if "" in node:
            ways.append(node[""])
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return regex(root)


def word_pattern(labels: Vocabulary) -> str:
    """Every place where a label stands as a whole word yields the longest such label.

    Letter case does not count; word characters are Python's.
    """
    after = {True: f"(?!{WORD})", False: f"(?={WORD})"}
    before = {True: f"(?<!{WORD})", False: f"(?<={WORD})"}
    ways = []
    for kind in (True, False):
        words = {l.lower(): after[is_word_char(l[-1])] for l in labels if is_word_char(l[0]) == kind}
        if words:
            ways.append(before[kind] + any_of(words))
    return f"(?iu)(?=({'|'.join(ways)}))"


def token_pattern(labels: Vocabulary) -> str | None:
    """The first run of ASCII letters and digits that is a label."""
    keys = [key for _, kind, key, _, _ in label_keys("", labels) if kind == "token"]
    end = "(?![a-z0-9])"
    return f"(?i)(?<![a-z0-9]){any_of({k: end for k in keys})}" if keys else None


def scanned_word(cleaned: Column, labels: Vocabulary) -> Column:
    """The longest label in the answer, in lower case; first in label order on ties."""
    found = F.array_distinct(F.transform(
        F.regexp_extract_all(cleaned, F.lit(word_pattern(labels)), F.lit(1)), F.lower))
    longest = F.filter(found, lambda w: F.length(w) == F.array_max(F.transform(found, F.length)))
    places: dict[str, int] = {}
    for i, label in enumerate(labels):
        places.setdefault(label.lower(), i)
    order = F.from_json(F.lit(json.dumps(places)), "map<string,int>")
    first = F.array_min(F.transform(longest, lambda w: F.struct(order[w].alias("ord"), w.alias("w"))))["w"]
    return F.when(F.size(longest) == 1, longest[0]).when(F.size(longest) > 1, first)


def fuzzy_candidate(cleaned: Column, chars: int = FUZZY_CHARS) -> Column:
    return F.lower(F.substring(cleaned, 1, chars))


def extract_labels(
    df: DataFrame,
    vocabularies: Mapping[str, Vocabulary] | Vocabulary,
    raw: str = "raw",
    threshold: float = FUZZY_THRESHOLD,
    stages: Sequence[str] = STAGES,
    fuzzy_chars: int = FUZZY_CHARS,
) -> DataFrame:
    """Add ``pred`` and ``stage`` ('empty', a stage name, or 'none').

    With a mapping every dataset is read with its own vocabulary. Everything but the
    fuzzy stage is built from Spark expressions and joins with the key table, whose size
    the planner knows; only answers that no earlier stage could read, and that are of a
    length that can match at all, reach Python. The fuzzy stage compares the first
    ``fuzzy_chars`` characters.
    """
    by_dataset = isinstance(vocabularies, Mapping)
    books = dict(vocabularies) if by_dataset else {"": list(vocabularies)}
    if not books or any(not labels or "" in labels for labels in books.values()):
        raise ValueError("a vocabulary needs at least one label, and no label may be empty")
    spark = df.sparkSession
    keys = literal_table(spark, KEY_SCHEMA, [k for book, labels in books.items() for k in label_keys(book, labels)])
    book = F.col("dataset") if by_dataset else F.lit("")
    cleaned = F.col("_cleaned")

    def each_book(build: Callable[[Vocabulary], Column | None]) -> Column:
        out = F.lit(None).cast("string")
        for name, labels in books.items():
            found = build(labels)
            if found is not None:
                out = F.when(book == name, found).otherwise(out)
        return out

    def looked_up(rows: DataFrame, kind: str, key: Column, name: str) -> DataFrame:
        own = keys.where(F.col("_kind") == kind).select(
            F.col("_book").alias("_b"), F.col("_key").alias("_k"), F.col("_label").alias(name))
        rows = rows.withColumn("_found", key)
        return rows.join(own, (book == F.col("_b")) & (F.col("_found") == F.col("_k")), "left").drop(
            "_b", "_k", "_found")

    stripped = strip_space(F.col(raw))
    out = df.withColumn("_cleaned", F.when(stripped != "", clean_answer(F.col(raw))))
    nothing = F.lit(None).cast("string")
    if "exact" in stages:
        out = looked_up(out, "normal", F.nullif(normal_form(cleaned), F.lit("")), "_normal")
        out = looked_up(out, "as", F.when(F.col("_normal").isNull(), F.lower(cleaned)), "_as")
        out = out.withColumn("_exact", F.coalesce("_normal", "_as")).drop("_normal", "_as")
    else:
        out = out.withColumn("_exact", nothing)
    if "scan" in stages:
        word = each_book(lambda labels: scanned_word(cleaned, labels))
        out = looked_up(out, "word", F.when(F.col("_exact").isNull(), word), "_scan")
    else:
        out = out.withColumn("_scan", nothing)
    if "token" in stages:
        def token(labels):
            pattern = token_pattern(labels)
            return None if pattern is None else F.lower(F.regexp_extract(cleaned, pattern, 0))

        unread = F.coalesce("_exact", "_scan").isNull()
        out = looked_up(out, "token", F.when(unread, F.nullif(each_book(token), F.lit(""))), "_token")
    else:
        out = out.withColumn("_token", nothing)
    if "fuzzy" in stages:
        unread = F.coalesce("_exact", "_scan", "_token").isNull()
        out = out.withColumn("_fuzzy", fuzzy_label(
            book, F.when(unread, fuzzy_candidate(cleaned, fuzzy_chars)), books, threshold))
    else:
        out = out.withColumn("_fuzzy", nothing)
    marks = F.when(F.col("_cleaned").isNull(), "empty")
    for name in STAGES:
        marks = marks.when(F.col(f"_{name}").isNotNull(), name)
    return (
        out.withColumn("pred", F.coalesce(*[f"_{name}" for name in STAGES]))
        .withColumn("stage", marks.otherwise("none"))
        .drop("_cleaned", *[f"_{name}" for name in STAGES])
    )


def extract_distinct(
    df: DataFrame, vocabularies: Mapping[str, Vocabulary] | Vocabulary, raw: str = "raw",
    salt_by: str = "item_id", limit: int = BROADCAST_BYTES, **options,
) -> DataFrame:
    """``extract_labels`` that reads each distinct answer of a dataset once, for rows that repeat answers.

    ``df`` is read twice: write it first. Up to ``limit`` bytes the readings go to the rows, which stay in
    place; beyond it both meet by the answer, frequent answers salted by ``salt_by``.
    """
    given = df.groupBy("dataset", raw).agg(F.count("*").alias("_copies"))
    read = materialize(extract_labels(given, vocabularies, raw, **options), "readings")
    if table_bytes(read) <= limit:
        own = read.select(F.col("dataset").alias("_dataset"), F.col(raw).alias("_raw"), "pred", "stage")
        same = F.col("dataset").eqNullSafe(F.col("_dataset")) & F.col(raw).eqNullSafe(F.col("_raw"))
        return df.join(F.broadcast(own), same).select(*df.columns, "pred", "stage")
    key = F.sha2(F.to_json(F.struct("dataset", raw), {"ignoreNullFields": "false"}), 256)
    total = read.agg(F.sum("_copies")).first()[0] or 0
    keyed = read.select(key.alias("_answer"), "_copies", "pred", "stage")
    return skew_join(df.withColumn("_answer", key), keyed, "_answer", "_copies", total, salt_by).select(
        *df.columns, "pred", "stage")


def stage_audit(extracted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many answers each stage read, per ``keys``."""
    return extracted.groupBy(*keys, "stage").agg(F.count("*").alias("answers"))
