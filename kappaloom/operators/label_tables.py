"""Canonical labels from noisy answers where the labels are a table of any size.

The four stages are those of ``extract``, but nothing of the vocabulary passes through the driver
or stands in an expression. A label is written as keys, an answer as pieces: its normal form, its
runs of whole words, its runs of letters and digits. One join and one aggregation read all that
have an exact, a whole-word or a token match. What is left meets labels of fitting length, block by
block, and signatures of both decide which pairs the string matcher has to look at.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kappaloom.fixed_values import FUZZY_CHARS, FUZZY_THRESHOLD
from kappaloom.functions.text import WORD, clean_answer, normal_form, strip_space
from kappaloom.operators.extract import STAGES, fuzzy_candidate
from kappaloom.operators.joins import skew_join
from kappaloom.session import materialize

#: labels and answers that one task compares at a time
BLOCK_LABELS, BLOCK_ANSWERS = 20_000, 5_000
#: label lengths of one band
BAND = 8
CHAR_BITS, PAIR_BITS = 128, 256
#: characters of a run by which misspelt answers find labels, and labels that one answer meets that way;
#: answers that would meet more are compared block by block
GRAM, GRAM_LABELS = 6, 1_000


def key_table(vocabulary: DataFrame) -> DataFrame:
    """(book, kind, key, label, ord) from (dataset, label, label_ord): how a label may be written.

    normal: a-z and 0-9 only; as: lower case; word: lower case, found as whole words; token: a run
    of letters and digits. Of labels with one key the last counts for an equal answer, the first
    for a word, and for a token the last that is one as it stands, else the first.
    """
    lower, normal, order = F.lower("label"), normal_form(F.col("label")), F.col("label_ord").cast("int")
    forms = F.array(*[
        F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(rank).alias("rank"), weight.alias("weight"))
        for kind, key, rank, weight in (
            ("as", lower, 0, order), ("normal", normal, 0, order), ("word", lower, 0, -order),
            ("token", normal, 0, -order), ("token", F.when(lower.rlike("^[a-z0-9]+$"), lower), 1, order))])
    one = F.struct("rank", "weight")
    return (
        vocabulary.select(F.col("dataset").alias("book"), "label", order.alias("ord"), F.inline(forms))
        .where("key <> ''").groupBy("book", "kind", "key")
        .agg(F.max_by(F.struct("label", "ord"), one).alias("l")).select("book", "kind", "key", "l.label", "l.ord"))


def segments(text: Column) -> Column:
    """Runs of word characters and what is between them, in turn."""
    return F.regexp_extract_all(text, F.lit(f"{WORD}+|{WORD.replace('[', '[^')}+"), F.lit(0))


def whole_words(parts: Column, most: Column) -> Column:
    """All runs of up to ``most`` segments that begin and end at a word boundary, each once."""
    n = F.size(parts)
    first = parts[0].rlike(f"^{WORD}")

    def is_word(i: Column) -> Column:
        return (i % 2 == 0) == first

    def runs(i: Column) -> Column:
        ends = F.filter(F.sequence(i, F.least(n - 1, i + most - 1)), lambda j: is_word(j) | (j < n - 1))
        return F.transform(ends, lambda j: F.array_join(F.slice(parts, i + 1, j - i + 1), ""))

    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: is_word(i) | (i > 0))
    return F.when(n > 0, F.array_distinct(F.flatten(F.transform(starts, runs))))


def key_mark() -> Column:
    """128 bits that stand for book, kind and key: pieces are many, and their texts need not travel."""
    return F.unhex(F.md5(F.concat_ws("\0", "book", "kind", "key")))


def pieces(answers: DataFrame, limits: DataFrame, stages: Sequence[str]) -> DataFrame:
    """(answer, mark, place): all that an answer could be read by, see ``key_mark``.

    ``answers`` has answer, dataset and cleaned; ``limits`` the most segments and characters of a
    label of each book.
    """
    text = F.col("cleaned")
    known = answers.join(limits, answers["dataset"] == limits["book"]).select(
        "answer", "book", "cleaned", "most", "longest", segments(F.lower(text)).alias("parts"),
        F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)).alias("tokens"))
    none = F.array().cast("array<struct<kind:string,key:string,place:int>>")

    def piece(kind: str, key: Column, place: Column = F.lit(0)) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), place.cast("int").alias("place"))

    found = []
    if "exact" in stages:
        found.append(F.array(piece("normal", normal_form(text)), piece("as", F.lower(text))))
    if "scan" in stages:
        fitting = F.filter(F.coalesce(whole_words(F.col("parts"), F.col("most")), F.array().cast("array<string>")),
                           lambda w: F.char_length(w) <= F.col("longest"))
        found.append(F.transform(fitting, lambda w: piece("word", w, F.char_length(w))))
    if "token" in stages:
        found.append(F.transform(F.col("tokens"), lambda w, i: piece("token", F.lower(w), i)))
    found = known.select("answer", "book", F.inline(F.concat(none, *found)))
    return found.select("answer", key_mark().alias("mark"), "place")


def read_by_keys(answers: DataFrame, vocabulary: DataFrame, stages: Sequence[str]) -> DataFrame:
    """(answer, exact, scan, token) of the answers that one of these stages reads.

    The planner sends the keys to all tasks where their table is small, and deals both sides by
    key where it is not. Matches combine inside each task before they are dealt by answer.
    """
    size = F.size(segments(F.lower("label")))
    limits = materialize(vocabulary.groupBy(F.col("dataset").alias("book")).agg(
        F.max(size).alias("most"), F.max(F.char_length(F.lower("label"))).alias("longest")), "limits")
    keys = materialize(key_table(vocabulary).select(key_mark().alias("mark"), "kind", "label", "ord"), "label_keys")
    met = pieces(answers, limits, stages).join(keys, "mark")
    kind, label = F.col("kind"), F.col("label")
    return met.groupBy("answer").agg(
        F.coalesce(F.max(F.when(kind == "normal", label)), F.max(F.when(kind == "as", label))).alias("exact"),
        F.max_by(label, F.when(kind == "word", F.struct("place", -F.col("ord")))).alias("scan"),
        F.min_by(label, F.when(kind == "token", F.col("place"))).alias("token"))


class Signatures:
    """Characters and neighbouring pairs of texts as bits, each repeat of one an element of its own.

    ``spare`` is how many elements share a bit with another of their text: common elements are at most
    the common bits and the lesser spare.
    """

    def __init__(self, texts: Sequence[str]):
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(texts)), self.size)
        self.chars, self.char_spare = _bits(points, owner, len(texts), CHAR_BITS)
        inside = owner[1:] == owner[:-1]
        pairs = (points[:-1] * np.uint64(0x110000) + points[1:])[inside]
        self.pairs, self.pair_spare = _bits(pairs, owner[1:][inside], len(texts), PAIR_BITS)

    def bounds(self, other: "Signatures", i: int) -> np.ndarray:
        """An upper bound of the ratio of each text here to text ``i`` of the other.

        No more characters match than both texts have. They match in blocks; between two blocks
        something is unmatched on one side at least, and a block of n shares n - 1 pairs. So of m
        matched characters at least 3 m - (both sizes) - 1 pairs are common.
        """
        both = self.size + other.size[i]
        chars = np.bitwise_count(self.chars & other.chars[i]).sum(axis=1).astype(np.int64)
        chars += np.minimum(self.char_spare, other.char_spare[i])
        pairs = np.bitwise_count(self.pairs & other.pairs[i]).sum(axis=1).astype(np.int64)
        pairs += np.minimum(self.pair_spare, other.pair_spare[i])
        matched = np.minimum(np.minimum(chars, (pairs + both + 1) // 3), np.minimum(self.size, other.size[i]))
        return 2.0 * matched / np.maximum(both, 1)


def _bits(elements: np.ndarray, owner: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort([elements, owner])
    value, row = elements[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    at = np.arange(len(value))
    repeat = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64) if len(value) else value
    mixed = (value * np.uint64(0x9E3779B97F4A7C15)) ^ (repeat * np.uint64(0xD6E8FEB86659FD93))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    bit = (mixed >> np.uint64(40)) % np.uint64(width)
    words = np.zeros(n * (width // 64), np.uint64)
    np.bitwise_or.at(words, row * (width // 64) + (bit // np.uint64(64)).astype(np.int64), np.uint64(1) << bit % np.uint64(64))
    words = words.reshape(n, -1)
    used = np.bitwise_count(words).sum(axis=1).astype(np.int64)
    return words, np.bincount(owner, minlength=n) - used


def closest(candidates: Sequence[str], labels: Sequence[str], order: np.ndarray, threshold: float) -> list[tuple[int, float, int]]:
    """(candidate, ratio, label) for each candidate that some label reaches, as positions.

    The most similar label, first in ``order`` on ties, by ``difflib``; pairs are looked at by
    falling bound, until no bound is left that could win.
    """
    own, asked = Signatures(labels), Signatures(candidates)
    out = []
    for i, candidate in enumerate(candidates):
        bound = own.bounds(asked, i)
        fits = np.flatnonzero(bound >= threshold)
        best, winner = 0.0, -1
        for k in fits[np.lexsort([order[fits], -bound[fits]])].tolist():
            if bound[k] < best:
                break
            ratio = SequenceMatcher(None, candidate, labels[k]).ratio()
            if ratio >= threshold and (ratio > best or (ratio == best and winner >= 0 and order[k] < order[winner])):
                best, winner = ratio, k
        if winner >= 0:
            out.append((i, best, winner))
    return out


def fuzzy_matches(candidates: DataFrame, vocabulary: DataFrame, threshold: float) -> DataFrame:
    """(book, candidate, label): the most similar label of each distinct (book, candidate), where one
    reaches ``threshold``.

    Candidates that have a close label are settled by what they share with it, see ``matches_by_grams``.
    For the others: a ratio can only be reached by labels of a length near the candidate's. Labels lie in bands of
    lengths, cut into blocks; candidates go to every block of the bands that fit, also in
    blocks. A task compares one block with one other: hot lengths and books are many tasks.
    """
    if threshold <= 0:
        raise ValueError("the threshold has to be above 0")
    candidates = materialize(candidates, "candidates")
    settled = materialize(matches_by_grams(candidates, vocabulary, threshold), "settled")
    candidates = candidates.join(settled, ["book", "candidate"], "left_anti")
    lower = F.lower("label")
    labels = vocabulary.select(
        F.col("dataset").alias("book"), "label", lower.alias("lower"), F.col("label_ord").cast("int").alias("ord"),
        F.expr(f"char_length(lower(label)) div {BAND}").alias("band"))
    size = F.char_length("candidate")
    low = F.greatest(F.floor(size * (threshold / (2 - threshold))) - 1, F.lit(0))
    high = F.ceil(size * ((2 - threshold) / threshold)) + 1
    longest = labels.groupBy("book").agg(F.max("band").alias("last"))
    asked = candidates.join(longest, "book").withColumn("low", F.expr("0").cast("long")).withColumn(
        "low", (low / BAND).cast("long")).withColumn("high", F.least((high / BAND).cast("long"), F.col("last")))
    asked = materialize(asked.where("low <= high").select(
        "book", "candidate", F.explode(F.sequence("low", "high")).alias("band")), "asked")
    counts = labels.groupBy("book", "band").agg(F.count("*").alias("labels")).join(
        asked.groupBy("book", "band").agg(F.count("*").alias("answers")), ["book", "band"])
    counts = materialize(counts.select(
        "book", "band", F.ceil(F.col("labels") / BLOCK_LABELS).cast("int").alias("parts"),
        F.ceil(F.col("answers") / BLOCK_ANSWERS).cast("int").alias("slices")), "bands")

    def block(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    place = ["book", "band", "part", "slice"]
    left = asked.join(counts, ["book", "band"]).withColumn("slice", block("candidate", "slices")).select(
        "book", "band", every("parts").alias("part"), "slice", "candidate")
    right = labels.join(counts, ["book", "band"]).withColumn("part", block("lower", "parts")).select(
        "book", "band", "part", every("slices").alias("slice"), "lower", "ord", "label")

    def compare(key, asked: pa.Table, held: pa.Table) -> pa.Table:
        found = closest(asked["candidate"].to_pylist(), held["lower"].to_pylist(), held["ord"].to_numpy(), threshold) \
            if len(asked) and len(held) else []
        who, ratio, which = zip(*found) if found else ((), (), ())
        return pa.table({
            "book": pa.array([key[0].as_py()] * len(who), pa.string()),
            "candidate": asked["candidate"].take(pa.array(who, pa.int64())).cast(pa.string()),
            "ratio": pa.array(ratio, pa.float64()),
            "ord": held["ord"].take(pa.array(which, pa.int64())),
            "label": held["label"].take(pa.array(which, pa.int64())).cast(pa.string())})

    found = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(
        compare, "book string, candidate string, ratio double, ord int, label string")
    return settled.unionByName(most_similar(found))


def most_similar(found: DataFrame) -> DataFrame:
    """(book, candidate, label): the label of the highest ratio, first in order on ties."""
    return found.groupBy("book", "candidate").agg(F.max_by("label", F.struct("ratio", -F.col("ord"))).alias("label"))


def grams(text: Column) -> Column:
    """All runs of ``GRAM`` characters, in order; none of a shorter text."""
    places = F.sequence(F.lit(1), F.greatest(F.char_length(text) - (GRAM - 1), F.lit(1)))
    return F.when(F.char_length(text) >= GRAM, F.transform(places, lambda i: F.substr(text, i, F.lit(GRAM))))


def ratios(candidates: pd.Series, labels: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(candidates, labels)], dtype=float)


def matches_by_grams(candidates: DataFrame, vocabulary: DataFrame, threshold: float) -> DataFrame:
    """``fuzzy_matches`` of the candidates that share rare runs of characters with a close label; no others.

    The nearest of the labels that share one of a candidate's rarest runs gives a ratio r that the best
    label reaches too. From a candidate of n characters to a label with that ratio lead at most 2 n (1 - r) / r
    deletions and insertions, and each spoils at most one of several runs that do not overlap. So of one run more
    the label has one as it is: the labels that hold such runs, the rarest ones, are all that can win.
    Where these are more than ``GRAM_LABELS``, or the candidate is too short, nothing is said of it.
    """
    similarity = F.pandas_udf(ratios, "double")
    labels = vocabulary.select(
        F.col("dataset").alias("book"), "label", F.lower("label").alias("lower"), F.col("label_ord").cast("int").alias("ord")).repartition("book", "lower")
    held = labels.select("book", "label", "lower", "ord", F.explode(F.array_distinct(grams(F.col("lower")))).alias("gram"))
    often = held.groupBy("book", "gram").agg(F.count("*").alias("n"))
    asked = candidates.select("book", "candidate", F.posexplode(grams(F.col("candidate"))).alias("pos", "gram"))
    run = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pos", "gram")
    runs = materialize(asked.join(often, ["book", "gram"], "left").groupBy("book", "candidate").agg(
        F.sort_array(F.collect_list(run)).alias("runs")), "candidate_runs")

    rare = F.slice(F.filter("runs", lambda x: (x["n"] > 0) & (x["n"] <= GRAM_LABELS)), 1, 3)
    met = runs.select("book", "candidate", F.explode(F.array_distinct(F.transform(rare, lambda x: x["gram"]))).alias("gram")).join(
        held, ["book", "gram"])
    nearest = met.groupBy("book", "candidate").agg(
        F.min_by("lower", F.struct(F.levenshtein("candidate", "lower"), "ord")).alias("lower"))
    reached = nearest.select("book", "candidate", similarity("candidate", "lower").alias("r")).where(F.col("r") >= threshold)
    changes = F.floor(2 * F.char_length("candidate") * (1 - F.col("r")) / F.col("r") + 1e-6).cast("int")
    known = materialize(reached.withColumn("changes", changes), "reached").join(runs, ["book", "candidate"])
    apart = F.expr(
        "aggregate(runs, slice(runs, 1, 0), (got, x) -> if(size(got) <= changes and "
        f"not exists(got, y -> abs(y.pos - x.pos) < {GRAM}), concat(got, array(x)), got))")
    even = F.filter("runs", lambda x: (x["pos"] % GRAM == 0) & (x["pos"] <= F.col("changes") * GRAM))
    chosen = known.withColumn("apart", apart).withColumn(
        "chosen", F.when(F.size("apart") > F.col("changes"), F.col("apart")).otherwise(even)).where(
        (F.size("chosen") > F.col("changes"))
        & (F.aggregate("chosen", F.lit(0).cast("long"), lambda total, x: total + x["n"]) <= GRAM_LABELS))
    pairs = chosen.select("book", "candidate", "changes", F.explode(F.filter("chosen", lambda x: x["n"] > 0)["gram"]).alias("gram")).join(
        held, ["book", "gram"]).where(F.expr("levenshtein(candidate, lower, changes) >= 0"))
    found = pairs.dropDuplicates(["book", "candidate", "ord"]).withColumn("ratio", similarity("candidate", "lower"))
    return most_similar(found.where(F.col("ratio") >= threshold))


def read_answers(
    answers: DataFrame, vocabulary: DataFrame, stages: Sequence[str] = STAGES,
    threshold: float = FUZZY_THRESHOLD, fuzzy_chars: int = FUZZY_CHARS,
) -> DataFrame:
    """(answer, pred, stage) of each row of ``answers`` (answer, dataset, cleaned), one per answer."""
    read = answers.join(read_by_keys(answers, vocabulary, stages), "answer", "left")
    if "fuzzy" in stages:
        read = materialize(read, "read_by_keys")
        candidate = fuzzy_candidate(F.col("cleaned"), fuzzy_chars)
        open_ = F.coalesce("exact", "scan", "token").isNull()
        asked = read.where(open_).select(F.col("dataset").alias("book"), candidate.alias("candidate")).distinct()
        found = fuzzy_matches(asked, vocabulary, threshold).withColumnRenamed("label", "fuzzy")
        read = read.withColumn("candidate", F.when(open_, candidate)).join(
            found.withColumnRenamed("book", "dataset"), ["dataset", "candidate"], "left")
    else:
        read = read.withColumn("fuzzy", F.lit(None).cast("string"))
    stage = F.lit("none")
    for name in reversed(STAGES):
        stage = F.when(F.col(name).isNotNull(), name).otherwise(stage)
    return read.select("answer", F.coalesce(*STAGES).alias("pred"), stage.alias("stage"))


def extract_with_table(
    df: DataFrame, vocabulary: DataFrame, raw: str = "raw", threshold: float = FUZZY_THRESHOLD,
    stages: Sequence[str] = STAGES, fuzzy_chars: int = FUZZY_CHARS, salt_by: str = "item_id",
) -> DataFrame:
    """Add ``pred`` and ``stage`` ('empty', a stage name, or 'none'), as ``extract_labels`` does.

    ``vocabulary`` (dataset, label, label_ord) is a table of any size. Every distinct answer is read
    once and handed to all rows that gave it; answers that own a large share of the rows are
    salted by ``salt_by``. ``df`` is read twice: write it first where it is costly. Rows of a dataset
    without labels get none.
    """
    cleaned = F.when(strip_space(F.col(raw)) != "", clean_answer(F.col(raw)))
    keyed = df.withColumn("_cleaned", cleaned)
    # Rows without an answer meet nothing; they are not to meet in one task either.
    nobody = F.concat(F.lit("-"), F.pmod(F.xxhash64(salt_by), F.lit(1 << 20)).cast("string"))
    keyed = keyed.withColumn("answer", F.when(
        F.col("_cleaned").isNotNull() & F.col("dataset").isNotNull(),
        F.sha2(F.concat_ws("\0", "dataset", "_cleaned"), 256)).otherwise(nobody))
    given = keyed.where("_cleaned is not null and dataset is not null").groupBy("answer").agg(
        F.first("dataset").alias("dataset"), F.first("_cleaned").alias("cleaned"), F.count("*").alias("copies"))
    # A written answer has a number of its own: of its many pieces each takes along eight bytes.
    answers = materialize(given.withColumn("number", F.monotonically_increasing_id()), "answers")
    total = answers.agg(F.sum("copies")).first()[0] or 0
    numbered = answers.select(F.col("number").alias("answer"), "dataset", "cleaned")
    readings = read_answers(numbered, vocabulary, stages, threshold, fuzzy_chars).withColumnRenamed(
        "answer", "number").join(answers.select("number", "answer", "copies"), "number").drop("number")
    out = skew_join(keyed, materialize(readings, "readings"), "answer", "copies", total, salt_by, how="left")
    empty = F.col("_cleaned").isNull()
    return out.withColumn("stage", F.when(empty, "empty").otherwise(F.coalesce("stage", F.lit("none")))).drop(
        "answer", "_cleaned").select(*df.columns, "pred", "stage")
