"""Text scores: word counts of a training part, and a subword lattice likelihood.

What the corpus knows travels by word, once for each portion of texts that holds the word:
a portion's texts are kept as word numbers, its distinct words are counted and scored in one
shuffle by word, and the answers return to the portion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from kappaloom.llm.arrow_text import portions, row_sums, words
from kappaloom.llm.lattice import WordLattices, trie
from kappaloom.session import materialize

PORTION_BYTES = 8 << 20
LATTICE_WORDS = 1 << 14
#: expected piece counts are summed as whole numbers of this share, in any order the same
GRAIN = 1 << 16

PORTION_SCHEMA = (
    "portion long, ids array<long>, held_out array<boolean>, n_words array<int>, "
    "numbers binary, terms array<struct<word:string,n:int>>")
SCORE_SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double")


def _packed(numbers: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(numbers.astype(np.uint32).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint32)


def _portion_rows(docs: DataFrame) -> DataFrame:
    """A row for each portion of ``docs`` (doc_id, held_out, text)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, part in enumerate(portions(batches, limit=PORTION_BYTES)):
            flat, counts = words(part.column("text"), lower=True)
            coded = flat.dictionary_encode()
            numbers = coded.indices.to_numpy()
            taught = np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False), counts)
            n = np.bincount(numbers[taught], minlength=len(coded.dictionary)).astype(np.int32)
            terms = pa.StructArray.from_arrays([coded.dictionary, pa.array(n)], ["word", "n"])

            def row(values, kind=None):
                return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind) if kind else values)

            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() << 32 | k], pa.int64()),
                 row(part.column("doc_id")), row(part.column("held_out")),
                 row(counts.astype(np.int32), pa.int32()),
                 pa.array([_packed(numbers)], pa.binary()), row(terms)],
                ["portion", "ids", "held_out", "n_words", "numbers", "terms"])

    return docs.mapInArrow(encode, PORTION_SCHEMA)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, LATTICE_WORDS):
            yield batch.slice(lo, LATTICE_WORDS)


def train_pieces(counted: DataFrame, texts: int, model_path: str, rounds: int, prior_tokens: float) -> np.ndarray:
    """Log probability of every piece: ``rounds`` of expectation maximisation over the words.

    ``counted`` (word, c) are the training words, ``texts`` the number of training texts, each
    with one end. The sum over the words goes through Spark; what returns is at most one row
    for each piece of the vocabulary. ``prior_tokens`` is the weight of the model's own ranks.
    """
    pieces = trie(model_path)
    p = pieces.prior
    for _ in range(rounds):
        with np.errstate(divide="ignore"):
            log_p = np.log(p)

        def expect(batches: Iterator[pa.RecordBatch], log_p=log_p) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(log_p), np.int64)
            for block in _blocks(batches):
                got = WordLattices(block.column("word"), trie(model_path)).expected(
                    log_p, block.column("c").to_numpy().astype(float))
                total += np.rint(got * GRAIN).astype(np.int64)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "n"])

        sums = counted.where("c > 0").select("word", "c").mapInArrow(
            expect, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        seen = pieces.prior * prior_tokens
        for row in sums:
            seen[row["piece"]] += row["n"] / GRAIN
        seen[pieces.end] += texts
        p = seen / seen.sum()
    with np.errstate(divide="ignore"):
        return np.log(p)


def lm_scores(
    docs: DataFrame, held_out, model_path: str, rounds: int = 2, prior_tokens: float = 1000.0,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    ``held_out`` is a condition on the rows of ``docs``; all others are learned from. Tokens are
    the words in lower case (A-Z) and one end. ``base_score`` adds log10((c + 0.5) / (N + 0.5 *
    (V + 1))) over them, c a token's training count, N all of them, V the distinct ones.
    ``score`` is the log10 probability of the text under a unigram model over the pieces of an
    existing vocabulary, all segmentations summed (see ``lattice``). No piece crosses words, so
    a text's marginal is the product of its words' and the end's.

    A null text is empty: it has the end alone. Repeated rows count as often as they come and
    give repeated results. Without training texts every count is 0 and the pieces have their
    prior. An empty table gives an empty one; other columns are not read.
    """
    picked = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col(text_col).alias("text"))
    rows = materialize(_portion_rows(picked), "portions")
    terms = rows.select("portion", F.posexplode("terms").alias("number", "term")).select(
        "portion", "number", "term.word", "term.n")
    counted = materialize(terms.groupBy("word").agg(F.sum("n").alias("c")), "word_counts")
    in_words = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    texts = rows.select(F.explode("held_out").alias("h")).where("not h").count()
    n, v = in_words[0] + texts, in_words[1] + (texts > 0)
    log_p = train_pieces(counted, texts, model_path, rounds, prior_tokens)
    end_log = float(log_p[trie(model_path).end])

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            marginal = WordLattices(block.column("word"), trie(model_path)).log_marginals(log_p)
            yield pa.RecordBatch.from_arrays(
                [block.column("word"), block.column("c"), pa.array(marginal)], ["word", "c", "marginal"])

    scored = counted.mapInArrow(score_words, "word string, c long, marginal double")
    answers = terms.select("portion", "number", "word").join(scored, "word").select(
        F.col("portion").alias("home"), "number", "c", "marginal")

    def score_texts(key, left: pa.Table, right: pa.Table) -> pa.Table:
        count, marginal = np.zeros(len(right)), np.zeros(len(right))
        number = right["number"].to_numpy()
        count[number], marginal[number] = right["c"].to_numpy(), right["marginal"].to_numpy()
        used = _unpacked(left["numbers"][0].as_py())
        per_text = left["n_words"].chunk(0).flatten().to_numpy().astype(np.int64)
        base = np.log10(count + 0.5)
        total = np.log10(n + 0.5 * (v + 1))
        return pa.table({
            "doc_id": left["ids"].chunk(0).flatten(),
            "held_out": left["held_out"].chunk(0).flatten(),
            "n_tokens": per_text + 1,
            "n_known": row_sums((count > 0).astype(np.int64)[used], per_text) + int(texts > 0),
            "train_tokens": np.full(len(per_text), n, np.int64),
            "base_score": _sums(base[used], per_text) + np.log10(texts + 0.5) - (per_text + 1) * total,
            "score": (_sums(marginal[used], per_text) + end_log) / np.log(10.0),
        })

    return rows.drop("terms").groupBy("portion").cogroup(answers.groupBy("home")).applyInArrow(
        score_texts, SCORE_SCHEMA)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each ragged row by itself, so that its neighbours leave no rounding in it."""
    out = np.zeros(len(counts))
    some = counts > 0
    if some.any():
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])[some]
        out[some] = np.add.reduceat(values, first)
    return out
