"""The corpus pipeline: stages that each write Parquet for the next one.

Each stage takes (spark, docs, sf_dir) with the columns of ``documents`` and works on all that
its predecessor kept. All but the last return these columns; the last adds what the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kappaloom.llm import language_id
from kappaloom.llm.decontaminate import benchmark_blocks, without_leaks
from kappaloom.llm.mixing import mix_sources
from kappaloom.llm.near_copies import one_of_each_near_group
from kappaloom.llm.secret_scan import redact
from kappaloom.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: no letter, or no dictionary ahead of the others.

    So null, empty and letterless texts go. Rows without id are taught from as fold 0; a null lang
    teaches nothing. Repeated rows share one decision; an empty table, or one without a lang to learn,
    gives an empty one. All columns are kept.
    """
    model = language_id.train(docs.where(language_id.fold() != 0))
    return language_id.keep_identified(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word Jaccard is 0.8 or more stays: the smallest id.

    SimHash fingerprints that link within four bits name pairs, MinHash bands those that differ in more bits;
    the whole shingle sets decide.
    Texts without words, null or empty, are one group. A group without any id keeps one row for each of its
    texts; of repeated rows one stays. An empty table gives an empty one. All columns are kept.
    """
    return one_of_each_near_group(docs, width=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    A null or empty text holds none and stays; repeated rows share one decision; an empty table gives
    an empty one, an empty benchmark leaves everything. All columns are kept.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without_leaks(docs, benchmark_blocks(items, width=5, radius=24, threshold=0.8))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text give way to a mark, n_chars follows.

    A null or empty text stays as it is, repeated rows share one result, an empty table gives an empty
    one. All columns are kept.
    """
    return redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes at least once, with size, source_size, target, taken, copies.

    Columns of ``docs`` with one of these five names are replaced, all others are kept whatever
    their names. A null text has size 0 and is taken where its source is taken whole; a null source is
    a source; repeated rows share one decision; an empty table gives an empty one.
    """
    made = ["size", "source_size", "target", "taken", "copies"]
    sign = F.xxhash64("text").alias("_sign")
    taken = mix_sources(docs.select("doc_id", "text", "source", sign), weights=(5, 2, 1), cap=3, keep=("_sign",))
    taken = taken.where("copies > 0").dropDuplicates(["doc_id", "_sign"]).select(
        F.struct(*made).alias("_made"), F.col("doc_id").alias("_id"), F.col("_sign").alias("_own"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_key"), sign)
    met = rows.join(taken, F.col("_key").eqNullSafe(F.col("_id")) & F.col("_sign").eqNullSafe(F.col("_own")))
    kept = [c for c in docs.columns if c not in made]
    return met.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], "_made.*")


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix),
]

#: SQL can express neither compression sizes nor the fingerprints' hash; tests/llm checks the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
