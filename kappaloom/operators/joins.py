"""Joins that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
MAX_HOT_KEYS = 1000


def table_bytes(table: DataFrame) -> int:
    """Size of a small written table as text, an upper bound for its row size."""
    row = F.octet_length(F.to_json(F.struct("*"))) + 64
    return table.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0))).first()[0]


def lookup_join(
    facts: DataFrame, table: DataFrame, on: list[str], how: str = "inner",
    salt_by: str = "item_id", limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join many rows to a few-row table on keys that may each be hot.

    The table (written once, see ``materialize``) is measured. Below ``limit`` bytes
    it is broadcast and the facts stay in place. Beyond it each of its rows is
    repeated per salt and the facts are spread over the salts, so that no key is
    larger than a 64th of itself.
    """
    if table_bytes(table) <= limit:
        return facts.join(F.broadcast(table), on, how)
    salts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        facts.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
        .join(salted, [*on, "_salt"], how)
        .drop("_salt")
    )


def skew_join(
    facts: DataFrame, answers: DataFrame, key: str, copies: str, total: int, salt_by: str,
    how: str = "inner", sizes: DataFrame | None = None,
) -> DataFrame:
    """Join facts to one answer per ``key`` where some keys own a large share of the facts.

    ``answers[copies]`` says how many of the ``total`` facts a key has. Fewer than
    ``MAX_HOT_KEYS`` keys can own more than a 1/MAX_HOT_KEYS share, so the list of hot
    keys is bounded whatever the data, and broadcasting it is safe. Hot keys are
    split over one salt per share; all other keys use salt 0. The answers are never sent to all
    tasks through the driver: a table of repeated answers is many times larger in memory than
    its files are, which is what the planner goes by. With ``sizes``, a row of ``key`` and ``copies`` for each key,
    the answers need no ``copies`` and a key may have several rows of them.
    """
    share = max(total // MAX_HOT_KEYS, 1)
    salts = F.when(F.col(copies) > share, F.ceil(F.col(copies) / F.lit(share)).cast("int"))
    hot = (answers if sizes is None else sizes).select(key, salts.alias("_salts")).where(F.col("_salts").isNotNull())
    if sizes is not None:
        answers, salts = answers.join(F.broadcast(hot), key, "left"), F.col("_salts")
    salted_answers = (
        answers.withColumn("_salt", F.explode(
            F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1)))
        .drop(copies if sizes is None else "_salts")
    )
    salted_facts = facts.join(F.broadcast(hot), key, "left").withColumn(
        "_salt",
        F.coalesce(F.pmod(F.xxhash64(salt_by), F.col("_salts")).cast("int"), F.lit(0)),
    ).drop("_salts")
    return salted_facts.join(salted_answers.hint("shuffle_merge"), [key, "_salt"], how).drop("_salt")
