"""Retries as rounds: what failed is asked again by a later job, not by a sleeping task."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from kappaloom.operators.annotate import Backend, annotate
from kappaloom.session import path_exists


def annotate_in_rounds(
    prompts: DataFrame, backends: dict[str, Backend], keys: list[str], path: str,
    wait: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """``keys``, ``model``, ``raw``, ``attempts``, ``error`` and ``seconds`` of every prompt.

    Each round is one job, whose answers are a table of their own under ``path`` before the next
    round begins: attempt 1 asks everything, attempt n + 1 what failed for a passing reason in
    attempt n, until a backend's ``max_attempts`` is reached. Between two jobs the driver waits
    ``backoff_base`` ** (n - 1) seconds; no task sleeps and no core is held meanwhile. Attempts add up
    over the rounds, and so do the seconds.

    A call with a ``path`` that has rounds goes on behind the last whole one: what was answered is
    not asked again. ``keys`` and ``model`` name a request and hold no null; ``prompts`` is read once
    in each round, so it is best a written table.
    """
    spark = prompts.sparkSession
    request = [*keys, *[c for c in ("model",) if c not in keys]]
    most = max(b.max_attempts for b in backends.values())
    limit = F.lit(0)
    for name, backend in backends.items():
        limit = F.when(F.col("model") == name, backend.max_attempts).otherwise(limit)
    asked, rounds = prompts.where(F.col("model").isin(*backends)), []
    for attempt in range(1, most + 1):
        folder = f"{path}/attempt={attempt}"
        if not path_exists(spark, f"{folder}/_SUCCESS"):
            once = {name: replace(b, max_attempts=1) for name, b in backends.items()}
            answers = annotate(asked, once, request, details=True, attempt=attempt)
            again = F.col("transient") & (limit > attempt)
            answers.withColumn("attempts", F.lit(attempt)).withColumn("again", again).drop("transient").write.mode(
                "overwrite").parquet(folder)
        rounds.append(spark.read.parquet(folder))
        failed = rounds[-1].where("again")
        if failed.isEmpty():
            break
        wait(max(b.backoff_base ** (attempt - 1) for b in backends.values() if b.max_attempts > attempt))
        asked = prompts.join(failed.select(*request), request, "left_semi")
    return last_answers(rounds, request)


def last_answers(rounds: list[DataFrame], request: list[str]) -> DataFrame:
    """The final answer of each request, with the seconds of all its attempts."""
    every = rounds[0]
    for later in rounds[1:]:
        every = every.unionByName(later)
    if len(rounds) == 1:
        return every.drop("again")
    spent = F.sum("seconds").alias("seconds")
    last = F.max_by(F.struct("raw", "attempts", "error"), "attempts").alias("last")
    # Only what was asked more than once has to be brought together.
    repeated = rounds[0].where("again").select(*request)
    once = rounds[0].where("not again").drop("again")
    more = every.join(repeated, request, "left_semi").groupBy(*request).agg(last, spent)
    return once.unionByName(more.select(*request, "last.*", "seconds"))
