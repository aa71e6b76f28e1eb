"""Annotation of prompts by pluggable predictors, in Arrow batches on the workers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType,
)

from kappaloom.fixed_values import BACKOFF_BASE, BATCH_SIZE, MAX_ATTEMPTS
from kappaloom.functions.text import instruction, model_answer


class TransientError(Exception):
    """Raised by a predictor for a failure worth another attempt.

    Any exception with a true ``transient`` attribute is treated alike.
    """

    transient = True


class Predictor(Protocol):
    """What a backend offers; ``predict_batch`` and ``close`` are optional."""

    def predict(self, prompt: str, run_idx: int) -> str | None: ...


@dataclass(frozen=True)
class Backend:
    """How to build and call one model.

    ``factory`` is picklable and runs once per task, on the worker. ``batch_size``
    above 1 uses ``predict_batch(prompts, run_idxs)`` where the predictor has one; a
    batch that fails for good yields nulls for all its prompts. Up to ``in_flight`` requests
    of a task run at a time, each in a thread of its own; the predictor then has to be thread-safe.
    """

    factory: Callable[[], Predictor]
    batch_size: int = 1
    max_attempts: int = MAX_ATTEMPTS
    backoff_base: float = BACKOFF_BASE
    wrapper: tuple[str, str] = ("", "")
    echo_end: str | None = None
    sleep: Callable[[float], None] = time.sleep
    in_flight: int = 1

    @classmethod
    def batched(cls, factory, batch_size: int = BATCH_SIZE, **options) -> "Backend":
        return cls(factory, batch_size=batch_size, **options)


def outcome(call: Callable, backend: Backend):
    """(result, attempts, error, transient, seconds): transient failures wait base**attempt and try again."""
    begun = time.perf_counter()
    for attempt in range(1, backend.max_attempts + 1):
        try:
            return call(), attempt, None, False, time.perf_counter() - begun
        except Exception as exc:
            error, transient = f"{type(exc).__name__}: {exc}", getattr(exc, "transient", False)
            if not transient or attempt == backend.max_attempts:
                return None, attempt, error, bool(transient), time.perf_counter() - begun
            backend.sleep(backend.backoff_base ** (attempt - 1))
    raise ValueError("max_attempts must be at least 1")


def call_with_retry(call: Callable, backend: Backend):
    """(result, attempts, error) of ``outcome``."""
    return outcome(call, backend)[:3]


def in_order(calls: list[Callable], in_flight: int) -> list:
    """Results of the calls in their order, at most ``in_flight`` running at a time."""
    if in_flight <= 1 or len(calls) <= 1:
        return [call() for call in calls]
    with ThreadPoolExecutor(max_workers=in_flight) as pool:
        return list(pool.map(lambda call: call(), calls))


def answer_batch(predictor, backend: Backend, prompts: Sequence[str], runs: list[int]):
    """(raw, attempts, error, transient, seconds) per prompt, in order.

    The requests of a batch share its seconds evenly. A prompt is looked up when its request begins.
    """
    bulk = getattr(predictor, "predict_batch", None)
    if backend.batch_size <= 1 or bulk is None:
        def one(at: int):
            prompt = prompts[at]
            return outcome(lambda: predictor.predict(prompt, runs[at]), backend)

        return in_order([lambda at=at: one(at) for at in range(len(prompts))], backend.in_flight)

    def ask(part: slice):
        given = prompts[part]
        size = len(given)

        def whole_batch():
            found = list(bulk(given, runs[part]))
            if len(found) != size:
                raise ValueError(f"{len(found)} answers to {size} prompts")
            return found

        found, attempts, error, transient, seconds = outcome(whole_batch, backend)
        return [(a, attempts, error, transient, seconds / size) for a in (found or [None] * size)]

    parts = [slice(at, at + backend.batch_size) for at in range(0, len(prompts), backend.batch_size)]
    answers = in_order([lambda part=part: ask(part) for part in parts], backend.in_flight)
    return [a for part in answers for a in part]


DETAILS = [StructField("transient", BooleanType()), StructField("seconds", DoubleType())]


@dataclass(frozen=True)
class Wording:
    """Few rows with ``model``, ``run_idx``, ``prefix``, ``suffix`` and more keys: the questions, by their place."""

    schema: StructType
    rows: list[Row]


#: prompts that a task hands to the backends at a time where it puts them together itself
PORTION = 10_000


class Filled(Sequence):
    """Prompts put together when they are looked up, so that only those of running requests are held."""

    def __init__(self, texts: list, ends: list[tuple], places: list[tuple[int, int]]):
        self.texts, self.ends, self.places = texts, ends, places

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, at):
        if isinstance(at, slice):
            return [self.filled(*place) for place in self.places[at]]
        return self.filled(*self.places[at])

    def filled(self, text: int, question: int) -> str | None:
        text, (head, tail) = self.texts[text], self.ends[question]
        return None if text is None or head is None or tail is None else f"{head}{text}{tail}"


def told(predictors: dict, backends: dict[str, Backend], name: str, attempt: int) -> Predictor:
    """The task's predictor of a model, built when the model first comes up."""
    if name not in predictors:
        predictors[name] = backends[name].factory()
        if hasattr(predictors[name], "attempt"):
            predictors[name].attempt = attempt
    return predictors[name]


def closed(predictors: dict) -> None:
    for predictor in predictors.values():
        close = getattr(predictor, "close", None)
        if close:
            close()


def shown_answer(model: Column, raw: Column, backends: dict[str, Backend]) -> Column:
    """What a model's raw answer says, without the echo of its instruction."""
    answer = raw
    for name, backend in backends.items():
        answer = F.when(model == name, model_answer(raw, backend.echo_end)).otherwise(answer)
    return answer


def annotate_texts(
    texts: DataFrame, backends: dict[str, Backend], keys: list[str], wording: Wording,
    details: bool = False, attempt: int = 1,
) -> DataFrame:
    """``annotate`` for ``texts`` with ``text`` and ``asks``, the places in ``wording`` of a text's questions.

    A text travels to Python once, whatever is asked about it, and the wording once a task; the worker puts the
    prompts together. A row per text comes back: those ``keys`` that the wording does not have,
    and ``answers``, an array of the other keys with ``raw``, ``attempts`` and ``error``.
    """
    asked = [k for k in keys if k in wording.schema.names]
    kept = [k for k in keys if k not in asked]
    fields = [
        *[wording.schema[k] for k in asked], StructField("_model", StringType()), StructField("raw", StringType()),
        StructField("attempts", IntegerType()), StructField("error", StringType()), *DETAILS * details]
    schema = StructType([
        *[texts.schema[k] for k in kept], StructField("answers", ArrayType(StructType(fields), False))])
    types = {f.name: to_arrow_type(f.dataType) for f in fields}
    models = [r["model"] for r in wording.rows]
    runs = [r["run_idx"] for r in wording.rows]
    ends = [
        tuple(None if end is None else w for end, w in (
            (r["prefix"], f"{backends[m].wrapper[0]}{r['prefix']}"), (r["suffix"], f"{r['suffix']}{backends[m].wrapper[1]}")))
        if m in backends else None for m, r in zip(models, wording.rows)]
    columns = {k: [r[k] for r in wording.rows] for k in asked}
    held = texts.sparkSession.sparkContext.broadcast((models, runs, ends, columns))
    most = max(20 * PORTION // max(len(models), 1), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, runs, ends, columns = held.value
        known = np.array([m in backends for m in models], dtype=bool)
        numbers = {name: np.array([m == name for m in models], dtype=bool) for name in backends}
        fixed = {**{k: pa.array(v, types[k]) for k, v in columns.items()}, "_model": pa.array(models, pa.string())}
        predictors = {}
        try:
            for batch in (b.slice(at, most) for b in batches for at in range(0, len(b), most)):
                asks = batch.column("_asks")
                sizes = pc.fill_null(pc.list_value_length(asks), 0).to_numpy(zero_copy_only=False)
                question = asks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(len(batch)), sizes)
                usable = known[question]
                question, owner = question[usable], owner[usable]
                texts = batch.column("_text").to_pylist()
                found = [None] * len(question)
                for at in range(0, len(question), PORTION):
                    part = question[at:at + PORTION]
                    for name, backend in backends.items():
                        rows = np.flatnonzero(numbers[name][part]) + at
                        if not len(rows):
                            continue
                        places = list(zip(owner[rows].tolist(), question[rows].tolist()))
                        answers = answer_batch(
                            told(predictors, backends, name, attempt), backend, Filled(texts, ends, places),
                            [int(runs[q]) for _, q in places])
                        for row, answer in zip(rows.tolist(), answers):
                            found[row] = answer
                given = dict(zip(("raw", "attempts", "error", "transient", "seconds"), zip(*found) if found else [()] * 5))
                values = {
                    **{k: v.take(pa.array(question)) for k, v in fixed.items()},
                    **{k: pa.array(v, types[k]) for k, v in given.items() if k in types}}
                structs = pa.StructArray.from_arrays([values[f] for f in types], fields=[
                    pa.field(name, kind) for name, kind in types.items()])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(batch)))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), structs)
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], lists], names=[*kept, "answers"])
        finally:
            closed(predictors)

    source = texts.select(*kept, F.col("text").alias("_text"), F.col("asks").cast("array<int>").alias("_asks"))
    return source.mapInArrow(run, schema).withColumn("answers", F.transform("answers", lambda a: F.struct(
        *[a[k].alias(k) for k in asked], shown_answer(a["_model"], a["raw"], backends).alias("raw"),
        *[a[f.name].alias(f.name) for f in fields[len(asked) + 2:]])))


def annotate(
    prompts: DataFrame, backends: dict[str, Backend], keys: list[str], details: bool = False, attempt: int = 1,
    wording: Wording | None = None,
) -> DataFrame:
    """``keys`` plus ``raw``, ``attempts`` and ``error``, each prompt by the backend of its model.

    ``prompts`` needs ``model``, ``prompt`` and ``run_idx``. One pass over the prompts serves
    all models: a task builds a predictor when its model first comes up. Prompts travel to
    Python, not back. The number of tasks times ``in_flight`` of the backend bounds the calls that
    run at a time. With ``details`` come ``transient`` (the failure was worth another attempt) and
    ``seconds``. A predictor with an attribute ``attempt`` is told ``attempt``. With ``wording`` the rows
    are texts, see ``annotate_texts``.
    """
    if not backends:
        raise ValueError("no backend given")
    if wording is not None:
        return annotate_texts(prompts, backends, keys, wording, details, attempt)
    schema = StructType([
        *[prompts.schema[k] for k in keys],
        StructField("_model", StringType()),
        StructField("raw", StringType()),
        StructField("attempts", IntegerType()),
        StructField("error", StringType()),
        *DETAILS * details,
    ])
    model = F.col("model")
    wrapped = F.col("prompt")
    for name, backend in backends.items():
        wrapped = F.when(model == name, instruction(F.col("prompt"), backend.wrapper)).otherwise(wrapped)
    source = prompts.where(model.isin(*backends)).select(
        *keys, model.alias("_model"), F.col("run_idx").alias("_run"), wrapped.alias("_prompt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictors = {}
        try:
            for batch in batches:
                out = batch[[*keys, "_model"]].copy()
                out["raw"] = pd.Series(None, index=out.index, dtype=object)
                out["attempts"] = pd.Series(0, index=out.index, dtype="int32")
                out["error"] = pd.Series(None, index=out.index, dtype=object)
                if details:
                    out["transient"], out["seconds"] = False, 0.0
                for name, rows in batch.groupby("_model", sort=False):
                    answers = answer_batch(
                        told(predictors, backends, name, attempt), backends[name], rows["_prompt"].tolist(),
                        [int(r) for r in rows["_run"]])
                    raw, attempts, error, transient, seconds = zip(*answers)
                    out.loc[rows.index, "raw"] = pd.Series(raw, index=rows.index, dtype=object)
                    out.loc[rows.index, "attempts"] = pd.Series(attempts, index=rows.index, dtype="int32")
                    out.loc[rows.index, "error"] = pd.Series(error, index=rows.index, dtype=object)
                    if details:
                        out.loc[rows.index, "transient"] = pd.Series(transient, index=rows.index, dtype=bool)
                        out.loc[rows.index, "seconds"] = pd.Series(seconds, index=rows.index, dtype=float)
                yield out
        finally:
            closed(predictors)

    answer = shown_answer(F.col("_model"), F.col("raw"), backends)
    return source.mapInPandas(run, schema).withColumn("raw", answer).drop("_model")
