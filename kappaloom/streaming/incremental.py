"""Incremental annotation: new item files are annotated once and appended."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kappaloom.operators.annotate import Backend, Wording, annotate
from kappaloom.operators.dedup import annotate_distinct
from kappaloom.operators.extract import extract_labels
from kappaloom.operators.prompts import build_prompts
from kappaloom.session import literal_table, materialize, path_exists

ITEM_SCHEMA = "dataset string, item_id long, text string, gold string"
FILES_PER_BATCH = 1000


def stream_items(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Items as files arrive; a batch takes so many files at most, the rest follow in the next."""
    return spark.readStream.schema(ITEM_SCHEMA).option(
        "maxFilesPerTrigger", files_per_batch).parquet(path)


def annotate_stream(
    items: DataFrame, label: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> None:
    """Label all files that arrived since the last call and append the results.

    ``label`` maps items to result rows without shuffles or state. The checkpoint
    (shared storage) names the files already done and the sink's log makes each batch
    visible exactly once, so a restart continues where the last run ended.
    """
    query = (
        label(items).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def annotation_chain(
    templates: DataFrame, backends: dict[str, Backend], books: Mapping[str, Sequence[str]],
    keys: Sequence[str] = ("dataset", "item_id", "gold", "exp_id", "run_idx"),
) -> Callable[[DataFrame], DataFrame]:
    """Prompts, predictor and extraction as one ``label`` for ``annotate_stream``.

    ``templates`` is a written table, see ``prompt_templates``. The chain joins small tables by
    broadcast and has no shuffle, so it is the same for a batch and for a stream.
    """

    def label(items: DataFrame) -> DataFrame:
        answered = annotate(build_prompts(items, templates), backends, list(keys))
        return extract_labels(answered, books).select(*keys, "raw", "attempts", "error", "pred", "stage")

    return label


REQUEST = ["text_key", "template_id", "run_idx"]
ANSWER = ["template_id", "run_idx", "raw", "attempts", "error"]
QUESTION_PLACES = pa.schema([("template_id", pa.string()), ("run_idx", pa.int32()), ("place", pa.int32())])


def answer_table(spark: SparkSession, path: str) -> DataFrame | None:
    """(batch, text_key, template_id, run_idx, raw, attempts, error): all answers of a stream so far."""
    saved = saved_answers(spark, path)
    return None if saved is None else saved.select("batch", "text_key", F.inline("answers"))


def saved_answers(spark: SparkSession, path: str) -> DataFrame | None:
    """(text_key, answers, batch): what was asked about a text in a batch, as one row or several."""
    return spark.read.parquet(path) if path_exists(spark, path) else None


@dataclass(frozen=True)
class Remembering:
    """``ask`` for ``annotate_distinct`` that puts only such prompts as no earlier batch has an answer to.

    The answers of a batch are a folder of the table under ``path``. A batch that runs again
    after a failure finds its folder whole, or writes it anew: it never sees its own answers as old ones.
    Failed requests are no answers. Of the table only the keys of the batch's texts are
    looked up. With a wording, ``unanswered`` tells from the keys alone what is known, and no text is moved for
    it; prompts without are joined with what is known.
    """

    ask: Callable[..., DataFrame]
    path: str
    batch: int

    @property
    def folder(self) -> str:
        return f"{self.path}/batch={self.batch}"

    def known(self, texts: DataFrame) -> DataFrame | None:
        """(text_key, template_id, run_idx) with an answer from another batch, for these texts."""
        saved = saved_answers(texts.sparkSession, self.path)
        if saved is None:
            return None
        return saved.where(F.col("batch") != self.batch).join(texts.select("text_key"), "text_key", "left_semi").select(
            "text_key", F.inline("answers")).where("error is null").select(*REQUEST)

    def unanswered(self, texts: DataFrame, wording: Wording) -> DataFrame:
        """The texts with ``answered``, the places of questions in the wording that have an answer."""
        known = self.known(texts)
        if known is None:
            return texts
        places = literal_table(texts.sparkSession, QUESTION_PLACES, [
            (r["template_id"], r["run_idx"], at) for at, r in enumerate(wording.rows)])
        answered = known.join(F.broadcast(places), ["template_id", "run_idx"]).groupBy("text_key").agg(
            F.collect_set("place").alias("answered"))
        return texts.join(answered, "text_key", "left")

    def __call__(self, prompts: DataFrame, wording: Wording | None = None) -> DataFrame:
        spark = prompts.sparkSession
        texts = materialize(prompts.select("text_key").distinct(), "batch_texts")
        if not path_exists(spark, f"{self.folder}/_SUCCESS"):
            if wording is not None:
                answers = self.ask(prompts, wording).where(F.size("answers") > 0)
            else:
                known = self.known(texts)
                new = prompts if known is None else prompts.join(
                    materialize(known, "known_answers"), REQUEST, "left_anti")
                answers = self.ask(new).select("text_key", F.array(F.struct(*ANSWER)).alias("answers"))
            answers.write.mode("overwrite").parquet(self.folder)
        usable = F.filter("answers", lambda a: a["error"].isNull() | (F.col("batch") == self.batch))
        saved = saved_answers(spark, self.path).where(F.col("batch") <= self.batch).select(
            "text_key", usable.alias("answers")).join(texts, "text_key", "left_semi")
        return saved if wording is not None else saved.select("text_key", F.inline("answers"))


remembering = Remembering


def annotate_stream_once(
    items: DataFrame, templates: DataFrame, backends: dict[str, Backend],
    read: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
) -> None:
    """Label all files that arrived since the last call; a text seen before is not asked again.

    ``templates`` is a written table with ``template_id``, see ``distinct_templates``; ``read`` turns
    answered rows (dataset, item_id, gold, cond_id, exp_id, run_idx, raw, attempts, error) into result rows.
    Every distinct text and wording is asked once in the life of the stream: answers lie
    under ``out``/answers, the rows of each batch under ``out``/rows. Both are written by batch number, so
    a batch that Spark repeats after a failure leaves each row once. ``out`` belongs to one ``checkpoint``.
    """
    names = materialize(templates.select("dataset", "cond_id", "run_idx", "exp_id").distinct(), "stream_conditions")

    def process(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = f"{out}/rows/batch={number}"
        if path_exists(spark, f"{folder}/_SUCCESS"):
            return
        ask = remembering(
            lambda texts, wording=None: annotate(texts, backends, REQUEST, wording=wording), f"{out}/answers", number)
        held = materialize(batch, "stream_batch")
        answers = annotate_distinct(
            held, templates, ask, by_text=True, carry=held.select("dataset", "item_id", "gold"),
            unanswered=ask.unanswered)
        rows = answers.join(F.broadcast(names), ["dataset", "cond_id", "run_idx"])
        read(rows).write.mode("overwrite").parquet(folder)

    query = (
        items.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())
    query.awaitTermination()
