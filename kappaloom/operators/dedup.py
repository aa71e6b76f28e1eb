"""Ask every distinct prompt once and hand the answer to all items that asked it."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kappaloom.operators.annotate import Wording
from kappaloom.operators.joins import BROADCAST_BYTES, lookup_join, skew_join, table_bytes
from kappaloom.operators.prompts import text_id, trimmed
from kappaloom.session import literal_table, materialize


def distinct_texts(items: DataFrame) -> DataFrame:
    """(dataset, text_key, item_id, copies): the first item of every text.

    Hashes, not texts, are shuffled; counts combine before the shuffle, so a text
    with very many copies costs its group no more than one row per task.
    """
    return items.select("dataset", "item_id", _text_key().alias("text_key")).groupBy(
        "text_key"
    ).agg(
        F.first("dataset").alias("dataset"),
        F.min("item_id").alias("item_id"),
        F.count("*").alias("copies"),
    )


def _text_key():
    return F.concat_ws(":", F.col("dataset"), text_id(F.col("text")))


def annotate_distinct(
    items: DataFrame, templates: DataFrame, ask: Callable[..., DataFrame],
    concurrency: int | None = None, by_text: bool = False, carry: DataFrame | None = None,
    unanswered: Callable[[DataFrame, Wording], DataFrame] | None = None,
) -> DataFrame:
    """(dataset, cond_id, item_id, run_idx, raw, attempts, error) for all items, and seconds if ``ask`` gives them.

    ``templates`` carries ``template_id`` and ``run_idx``; ``ask`` maps prompts with
    (text_key, template_id, run_idx, model, prompt) to answers with the same keys. Answers are
    written as they come, before anything is shuffled: a lost executor asks its own task's
    prompts again and no others. ``concurrency`` deals the distinct texts, not the prompts, to
    that many tasks.

    With ``by_text`` a text is not repeated for each of its prompts: ``ask`` is given texts (text_key, text,
    asks) and the ``Wording`` that ``asks`` points into, and returns (text_key, answers), as ``annotate`` does with a
    wording. ``unanswered`` adds to the keys of the texts, before the texts are looked up, ``answered``: the places
    of questions that are not to be asked, or null. A wording beyond the size for broadcasts is asked prompt by prompt
    all the same.

    Answers meet their items by shuffles, whatever the size of their files: they do not pass through the driver.
    ``carry`` has further columns of the items, by dataset and item_id: they join the items before an item
    becomes a row for each condition, so that those many rows are not shuffled.

    With a column ``open`` of run numbers in the items and ``run_no`` in the templates only
    those requests are made and answered; a text is asked what any of its items needs.
    """
    resumed = "open" in items.columns
    keyed = materialize(trimmed(items).withColumn("text_key", _text_key()), "keyed_items")
    firsts = keyed.groupBy("text_key").agg(
        F.first("dataset").alias("dataset"), F.min("item_id").alias("item_id"),
        F.count("*").alias("copies"))
    firsts = materialize(firsts, "distinct_texts")
    questions = templates.groupBy("dataset", "model", "template_id", "run_idx").agg(
        F.first("prefix").alias("prefix"), F.first("suffix").alias("suffix"),
        *[F.collect_set("run_no").alias("run_nos")] * resumed)
    questions = materialize(questions, "questions")
    wanted = firsts.drop("copies")
    if resumed:
        # Copies mostly need the same, so that there are few different lists for each text.
        needs = keyed.groupBy("text_key", "open").agg(F.count("*").alias("n")).groupBy("text_key").agg(
            F.array_distinct(F.flatten(F.collect_list("open"))).alias("needed"))
        wanted = wanted.join(needs, "text_key")
    by_text = by_text and table_bytes(questions) <= BROADCAST_BYTES
    if by_text:
        # In the order in which a join with the broadcast questions would list them.
        wording = Wording(questions.schema, questions.collect()[::-1])
        if unanswered is not None:
            wanted = unanswered(wanted, wording)
    if len(wanted.columns) > 3:
        # The planner knows the size of a written table, not that of a join.
        wanted = materialize(wanted, "wanted_texts")
    texts = keyed.select("dataset", "item_id", "text").join(wanted, ["dataset", "item_id"])
    if concurrency:
        texts = texts.repartition(concurrency)
    if by_text:
        answers = materialize(ask(with_asks(texts, wording), wording), "asked")
    else:
        prompts = lookup_join(texts, questions, ["dataset"])
        if resumed:
            prompts = prompts.where(F.arrays_overlap("needed", "run_nos"))
        asked = materialize(ask(prompts.select(
            "text_key", "template_id", "run_idx", "model",
            F.concat("prefix", "text", "suffix").alias("prompt"),
        )), "asked")
        answer = F.struct("template_id", "run_idx", "raw", "attempts", "error", *[
            c for c in ("seconds",) if c in asked.columns])
        answers = materialize(
            asked.groupBy("text_key").agg(F.collect_list(answer).alias("answers")), "answers")
    total = firsts.agg(F.sum("copies")).first()[0] or 0
    keys = keyed.select("dataset", "item_id", "text_key", *["open"] * resumed)
    more = []
    if carry is not None:
        more = [c for c in carry.columns if c not in ("dataset", "item_id")]
        keys = keys.join(carry.hint("shuffle_merge"), ["dataset", "item_id"])
    per_item = skew_join(
        keys, answers, "text_key", "copies", total, "item_id", sizes=firsts.select("text_key", "copies"),
    ).select("dataset", "item_id", *more, *["open"] * resumed, F.inline("answers"))
    meant = templates.select("dataset", "cond_id", "template_id", "run_idx", *["run_no"] * resumed)
    out = lookup_join(per_item, materialize(meant, "meant"), ["dataset", "template_id", "run_idx"])
    if resumed:
        out = out.where(F.array_contains("open", F.col("run_no"))).drop("open", "run_no")
    return out


def with_asks(texts: DataFrame, wording: Wording) -> DataFrame:
    """(text_key, text, asks): all questions of a text's dataset, of these only the ``needed`` runs, none ``answered``."""
    resumed = "needed" in texts.columns
    places: dict[str, list[int]] = {}
    for at, row in enumerate(wording.rows):
        places.setdefault(row["dataset"], []).append(at)
    table = literal_table(texts.sparkSession, PLACES_SCHEMA, [
        (dataset, own, [list(wording.rows[at]["run_nos"]) if resumed else [] for at in own])
        for dataset, own in places.items()])
    rows = texts.join(F.broadcast(table), "dataset")
    asks = F.col("asks")
    if resumed:
        asks = F.filter(asks, lambda _, i: F.arrays_overlap(F.col("needed"), F.col("run_nos")[i]))
    if "answered" in texts.columns:
        asks = F.when(F.col("answered").isNull(), asks).otherwise(F.array_except(asks, F.col("answered")))
    return rows.select("text_key", "text", asks.alias("asks"))


PLACES_SCHEMA = pa.schema([
    ("dataset", pa.string()), ("asks", pa.list_(pa.int32())), ("run_nos", pa.list_(pa.list_(pa.int32())))])
