"""The whole experiment: split, prompts, annotation, extraction, scores, reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from kappaloom.fixed_values import (
    DEFAULT_FEW_SHOT, DEFAULT_ONE_SHOT, DEFAULT_POOL_PER_LABEL, DEFAULT_SEED,
)
from kappaloom.functions.ids import CONDITION
from kappaloom.operators.annotate import Backend, annotate
from kappaloom.operators.cleaning import clean_items, label_vocabulary
from kappaloom.operators.conditions import Grid, with_runs
from kappaloom.operators.consistency import (
    condition_summary, covers, merge_patterns, metrics_table, rating_patterns, summary_from_patterns,
)
from kappaloom.operators.dedup import annotate_distinct
from kappaloom.operators.extract import extract_labels
from kappaloom.operators.label_tables import extract_with_table
from kappaloom.operators.prompts import (
    distinct_templates, example_blocks, prompt_templates, require_systems, systems_table, text_id,
)
from kappaloom.operators.reports import REPORTS, Layout
from kappaloom.operators.resume import open_runs, run_number
from kappaloom.operators.retry import annotate_in_rounds
from kappaloom.operators.scoring import align, alignment_audit
from kappaloom.operators.sampling import stratified_pool, test_split, uniform_sample
from kappaloom.session import materialize, scratch_path
from kappaloom.sources import manifest
from kappaloom.sources.results import (
    PREDICTION_SCHEMA, append_predictions, compact_predictions, drop_predictions, read_predictions, saved_predictions, write_report_csv,
    write_summaries,
)

DEFAULT_STEPS = 20
#: labels of all datasets up to which they are brought to the driver for the extractor
MAX_BOOK_LABELS = 2_000


@dataclass(frozen=True)
class Experiment:
    """Settings of one experiment.

    ``steps`` cuts the work into that many portions of texts. Each portion is saved under the
    output folder before the next one starts, so an interruption loses at most one of them.
    ``max_portions`` ends the annotation after so many of them; another call goes on. The layout
    of the reports is that of the grid unless another is given. With ``retry_in_rounds`` failed
    requests are asked again by later jobs instead of in their tasks.
    """

    grid: Grid
    systems: dict[str, tuple[str, str, str]]
    backends: dict[str, Backend]
    pool_per_label: int = DEFAULT_POOL_PER_LABEL
    one_shot: int = DEFAULT_ONE_SHOT
    few_shot: int = DEFAULT_FEW_SHOT
    seed: int = DEFAULT_SEED
    sample_size: int | None = None
    skip_existing: bool = True
    retry_failed: bool = True
    concurrency: int | None = None
    steps: int = DEFAULT_STEPS
    max_portions: int | None = None
    layout: Layout | None = None
    retry_in_rounds: bool = False

    def __post_init__(self):
        require_systems(self.grid.datasets, self.systems)
        missing = sorted(set(self.grid.models) - set(self.backends))
        if missing:
            raise ValueError(f"no backend for models {missing}")

    def report_layout(self) -> Layout:
        return self.layout or Layout(datasets=self.grid.datasets, models=self.grid.models)


def codebooks(vocabulary: DataFrame) -> dict[str, list[str]]:
    """Labels per dataset for the extractor: the same lists that stand in every long prompt.

    For a vocabulary of bounded size, see ``few_labels``.
    """
    books: dict[str, list[str]] = {}
    for row in vocabulary.orderBy("dataset", "label_ord").collect():
        books.setdefault(row["dataset"], []).append(row["label"])
    return books


def few_labels(vocabulary: DataFrame, limit: int = MAX_BOOK_LABELS) -> bool:
    """Whether all labels together are few enough to stand in an expression."""
    return vocabulary.limit(limit + 1).count() <= limit


def label_reader(vocabulary: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Extraction with this vocabulary: in expressions for few labels, by joins for more; the same answers."""
    if few_labels(vocabulary):
        books = codebooks(vocabulary)
        return lambda rows: extract_labels(rows, books)
    return lambda rows: extract_with_table(materialize(rows, "answered"), vocabulary)


def run_experiment(items: DataFrame, setup: Experiment, out: str) -> DataFrame:
    """Annotate what is missing under ``out``, then score everything wanted.

    Returns the flat metrics table. Predictions, summaries, the alignment audit and all reports
    are under ``out``.
    """
    spark = items.sparkSession
    grid = setup.grid
    cleaned = clean_items(items.where(F.col("dataset").isin(*grid.datasets)))
    vocabulary = materialize(label_vocabulary(cleaned), "vocabulary")
    pool = materialize(stratified_pool(cleaned, setup.pool_per_label, setup.seed), "pool")
    test = uniform_sample(test_split(cleaned, pool), setup.sample_size, setup.seed)
    blocks = materialize(
        example_blocks(cleaned, pool, setup.one_shot, setup.few_shot), "blocks"
    )
    conditions = with_runs(grid.table(spark), grid.n_runs).withColumn("run_no", run_number(grid.n_runs))
    templates = materialize(
        distinct_templates(prompt_templates(
            conditions, systems_table(spark, setup.systems), vocabulary, blocks)),
        "templates",
    )
    store = f"{out}/predictions"
    if not setup.skip_existing:
        drop_predictions(spark, store, grid)
        manifest.clear(spark, f"{out}/patterns")
    runs = conditions.select("run_no", "run_id", "run_idx", *CONDITION)
    work = write_portions(
        open_runs(test, runs, saved_runs(spark, store, runs), keep_failed=not setup.retry_failed),
        setup.steps)
    read = label_reader(vocabulary)
    named = materialize(conditions.select("cond_id", "run_idx", "run_id", *CONDITION), "runs")
    done = 0
    for step in range(setup.steps):
        if done == setup.max_portions:
            break
        portion = work.where(F.col("portion") == step).drop("portion")
        if portion.isEmpty():
            continue
        answers = annotate_distinct(
            portion, templates,
            lambda prompts: ask(prompts, setup), setup.concurrency)
        rows = answers.join(F.broadcast(named), ["dataset", "cond_id", "run_idx"]).join(
            portion.select("dataset", "item_id", "gold").hint("shuffle_merge"), ["dataset", "item_id"])
        append_predictions(read(rows), store)
        count_portion(spark, store, f"{out}/patterns")
        done += 1
    if done:
        compact_predictions(spark, store)
    return score(test.select("dataset", "item_id", "gold"), setup, out)


def ask(prompts: DataFrame, setup: Experiment) -> DataFrame:
    """Answers to the prompts of a portion, with retries inside the tasks or as rounds of jobs."""
    keys = ["text_key", "template_id", "run_idx"]
    if not setup.retry_in_rounds:
        return annotate(prompts, setup.backends, keys, details=True).drop("transient")
    held = materialize(prompts, "prompts")
    return annotate_in_rounds(held, setup.backends, keys, scratch_path(prompts.sparkSession, "rounds")).drop("model")


def saved_runs(spark: SparkSession, store: str, runs: DataFrame) -> DataFrame:
    """(dataset, item_id, run_no, error) of the stored answers to the wanted runs."""
    saved = saved_predictions(spark, store)
    if saved is None:
        return spark.createDataFrame([], "dataset string, item_id long, run_no int, error string")
    numbers = F.broadcast(runs.select("run_no", "run_idx", *CONDITION))
    # Written once: the store grows while the portions are worked on.
    return materialize(saved.join(numbers, [*CONDITION, "run_idx"]).select(
        "dataset", "item_id", "run_no", "error"), "saved_runs")


def write_portions(items: DataFrame, steps: int) -> DataFrame:
    """The items written once, a folder for each portion; copies of a text share a portion."""
    path = scratch_path(items.sparkSession, "portions")
    dealt = items.withColumn("portion", F.pmod(
        F.xxhash64("dataset", text_id(F.col("text"))), F.lit(steps)).cast("int"))
    dealt.write.partitionBy("portion").parquet(path)
    return items.sparkSession.read.schema(dealt.schema).parquet(path)


PATTERN_SCHEMA = (
    "dataset string, model string, shot_type string, length string, context_level string, gold string, "
    "ratings array<struct<run_idx:int,pred:string>>, n long, mark long")


def count_portion(spark: SparkSession, store: str, path: str) -> None:
    """Add the pattern counts of the newest predictions to the table of counts.

    Only what was just written is read; a portion has few patterns, whatever its number of items.
    """
    newest = manifest.read_last(spark, store, PREDICTION_SCHEMA)
    manifest.append(rating_patterns(newest, CONDITION, marked=True), path, [])


def counted_patterns(gold: DataFrame, setup: Experiment, out: str) -> DataFrame | None:
    """The pattern counts of all portions, merged; None where they are not those of the wanted answers.

    They are if every condition of the grid has each wanted item once, with its gold label and all runs,
    and nothing else was saved. Else some item was answered in several goes, or asked again, or another grid or set of items
    left its counts here, and the predictions have to be read.
    """
    spark = gold.sparkSession
    if not manifest.has_manifest(spark, f"{out}/patterns"):
        return None
    merged = materialize(merge_patterns(
        manifest.read(spark, f"{out}/patterns", PATTERN_SCHEMA), CONDITION), "merged_patterns")
    gold = materialize(gold, "gold")
    conditions = setup.grid.table(spark).select(*CONDITION).join(gold.select("dataset").distinct(), "dataset")
    found = merged.select(*CONDITION).distinct()
    same = conditions.join(found, CONDITION, "left_anti").isEmpty() and found.join(
        conditions, CONDITION, "left_anti").isEmpty()
    if not same or not covers(merged, CONDITION, gold, setup.grid.n_runs):
        return None
    answers = merged.agg(F.sum(F.col("n") * F.size("ratings"))).first()[0] or 0
    # The rows of the table are counted from its files' footers.
    return merged if answers == read_predictions(spark, f"{out}/predictions").count() else None


def usable_answers(saved: DataFrame) -> DataFrame:
    """One answer per run and item: a failed one only where no later attempt succeeded.

    Partitioned by item, which the pattern count that follows can use as it is.
    """
    columns = [*CONDITION, "run_idx", "item_id", "pred", "error"]
    return (
        saved.select(*columns).repartition("dataset", "item_id")
        .groupBy("dataset", "item_id", *[c for c in CONDITION if c != "dataset"], "run_idx")
        .agg(F.min_by("pred", F.col("error").isNotNull()).alias("pred"))
    )


def wanted_answers(spark: SparkSession, setup: Experiment, out: str) -> DataFrame:
    """One usable answer per wanted run and item, from the stored predictions."""
    saved = read_predictions(spark, f"{out}/predictions")
    for axis, values in (
        ("dataset", setup.grid.datasets), ("model", setup.grid.models),
        ("shot_type", setup.grid.shot_types), ("length", setup.grid.lengths),
        ("context_level", setup.grid.context_levels),
    ):
        saved = saved.where(F.col(axis).isin(*values))
    saved = saved.where(F.col("run_idx") < setup.grid.n_runs)
    return materialize(usable_answers(saved.drop("gold")), "usable_answers")


def score(gold: DataFrame, setup: Experiment, out: str) -> DataFrame:
    """Summaries, flat metrics and report files.

    From the pattern counts that each portion left, where they cover the wanted answers: then of the
    predictions only item ids are read again. Else from the stored predictions.
    """
    spark = gold.sparkSession
    patterns = counted_patterns(gold, setup, out)
    if patterns is not None:
        answered = read_predictions(spark, f"{out}/predictions").select("dataset", "item_id").distinct()
        summary = materialize(summary_from_patterns(patterns, CONDITION), "summary")
    else:
        answers = wanted_answers(spark, setup, out)
        answered = answers.select("dataset", "item_id")
        summary = materialize(condition_summary(align(gold, answers.hint("shuffle_merge")), CONDITION), "summary")
    alignment_audit(gold, answered).coalesce(1).write.mode("overwrite").json(f"{out}/alignment")
    write_summaries(summary, f"{out}/metrics")
    # One row for each condition: a report is one small task, without any exchange.
    metrics = metrics_table(summary).coalesce(1)
    layout = setup.report_layout().covering(metrics)
    for name, report in REPORTS.items():
        write_report_csv(report(metrics, layout), f"{out}/tables/{name}")
    return metrics
