"""Prompts as columns: prefix + item text + suffix, with one small template table.

All wording and all examples of a prompt sit in at most 27 template rows per dataset.
Building prompts is one broadcast join on the dataset and one concat per row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kappaloom.fixed_values import DEFAULT_FEW_SHOT, DEFAULT_ONE_SHOT
from kappaloom.functions.text import strip_space
from kappaloom.operators.conditions import prompt_key
from kappaloom.operators.joins import lookup_join
from kappaloom.operators.sampling import round_robin_examples
from kappaloom.session import literal_table, materialize

ITEM_OPEN = "Passage: «"
ITEM_CLOSE = "»\n\n"
SHORT_CUE = ITEM_CLOSE + "Label:"
WORD_CUE = ITEM_CLOSE + "Its label, nothing more:"
SHORT_TASK = "Which label describes the passage?\n\n"
SHORT_TASK_EXAMPLES = "Which label describes the last passage? Others have theirs already:\n"
MEDIUM_TASK = "Passages from {system} go into folders, and a folder is named by its label.\n"
MEDIUM_CONTEXT = "Background: "
MEDIUM_HINT = "Name the folder in the collection's own vocabulary.\n\n"
MEDIUM_EXAMPLES = "Filed so far, folder first:\n"
LONG_OPENING = "# Filing passages from {system}\n\n"
LONG_LABELS = "## Folders\n"
LONG_GUIDELINES = (
    "## Before you file\n"
    "- Read to the end; the last sentence counts as much as the first.\n"
    "- Spelling, tone and length say nothing about the folder.\n"
    "- If no folder fits well, the nearest one is still right; new folders are not opened.\n\n"
)
LONG_CONTEXT = "## Background\n"
LONG_EXAMPLES = "## Filed so far\n"
LONG_TASK = "## To be filed\n"
LONG_STEPS_ZERO = (
    ITEM_CLOSE + "Rule out, in your head, the folders it cannot belong to. "
    "Then copy the name of the one that is left:"
)
LONG_STEPS_EXAMPLES = (
    ITEM_CLOSE + "Rule out, in your head, the folders it cannot belong to. Should several be left, "
    "pick the one whose filed passages it would sit best with. Then copy its name:"
)

SYSTEM_SCHEMA = pa.schema(
    [(n, pa.string()) for n in ("dataset", "system", "some_text", "full_text")]
)


def systems_table(spark: SparkSession, systems: dict[str, tuple[str, str, str]]) -> DataFrame:
    """dataset -> (system name, short context, full context) as a literal table."""
    return literal_table(spark, SYSTEM_SCHEMA, [(d, *v) for d, v in systems.items()])


def require_systems(datasets, systems: dict) -> None:
    missing = sorted(set(datasets) - set(systems))
    if missing:
        raise ValueError(f"no context text for datasets {missing}")


def example_blocks(
    items: DataFrame, pool: DataFrame,
    n_one: int = DEFAULT_ONE_SHOT, n_few: int = DEFAULT_FEW_SHOT,
) -> DataFrame:
    """(dataset, shot_type, compact_block, numbered_block), one row per dataset and shot.

    A block collects at most ``n`` texts. Their ids, at most n_one + n_few for each dataset,
    also go into the scan as a filter, so that row groups and pages without any of them are
    skipped, texts included.
    """
    picked = materialize(
        round_robin_examples(pool, n_one).withColumn("shot_type", F.lit("one_shot"))
        .unionByName(
            round_robin_examples(pool, n_few).withColumn("shot_type", F.lit("few_shot"))
        ),
        "examples",
    )
    texts = items.select("dataset", "item_id", strip_space(F.col("text")).alias("text"))
    ids = [r["item_id"] for r in picked.select("item_id").distinct().collect()]
    texts = texts.where(F.col("item_id").isin(ids))
    rows = lookup_join(texts, picked, ["dataset", "item_id"]).groupBy("dataset", "shot_type").agg(
        F.array_sort(F.collect_list(F.struct("pos", "text", "label"))).alias("ex")
    )
    return rows.select(
        "dataset", "shot_type",
        F.array_join(F.transform("ex", compact_example), "\n").alias("compact_block"),
        F.array_join(F.transform("ex", numbered_example), "\n\n").alias("numbered_block"),
    )


def compact_example(e: Column) -> Column:
    return F.concat(F.lit("["), e.label, F.lit("] "), e.text)


def numbered_example(e: Column) -> Column:
    return F.concat(e.pos.cast("string"), F.lit(") folder "), e.label, F.lit("\n"), e.text)


def label_hint(vocabulary: DataFrame) -> DataFrame:
    """(dataset, label_list): the codebook in one line, labels in code-point order."""
    return vocabulary.groupBy("dataset").agg(
        F.array_join(F.sort_array(F.collect_list("label")), ", ").alias("label_list")
    )


def prompt_templates(
    conditions: DataFrame, systems: DataFrame, vocabulary: DataFrame, blocks: DataFrame
) -> DataFrame:
    """Condition rows plus ``prefix`` and ``suffix``; everything here is a few rows."""
    some, full = F.lit("some_context"), F.lit("full_context")
    level = F.col("context_level")
    context = F.when(level == some, F.col("some_text")).when(level == full, F.col("full_text"))
    zero = F.col("shot_type") == "zero_shot"

    def text(template: str) -> Column:
        head, _, tail = template.partition("{system}")
        return F.concat(F.lit(head), F.col("system"), F.lit(tail)) if tail else F.lit(template)

    def section(before: str, after: str) -> Column:
        return F.coalesce(F.concat(F.lit(before), context, F.lit(after)), F.lit(""))

    compact = F.concat(F.col("compact_block"), F.lit("\n\n"))
    numbered = F.concat(F.col("numbered_block"), F.lit("\n\n"))
    short = F.when(zero, text(SHORT_TASK)).otherwise(
        F.concat(text(SHORT_TASK_EXAMPLES), compact))
    medium = F.concat(
        text(MEDIUM_TASK), section(MEDIUM_CONTEXT, "\n"),
        F.when(zero, text(MEDIUM_HINT)).otherwise(F.concat(text(MEDIUM_EXAMPLES), compact)),
    )
    long = F.concat(
        text(LONG_OPENING), F.lit(LONG_LABELS), F.col("label_list"), F.lit("\n\n"),
        text(LONG_GUIDELINES), section(LONG_CONTEXT, "\n\n"),
        F.when(zero, F.lit("")).otherwise(F.concat(text(LONG_EXAMPLES), numbered)),
        text(LONG_TASK),
    )
    length = F.col("length")
    prefix = F.when(length == "short", short).when(length == "medium", medium).otherwise(long)
    suffix = (
        F.when(length == "short", F.lit(SHORT_CUE))
        .when(length == "medium", F.lit(WORD_CUE))
        .otherwise(F.when(zero, F.lit(LONG_STEPS_ZERO)).otherwise(F.lit(LONG_STEPS_EXAMPLES)))
    )
    return (
        conditions.join(systems, "dataset")
        .join(label_hint(vocabulary), "dataset")
        .join(blocks, ["dataset", "shot_type"], "left")
        .select(*conditions.columns, F.concat(prefix, F.lit(ITEM_OPEN)).alias("prefix"),
                suffix.alias("suffix"))
    )


def build_prompts(items: DataFrame, templates: DataFrame) -> DataFrame:
    """One prompt per item and condition of its dataset (``templates`` written once)."""
    return with_prompt(lookup_join(trimmed(items), templates, ["dataset"]))


def trimmed(items: DataFrame) -> DataFrame:
    """Trim texts once per item, before the grid repeats them."""
    return items.withColumn("text", strip_space(F.col("text")))


def with_prompt(rows: DataFrame) -> DataFrame:
    """Replace prefix and suffix by the finished prompt."""
    return rows.withColumn("prompt", F.concat("prefix", "text", "suffix")).drop("prefix", "suffix")


def prompts_by_condition(items: DataFrame, templates: DataFrame) -> DataFrame:
    """(dataset, item_id, prompts): all prompts of an item as a map keyed shot|length|context.

    A dataset's wording is one row of at most 27 (key, prefix, suffix), filled in beside the
    text: prompts are never moved.
    """
    entry = F.struct(prompt_key().alias("key"), "prefix", "suffix")
    wording = materialize(templates.groupBy("dataset").agg(
        F.sort_array(F.collect_set(entry)).alias("wording")), "wording")
    prompts = F.map_from_entries(F.transform("wording", lambda w: F.struct(
        w["key"].alias("key"), F.concat(w["prefix"], F.col("text"), w["suffix"]).alias("value"))))
    return lookup_join(trimmed(items), wording, ["dataset"]).select(
        "dataset", "item_id", prompts.alias("prompts"))


def distinct_templates(templates: DataFrame) -> DataFrame:
    """Templates with ``template_id``: conditions of equal wording share one id.

    Short prompts ignore the context, so 27 conditions ask only 21 different
    questions. Finding that out costs a look at the template rows, not at the items.
    """
    return templates.withColumn(
        "template_id", F.sha2(F.concat_ws("\x00", "dataset", "model", "prefix", "suffix"), 256)
    )


def text_id(text: Column) -> Column:
    """Identity of a text across items; 256 bits make accidental equality negligible."""
    return F.sha2(strip_space(text), 256)
