"""Grid, ids, templates, prompts."""

import pytest
from plain_rows import rows
from pyspark.sql import functions as F

from kappaloom.functions.ids import parse_experiment_ids
from kappaloom.operators.conditions import Grid, with_runs
from kappaloom.operators.prompts import (
    build_prompts, distinct_templates, example_blocks, prompt_templates, prompts_by_condition,
    require_systems, systems_table,
)
from kappaloom.operators.cleaning import label_vocabulary
from kappaloom.session import materialize

SYSTEMS = {"d": ("Deli", "Sells food.", "Sells bread\nand cheese.")}


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [("d", 1, " red apple ", "Fruit"), ("d", 2, "rye loaf", "Bread"), ("d", 3, "pear", "Fruit"),
         ("d", 4, "what is\nbrie?", "Cheese")],
        "dataset string, item_id long, text string, gold string")


def make_prompts(spark, items, n_one, n_few):
    pool = spark.createDataFrame(
        [("d", 2, "Bread", 1), ("d", 4, "Cheese", 1), ("d", 1, "Fruit", 1), ("d", 3, "Fruit", 2)],
        "dataset string, item_id long, label string, rank_in_label int")
    blocks = example_blocks(items, pool, n_one, n_few)
    templates = materialize(prompt_templates(
        Grid(("d",), ("m",)).table(spark), systems_table(spark, SYSTEMS),
        label_vocabulary(items), blocks), "templates")
    return templates, build_prompts(items, templates)


def test_27_conditions_21_prompts(spark, items):
    templates, prompts = make_prompts(spark, items, 1, 3)
    assert prompts.count() == 4 * 27
    per_item = prompts.groupBy("item_id").agg(F.countDistinct("prompt")).collect()
    assert {r[1] for r in per_item} == {21}
    assert distinct_templates(templates).select("template_id").distinct().count() == 21
    shared, _ = make_prompts(spark, items, 3, 3)
    assert distinct_templates(shared).select("template_id").distinct().count() == 14


def test_prompt_structure(spark, items):
    templates, prompts = make_prompts(spark, items, 1, 3)
    by_key = {r["item_id"]: r["prompts"] for r in prompts_by_condition(items, templates).collect()}
    assert {(i, k): p for i, m in by_key.items() for k, p in m.items()} == {
        (r["item_id"], "|".join((r["shot_type"], r["length"], r["context_level"]))): r["prompt"]
        for r in prompts.collect()}
    one = by_key[1]
    assert len(one) == 27
    assert all("Passage: «red apple»" in p for p in one.values())
    assert "rye loaf" not in one["zero_shot|long|full_context"]
    assert "[Bread] rye loaf\n\nPassage:" in one["one_shot|short|no_context"]
    few = one["few_shot|long|full_context"]
    assert "## Folders\nBread, Cheese, Fruit\n" in few
    assert "2) folder Cheese\nwhat is\nbrie?\n\n3) folder" in few
    assert "Sells bread\nand cheese." in few and "filed passages" in few
    assert "filed passages" not in one["zero_shot|long|full_context"]
    assert "Sells food." in one["zero_shot|medium|some_context"]
    assert "Background" not in one["zero_shot|medium|no_context"]
    assert one["few_shot|short|no_context"] == one["few_shot|short|full_context"]
    assert "{system}" not in "".join(one.values())


def test_all_prompts_of_an_item_move_no_prompt(spark, items):
    templates, _ = make_prompts(spark, items, 1, 3)
    text = prompts_by_condition(items, templates)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in text and "Aggregate" not in text


def test_unknown_values_are_errors():
    with pytest.raises(ValueError):
        Grid(("d",), ("m",), shot_types=("two_shot",))
    with pytest.raises(ValueError):
        Grid(("d",), ("m",), lengths=("tiny",))
    with pytest.raises(ValueError):
        Grid(("d",), ("m",), context_levels=("half",))
    with pytest.raises(ValueError):
        require_systems(["d", "e"], SYSTEMS)


def test_restrict_and_ids(spark):
    grid = Grid(("a", "b"), ("m", "n"), n_runs=5).restrict(
        models=["n"], lengths=["long", "short"], shot_types=["one_shot"], n_runs=2)
    table = with_runs(grid.table(spark), grid.n_runs)
    assert table.count() == 2 * 1 * 1 * 2 * 3 * 2
    ids = {r["run_id"] for r in table.collect()}
    assert "b__n__one_shot__long__no_context__run1" in ids
    parsed = parse_experiment_ids(table.select("exp_id").distinct())
    assert rows(parsed.select("dataset", "length").distinct()) == [
        ("a", "long"), ("a", "short"), ("b", "long"), ("b", "short")]
    odd = spark.createDataFrame([("a__b__c__d",), ("a__b__c__d__e__f",), ("x",)], "exp_id string")
    assert rows(parse_experiment_ids(odd)) == [("a__b__c__d__e__f", "a", "b", "c", "d", "e")]
