"""Predictors, retries, deduplication, joins under skew."""

import pytest
from plain_rows import rows
from pyspark.sql import functions as F

from kappaloom.fixed_values import INSTRUCTION_FORMATS
from kappaloom.functions.text import ECHO_END, model_answer
from kappaloom.operators import joins
from kappaloom.operators.annotate import Backend, TransientError, annotate, call_with_retry
from kappaloom.operators.dedup import annotate_distinct
from kappaloom.operators.prompts import distinct_templates
from kappaloom.session import materialize


class Echo:
    def predict(self, prompt, run_idx):
        return f" {prompt}/{run_idx} "


class PickyBatch:
    def predict_batch(self, prompts, run_idxs):
        if any("bad" in p for p in prompts):
            raise RuntimeError("broken batch")
        return [p.upper() for p in prompts]


def prompts_of(spark, texts, model="m"):
    data = [(model, 0, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "model string, run_idx int, item_id long, prompt string")


def test_retry_policy():
    waits = []

    def flaky(failures, exc):
        left = [failures]

        def call():
            if left[0]:
                left[0] -= 1
                raise exc
            return "ok"
        return call

    backend = Backend(Echo, max_attempts=4, backoff_base=3.0, sleep=waits.append)
    assert call_with_retry(flaky(2, TransientError("busy")), backend) == ("ok", 3, None)
    assert waits == [1.0, 3.0]
    assert call_with_retry(flaky(9, TransientError("busy")), backend) == (
        None, 4, "TransientError: busy")
    assert call_with_retry(flaky(1, KeyError("no")), backend) == (None, 1, "KeyError: 'no'")


def test_routing_and_wrappers(spark):
    both = prompts_of(spark, ["a", "b"], "one").union(prompts_of(spark, ["c"], "two"))
    backends = {"one": Backend(Echo), "two": Backend(Echo, wrapper=INSTRUCTION_FORMATS["mistral"],
                                                      echo_end=ECHO_END)}
    got = rows(annotate(both, backends, ["model", "item_id"]))
    assert got == [("one", 0, "a/0", 1, None), ("one", 1, "b/0", 1, None),
                   ("two", 0, "/0", 1, None)]
    with pytest.raises(ValueError):
        annotate(both, {}, ["item_id"])


def test_failed_batch_yields_nulls_for_the_batch_only(spark):
    df = prompts_of(spark, ["a", "b", "bad", "c", "d", "e"]).coalesce(1)
    got = rows(annotate(df, {"m": Backend.batched(PickyBatch, 2)}, ["item_id"]).select(
        "item_id", "raw", F.col("error").isNotNull()))
    assert got == [(0, "A", False), (1, "B", False), (2, None, True), (3, None, True),
                   (4, "D", False), (5, "E", False)]


def test_model_answer(spark):
    df = spark.createDataFrame([("x [/INST] a [/INST] b\n",), ("  ",), (None,), ("plain",)],
                               "raw string")
    assert [r[0] for r in df.select(model_answer(F.col("raw"), ECHO_END)).collect()] == [
        "b", None, None, "plain"]


def test_skew_join_equals_join(spark):
    facts = spark.range(20_000).select(
        F.col("id").alias("item_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5000))
        .alias("key"))
    answers = materialize(facts.groupBy("key").agg(F.count("*").alias("copies")).withColumn(
        "answer", F.concat(F.lit("a_"), "key")), "answers")
    got = joins.skew_join(facts, answers, "key", "copies", 20_000, "item_id")
    want = facts.join(answers.drop("copies"), "key")
    assert got.columns == want.columns and rows(got) == rows(want)
    # No task of the salted join gets the hot third as a whole.
    salted = answers.withColumn("share", F.col("copies") / 20_000).agg(F.max("share")).first()[0]
    assert salted > 0.3


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_beyond_the_broadcast_limit(spark, how):
    facts = spark.range(500).select(
        F.col("id").alias("item_id"), F.when(F.col("id") < 400, "a").otherwise("z").alias("key"))
    table = materialize(
        spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "key string, v string"), "t")
    small = rows(joins.lookup_join(facts, table, ["key"], how))
    large = joins.lookup_join(facts, table, ["key"], how, limit=0)
    assert rows(large.select("key", "item_id", "v")) == small
    assert len(small) == (800 if how == "inner" else 900)


def test_each_distinct_prompt_is_asked_once(spark):
    items = spark.createDataFrame(
        [("d", i, "same text" if i % 3 else f"text {i}") for i in range(60)],
        "dataset string, item_id long, text string")
    templates = distinct_templates(spark.createDataFrame(
        [("d", "m", 0, 0, "P:", ":S"), ("d", "m", 1, 0, "P:", ":S"), ("d", "m", 2, 0, "Q:", ":S")],
        "dataset string, model string, cond_id int, run_idx int, prefix string, suffix string"))
    asked = []

    def ask(prompts):
        kept = materialize(prompts, "asked")
        asked.extend(r["prompt"] for r in kept.collect())
        return annotate(kept, {"m": Backend(Echo)}, ["text_key", "template_id", "run_idx"])

    got = annotate_distinct(items, templates, ask)
    assert len(asked) == len(set(asked)) == 2 * 21
    want = sorted((i, c, f"{'Q' if c == 2 else 'P'}:{t}:S/0")
                  for _, i, t in map(tuple, items.collect()) for c in range(3))
    assert rows(got.select("item_id", "cond_id", "raw")) == sorted(
        want, key=lambda r: tuple(map(repr, r)))


def test_two_models_read_the_prompts_once_and_nothing_is_shuffled(spark, tmp_path):
    prompts_of(spark, ["a", "b"]).write.parquet(str(tmp_path / "p"))
    prompts = spark.read.parquet(str(tmp_path / "p"))
    plan = annotate(prompts, {m: Backend(Echo) for m in ("m", "n")}, ["item_id"])._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert text.count("FileScan") == 1 and "Exchange" not in text


def test_answers_are_saved_before_they_are_grouped(spark, monkeypatch):
    from kappaloom.operators import dedup

    steps = []
    plain = dedup.materialize

    def watched(df, name):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        steps.append((name, "MapInPandas" in text, "Aggregate" in text.split("MapInPandas")[0]))
        return plain(df, name)

    monkeypatch.setattr(dedup, "materialize", watched)
    items = spark.createDataFrame([("d", i, f"t{i % 3}") for i in range(9)], "dataset string, item_id long, text string")
    templates = distinct_templates(spark.createDataFrame(
        [("d", "m", 0, 0, "P:", ":S")],
        "dataset string, model string, cond_id int, run_idx int, prefix string, suffix string"))
    got = annotate_distinct(items, templates, lambda p: annotate(
        p, {"m": Backend(Echo)}, ["text_key", "template_id", "run_idx"]), concurrency=2)
    assert got.count() == 9
    assert [s for s in steps if s[1]] == [("asked", True, False)]
