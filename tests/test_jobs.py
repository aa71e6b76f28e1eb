"""Whole experiment, resume, streaming."""

import hashlib
import os
from functools import partial

import pytest
from plain_rows import rows
from pyspark.sql import functions as F

from kappaloom.operators import resume, rules
from kappaloom.operators.annotate import Backend
from kappaloom.operators.conditions import Grid
from kappaloom.operators.extract import extract_labels
from kappaloom.operators.prompts import distinct_templates
from kappaloom.operators.reports import Layout
from kappaloom.operators.rules import Rule
from kappaloom.plans.experiment import Experiment, run_experiment
from kappaloom.plans.predictors import LexiconPredictor
from kappaloom.plans.queries import DOC_DATASETS, SYSTEMS, documents, templates_of
from kappaloom.session import materialize
from kappaloom.sources import results
from kappaloom.streaming.incremental import (
    annotate_stream, annotate_stream_once, annotation_chain, answer_table, stream_items,
)


class FailsOnLongPrompts(LexiconPredictor):
    def predict(self, prompt, run_idx):
        if len(prompt) % 2:
            raise RuntimeError("down")
        return super().predict(prompt, run_idx)


def setup(factory, **options):
    grid = Grid(("north", "south"), ("common",), ("zero_shot", "few_shot"), ("short", "medium"),
                ("no_context",), n_runs=2)
    options = {"sample_size": 30, "steps": 2, **options}
    return Experiment(
        grid, SYSTEMS, {"common": Backend(factory)},
        layout=Layout(("north", "south"), ("common",)), **options)


def test_interrupted_experiment_ends_like_an_uninterrupted_one(spark, sf_dir, tmp_path):
    items = documents(spark, sf_dir)
    good = lambda: LexiconPredictor(Rule(0, 4))
    whole = run_experiment(items, setup(good), str(tmp_path / "whole"))

    broken = str(tmp_path / "broken")
    first = run_experiment(items, setup(lambda: FailsOnLongPrompts(Rule(0, 4))), broken)
    saved = results.read_predictions(spark, f"{broken}/predictions")
    failed = saved.where(F.col("error").isNotNull()).count()
    assert 0 < failed < saved.count() == 2 * 30 * 4 * 2
    assert rows(first) != rows(whole)

    again = run_experiment(items, setup(good, steps=3), broken)
    assert rows(again) == rows(whole)
    saved = results.read_predictions(spark, f"{broken}/predictions")
    assert saved.count() == 480 + failed  # only the failed requests were repeated
    run_experiment(items, setup(good), broken)
    assert results.read_predictions(spark, f"{broken}/predictions").count() == 480 + failed

    stored = rows(results.read_metrics(spark, f"{broken}/metrics"))
    assert len(stored) == 8
    report = spark.read.option("header", True).csv(f"{broken}/tables/kappa_by_shot")
    assert report.columns == ["dataset", "shot_type", "common"] and report.count() == 6
    assert len([f for f in os.listdir(f"{broken}/tables/consistency") if f.endswith(".csv")]) == 1


def test_no_skip_replaces_earlier_runs(spark, sf_dir, tmp_path):
    items = documents(spark, sf_dir).where("dataset = 'north'")
    out = str(tmp_path / "out")
    options = {"sample_size": 10, "skip_existing": False}
    run_experiment(items, setup(lambda: FailsOnLongPrompts(Rule(0, 4)), **options), out)
    run_experiment(items, setup(lambda: LexiconPredictor(Rule(0, 4)), **options), out)
    saved = results.read_predictions(spark, f"{out}/predictions")
    assert saved.count() == 10 * 4 * 2 and saved.where("error is not null").count() == 0


def test_resume_keys(spark):
    items = spark.createDataFrame([("d", i) for i in range(3)], "dataset string, item_id long")
    runs = spark.createDataFrame([("d", r) for r in range(3)], "dataset string, run_no int")
    saved = spark.createDataFrame(
        [("d", 0, 0, None), ("d", 1, 0, None), ("d", 2, 0, None), ("d", 0, 1, None), ("d", 1, 1, "x"),
         ("d", 2, 1, None)], "dataset string, item_id long, run_no int, error string")
    left = resume.open_runs(items, runs, saved)
    assert rows(resume.open_rows(left)) == [("d", 0, 2), ("d", 1, 1), ("d", 1, 2), ("d", 2, 2)]
    assert rows(resume.unfinished_runs(left)) == [(1,), (2,)]
    kept = resume.open_runs(items, runs, saved, keep_failed=True)
    assert rows(resume.open_rows(kept)) == [("d", 0, 2), ("d", 1, 2), ("d", 2, 2)]
    assert resume.open_runs(items, runs.where("run_no = 0"), saved).count() == 0


class Logged(LexiconPredictor):
    """Writes down every prompt it is asked; dies where a file says so."""

    def __init__(self, rule, folder):
        super().__init__(rule)
        self.folder = folder

    def predict_batch(self, prompts, run_idxs):
        limit = os.path.join(self.folder, "limit")
        log = os.path.join(self.folder, "log")
        if os.path.exists(limit) and os.path.exists(log) and sum(1 for _ in open(log)) > int(open(limit).read()):
            raise SystemExit("down")
        answers = super().predict_batch(prompts, run_idxs)
        with open(log, "a") as f:
            f.writelines(hashlib.md5(f"{p}{r}".encode()).hexdigest() + "\n" for p, r in zip(prompts, run_idxs))
        return answers


def test_kill_and_resume_repeats_no_finished_request(spark, sf_dir, tmp_path):
    items = documents(spark, sf_dir).where("dataset = 'north'").withColumn("text", F.concat(
        F.lit("the "), F.when(F.col("item_id") % 4 == 0, F.lit("der")).otherwise(F.substring("text", 1, 40))))
    folder = tmp_path / "calls"
    folder.mkdir()
    job = lambda: Experiment(
        Grid(("north",), ("common",), ("zero_shot",), ("short", "medium"), n_runs=1), SYSTEMS,
        {"common": Backend.batched(partial(Logged, Rule(0, 4), str(folder)), batch_size=4)}, steps=4)
    out = str(tmp_path / "out")
    (folder / "limit").write_text("90")
    with pytest.raises(Exception):
        run_experiment(items, job(), out)
    log = folder / "log"
    saved = results.read_predictions(spark, f"{out}/predictions").count()
    assert saved > 0
    killed_after = len(log.read_text().split())
    (folder / "limit").unlink()
    run_experiment(items, job(), out)
    calls = log.read_text().split()
    stored = results.read_predictions(spark, f"{out}/predictions")
    # Short prompts do not hold the context: 4 of 6 conditions are different questions.
    texts = stored.select("item_id").join(items, "item_id").select("text").distinct().count()
    assert len(set(calls)) == 4 * texts and stored.count() == 6 * stored.select("item_id").distinct().count()
    # Only the portion that was under way when the service died is asked again.
    assert len(calls) - len(set(calls)) <= killed_after - saved // 6 and len(calls) < 4 * texts + killed_after


def test_readme_example_reports_its_own_names(spark, tmp_path):
    items = spark.createDataFrame(
        [("deli", i, f"the {w} of number {i}", w) for i, w in enumerate(["English", "French"] * 6)],
        "dataset string, item_id long, text string, gold string")
    job = Experiment(Grid(("deli",), ("mine",), n_runs=1), {"deli": ("Deli", "Sells food.", "Sells bread.")},
                     {"mine": Backend.batched(lambda: LexiconPredictor(Rule(0, 4)), batch_size=8)}, steps=2)
    metrics = run_experiment(items, job, str(tmp_path / "out"))
    assert metrics.count() == 27
    from kappaloom.operators.reports import REPORTS
    assert set(os.listdir(tmp_path / "out" / "tables")) == set(REPORTS)
    for name in REPORTS:
        report = spark.read.option("header", True).csv(str(tmp_path / "out" / "tables" / name))
        assert "deli" in str(report.collect()) and "mine" in str([report.columns, report.collect()]), name
    audit = spark.read.json(str(tmp_path / "out" / "alignment")).collect()
    assert [(r["status"], r["items"]) for r in audit] == [("matched", 8)]


def test_stream_equals_batch_and_never_repeats(spark, sf_dir, tmp_path):
    inbox, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    docs = documents(spark, sf_dir)
    templates = templates_of(spark, docs, Grid(DOC_DATASETS, ("common",), ("one_shot",), ("long",), n_runs=2))
    chain = annotation_chain(
        templates, {"common": Backend.batched(lambda: LexiconPredictor(Rule(0, 4)), batch_size=16)},
        {d: rules.LABELS for d in DOC_DATASETS})
    for half in (0, 1):
        docs.where(F.col("item_id") % 2 == half).write.mode("append").parquet(inbox)
        annotate_stream(stream_items(spark, inbox, files_per_batch=2), chain, out, check)
    annotate_stream(stream_items(spark, inbox), chain, out, check)
    assert rows(spark.read.parquet(out)) == rows(chain(docs))


def test_stream_asks_a_text_once_and_repeats_no_batch(spark, sf_dir, tmp_path):
    inbox, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    (tmp_path / "calls").mkdir()
    docs = documents(spark, sf_dir).where("dataset = 'north'").withColumn("text", F.concat(
        F.lit("the "), F.when(F.col("item_id") % 3 == 0, F.lit("der")).otherwise(F.substring("text", 1, 40))))
    templates = materialize(distinct_templates(templates_of(
        spark, docs, Grid(("north",), ("common",), ("zero_shot",), ("short", "medium"), n_runs=1))), "t")
    backends = {"common": Backend.batched(partial(Logged, Rule(0, 4), str(tmp_path / "calls")), batch_size=4)}
    read = lambda rows: extract_labels(rows, rules.LABELS)
    for half in (0, 1):
        docs.where(F.col("item_id") % 2 == half).write.mode("append").parquet(inbox)
        annotate_stream_once(stream_items(spark, inbox), templates, backends, read, out, check)
    annotate_stream_once(stream_items(spark, inbox), templates, backends, read, out, check)
    calls = (tmp_path / "calls" / "log").read_text().split()
    texts, wordings = docs.select("text").distinct().count(), templates.select("template_id").distinct().count()
    assert len(calls) == len(set(calls)) == texts * wordings == answer_table(spark, f"{out}/answers").count()
    got = spark.read.parquet(f"{out}/rows")
    assert got.count() == got.select("item_id", "exp_id").distinct().count() == docs.count() * 6


def test_failed_requests_of_a_stream_are_no_answers(spark, tmp_path):
    from kappaloom.streaming.incremental import remembering

    prompts = spark.createDataFrame([("d:a", "t", 0, "m", "ok"), ("d:b", "t", 0, "m", "bad")],
                                    "text_key string, template_id string, run_idx int, model string, prompt string")
    asked = []

    def ask(fail):
        def answer(p):
            asked.append(sorted(r.prompt for r in p.collect()))
            bad = (F.col("prompt") == "bad") & F.lit(fail)
            return p.select("text_key", "template_id", "run_idx", F.when(~bad, F.upper("prompt")).alias("raw"),
                            F.lit(1).alias("attempts"), F.when(bad, "down").alias("error"))
        return answer

    path = str(tmp_path / "answers")
    first = remembering(ask(True), path, 0)(prompts)
    assert rows(first.select("text_key", "raw")) == [("d:a", "OK"), ("d:b", None)]
    second = remembering(ask(False), path, 1)(prompts)
    assert rows(second.select("text_key", "raw")) == [("d:a", "OK"), ("d:b", "BAD")]
    again = remembering(ask(False), path, 1)(prompts)
    assert rows(again.select("text_key", "raw")) == [("d:a", "OK"), ("d:b", "BAD")]
    assert asked == [["bad", "ok"], ["bad"]]


def test_experiment_with_rounds_and_many_labels(spark, sf_dir, tmp_path, monkeypatch):
    from kappaloom.plans import experiment

    items = documents(spark, sf_dir).where("dataset = 'north'")
    job = lambda **more: Experiment(
        Grid(("north",), ("common",), ("zero_shot",), ("short",), ("no_context",), 1), SYSTEMS,
        {"common": Backend.batched(lambda: LexiconPredictor(Rule(0, 4)))}, steps=1, **more)
    few = run_experiment(items, job(), str(tmp_path / "few"))
    monkeypatch.setattr(experiment, "MAX_BOOK_LABELS", 1)
    monkeypatch.setattr(experiment.few_labels, "__defaults__", (1,))
    many = run_experiment(items, job(retry_in_rounds=True), str(tmp_path / "many"))
    assert rows(many) == rows(few)
    saved = results.read_predictions(spark, str(tmp_path / "many" / "predictions"))
    assert saved.where("seconds is null or attempts <> 1").count() == 0


def test_seconds_of_a_run_add_up(spark, tmp_path):
    preds = spark.createDataFrame(
        [("r", i, "g", "x", "p", 0.5) for i in range(300)] + [("s", 1, "g", None, None, None)],
        "run_id string, item_id long, gold string, raw string, pred string, seconds double")
    results.write_records(results.run_records(preds, record_items=50), str(tmp_path / "r"))
    assert rows(results.run_seconds(spark, str(tmp_path / "r"))) == [("r", 150.0), ("s", None)]
    results.write_records(results.run_records(preds.drop("seconds")), str(tmp_path / "none"))
    assert {r[1] for r in rows(results.run_seconds(spark, str(tmp_path / "none")))} == {None}


def test_scores_follow_from_the_counts_of_the_portions(spark, sf_dir, tmp_path, monkeypatch):
    from kappaloom.operators.scoring import align
    from kappaloom.operators.consistency import condition_summary, metrics_table
    from kappaloom.plans import experiment as e

    items = materialize(documents(spark, sf_dir).where("dataset = 'north'"), "items")
    job = lambda runs=2, steps=3, **more: Experiment(
        Grid(("north",), ("common",), ("zero_shot",), ("short",), ("no_context", "full_context"), runs), SYSTEMS,
        {"common": Backend.batched(lambda: LexiconPredictor(Rule(0, 4)))}, steps=steps, **more)
    used = []
    monkeypatch.setattr(e, "counted_patterns", lambda *a, real=e.counted_patterns: used.append(real(*a)) or used[-1])
    out = str(tmp_path / "out")
    run_experiment(items, job(max_portions=1), out)
    assert used[-1] is None  # two thirds of the items have no answer yet
    metrics = run_experiment(items, job(), out)
    assert used[-1] is not None
    gold = e.test_split(e.clean_items(items), e.stratified_pool(e.clean_items(items), 2, 42)).select("dataset", "item_id", "gold")
    recount = metrics_table(condition_summary(align(gold, e.wanted_answers(spark, job(), out)), e.CONDITION))
    assert rows(metrics.select(*recount.columns)) == rows(recount)
    # More runs are answered apart from the first ones; other labels are other items.
    run_experiment(items, job(runs=3), out)
    assert used[-1] is None
    swapped = items.withColumn("gold", F.when(F.col("item_id") % 2 == 0, "German").otherwise(F.col("gold")))
    assert e.counted_patterns(swapped.select("dataset", "item_id", "gold"), job(), out) is None


def test_tables_with_a_row_per_text_are_not_broadcast(spark):
    """Their files are small, whatever they hold in memory: the planner must not send them through the driver."""
    from kappaloom.operators.joins import skew_join

    facts = spark.createDataFrame([(i, f"k{i % 3}") for i in range(30)], "item_id long, key string")
    answers = spark.createDataFrame([(f"k{i}", 10, "a") for i in range(3)], "key string, copies long, raw string")
    joined = skew_join(facts, answers, "key", "copies", 30, "item_id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and joined.count() == 30
