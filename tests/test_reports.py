"""Report tables and stored results."""

import json

from plain_rows import rows
from pyspark.sql import functions as F

from kappaloom.operators import reports
from kappaloom.sources import results

NAN = float("nan")
FIELDS = "dataset string, model string, shot_type string, length string, context_level string, " \
         "kappa double, accuracy double, precision double, recall double, f1 double, " \
         "mean_kappa double, std_kappa double, icc double"


def metrics(spark, *lines):
    filled = [(*l[:5], *map(float, l[5:]), *([0.5] * (13 - len(l)))) for l in lines]
    return spark.createDataFrame(filled, FIELDS)


def plain(df):
    return [tuple(r) for r in df.collect()]


def table(spark):
    return metrics(
        spark,
        ("smart", "gpt4", "zero_shot", "long", "full_context", 0.0625, 0.9, 0.1, 0.1, 0.1, 0, 0, NAN),
        ("smart", "gpt4", "zero_shot", "short", "no_context", NAN, 0.1, 0.95, 0.1, 0.1, 0, 0, NAN),
        ("smart", "mistral", "few_shot", "long", "full_context", 0.12345, 0, 0, 0, 0, 0, 0.0125, 0.75),
        ("smart", "other", "few_shot", "long", "full_context", 0.99),
    )


def test_dense_ordered_rounded(spark):
    got = reports.kappa_by_shot(table(spark), reports.PUBLISHED)
    assert got.columns == ["dataset", "shot_type", "LLaMA-2", "Mistral", "GPT-4", "other"]
    assert plain(got) == [
        ("Library Management", "Zero-shot", None, None, None, None),
        ("Library Management", "One-shot", None, None, None, None),
        ("Library Management", "Few-shot", None, None, None, None),
        ("Smart Home", "Zero-shot", None, None, 0.062, None),
        ("Smart Home", "One-shot", None, None, None, None),
        ("Smart Home", "Few-shot", None, 0.123, None, 0.99)]


def test_only_measured_pairs_by_length(spark):
    assert plain(reports.kappa_by_length(table(spark), reports.PUBLISHED)) == [
        ("smart", "gpt4", None, None, 0.062), ("smart", "mistral", None, None, 0.123),
        ("smart", "other", None, None, 0.99)]


def test_context_and_consistency(spark):
    by_context = plain(reports.kappa_by_context(table(spark), reports.PUBLISHED))
    assert by_context[3:] == [
        ("Smart Home", "No Context", None, None, None, None),
        ("Smart Home", "Some Context", None, None, None, None),
        ("Smart Home", "Full Context", None, 0.123, 0.062, 0.99)]
    sd = plain(reports.consistency_report(table(spark), reports.PUBLISHED))
    assert sd[4:] == [("Smart Home", "LLaMA-2", None, None), ("Smart Home", "Mistral", 0.012, 0.75),
                      ("Smart Home", "GPT-4", None, None), ("Smart Home", "other", 0.5, 0.5)]


def test_full_metrics_mix_and_best(spark):
    mixed = {r[:3]: r[3:] for r in plain(reports.full_metrics(table(spark), reports.PUBLISHED))}
    assert len(mixed) == 24
    assert mixed[("Smart Home", "Zero-shot", "GPT-4")] == (0.9, 0.95, 0.1, 0.1)
    best = {r[:3]: r[3:] for r in plain(reports.full_metrics_best_condition(table(spark), reports.PUBLISHED))}
    assert best[("Smart Home", "Zero-shot", "GPT-4")] == (0.9, 0.1, 0.1, 0.1)


def test_best_conditions_break_ties_by_id(spark):
    rows_ = metrics(
        spark, ("smart", "gpt4", "one_shot", "long", "no_context", 0.7),
        ("smart", "gpt4", "few_shot", "short", "no_context", 0.7),
        ("lms", "gpt4", "few_shot", "short", "no_context", NAN))
    assert plain(reports.best_conditions(rows_, reports.PUBLISHED)) == [
        ("Smart Home", "GPT-4", "few_shot", "short", "no_context", 0.7)]
    assert plain(reports.shot_by_length(table(spark), reports.PUBLISHED)) == [
        ("Smart Home", "Mistral", "Few-shot", None, None, 0.123),
        ("Smart Home", "GPT-4", "Zero-shot", None, None, 0.062),
        ("Smart Home", "other", "Few-shot", None, None, 0.99)]
    assert [r[:3] for r in plain(reports.shot_comparison(table(spark), reports.PUBLISHED))] == [
        ("Smart Home", "Mistral", "Few-shot"), ("Smart Home", "GPT-4", "Zero-shot"),
        ("Smart Home", "other", "Few-shot")]


def test_summary_files(spark, tmp_path):
    full = {"exp_id": "smart__gpt4__few_shot__long__full_context", "best_run_idx": 0,
            "best_metrics": {"accuracy": 0.75, "kappa": 0.5}, "consistency": {"icc": NAN}}
    (tmp_path / "a.json").write_text(json.dumps(full, indent=2))
    (tmp_path / "lms__m__s__l__c.json").write_text('{"best_metrics": {"kappa": 0.25}}')
    (tmp_path / "short.json").write_text('{"exp_id": "a__b__c", "best_metrics": {"kappa": 1}}')
    (tmp_path / "cut.json").write_text('{"exp_id": "a__b__c__d__e", "best_')
    (tmp_path / "notes.txt").write_text("x")
    got = rows(results.read_metrics(spark, str(tmp_path), multi_line=True))
    assert got == [
        ("lms", "m", "s", "l", "c", 0.25, *[None] * 7),
        ("smart", "gpt4", "few_shot", "long", "full_context", 0.5, 0.75, *[None] * 6)]


def test_published_record_format(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({
        "run_id": "a__b__c__d__e__run0", "test_labels": ["A", "B", "C"],
        "raw_outputs": ["a", None, "c"], "predictions": ["A", None], "elapsed_seconds": 1.5}, indent=1))
    got = results.read_run_records(spark, str(tmp_path), multi_line=True).orderBy("pos")
    assert [tuple(r) for r in got.select("pos", "item_id", "gold", "raw", "pred").collect()] == [
        (0, 0, "A", "a", "A"), (1, 1, "B", None, None), (2, 2, "C", "c", None)]


def test_long_runs_become_several_records(spark, tmp_path):
    preds = spark.range(1000).select(
        F.lit("r").alias("run_id"), F.col("id").alias("item_id"), F.lit("A").alias("gold"),
        F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("raw"),
        F.lit(None).cast("string").alias("pred"))
    records = results.run_records(preds, record_items=100)
    assert records.count() == 10
    assert records.agg(F.max(F.size("item_ids"))).first()[0] < 160
    assert results.run_records(preds).count() == 1
    path = str(tmp_path / "records")
    results.write_records(records, path)
    back = results.read_run_records(spark, path).select("run_id", "item_id", "gold", "raw", "pred")
    assert rows(back) == rows(preds)


def test_no_measured_row_is_lost(spark):
    rows_ = metrics(spark, ("deli", "mine", "few_shot", "long", "full_context", 0.5),
                    ("smart", "gpt4", "few_shot", "long", "full_context", 0.25))
    for name, report in reports.REPORTS.items():
        for layout in (reports.Layout(), reports.PUBLISHED, reports.Layout(datasets=("smart",))):
            got = report(rows_, layout)
            text = str([got.columns, *map(tuple, got.collect())])
            assert "deli" in text and "mine" in text, name


def test_unreadable_summaries_are_counted(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"exp_id": "a__b__c__d__e", "best_run_idx": 0}\n{"exp_id": "a__b\n')
    assert [(r.file, r.records, r.named) for r in results.unreadable_summaries(spark, str(tmp_path)).collect()] == [("a.json", 1, 0)]
