"""Metrics, consistency, rule annotator goldens."""

import pytest
from plain_rows import rows
from pyspark.sql import functions as F

from kappaloom.operators import consistency, rules, scoring
from kappaloom.operators.rules import Rule
from kappaloom.plans.queries import documents

# A published run of 448 items: gold label by row, predicted label by column.
CLASSES = ("Admin MobileApp Sensor SmartDevice SmartHomeSystem SmartLight SmartLock "
           "SmartThermostat User").split()
PUBLISHED = [
    (97, 0, 0, 0, 0, 0, 0, 0, 1), (1, 22, 2, 1, 3, 0, 0, 1, 3), (1, 0, 72, 0, 4, 0, 0, 0, 0),
    (3, 1, 5, 18, 10, 0, 0, 0, 0), (7, 1, 1, 0, 26, 1, 0, 2, 0), (1, 1, 2, 0, 3, 28, 1, 0, 0),
    (2, 1, 3, 0, 3, 0, 18, 1, 3), (1, 0, 4, 0, 0, 0, 0, 24, 0), (1, 6, 1, 0, 5, 0, 0, 1, 55),
]
PUBLISHED_METRICS = {
    "accuracy": 0.8035714285714286, "precision": 0.8216439710042901,
    "recall": 0.7494816809045821, "f1": 0.7679096360813965, "kappa": 0.7708426577694593,
}
PUBLISHED_TOTALS = (98, 33, 77, 37, 38, 36, 31, 29, 69)


def pairs(spark, gold, pred, **extra):
    data = [("x", i, g, p) for i, (g, p) in enumerate(zip(gold, pred))]
    return spark.createDataFrame(data, "exp string, item_id long, gold string, pred string")


def one(df, columns=scoring.METRICS):
    return df.first().asDict() if df.count() else {}


def test_small_golden(spark):
    got = one(scoring.agreement_metrics(
        pairs(spark, "AAABBC", ["A", "A", "B", "B", None, "A"]), ["exp"]))
    assert got["items"] == 6 and got["accuracy"] == pytest.approx(0.5)
    assert got["kappa"] == pytest.approx(0.217391, abs=1e-6)
    for m in ("precision", "recall", "f1"):
        assert got[m] == pytest.approx(0.291667, abs=1e-6)


def published(spark):
    cells = [(g, p, n) for g, row in zip(CLASSES, PUBLISHED) for p, n in zip(CLASSES, row) if n]
    table = spark.createDataFrame(cells, "gold string, pred string, n int")
    return table.select("gold", "pred", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))


def test_published_run(spark):
    got = one(scoring.agreement_metrics(published(spark), []))
    assert got["items"] == 448
    for name, value in PUBLISHED_METRICS.items():
        assert got[name] == pytest.approx(value, abs=1e-14), name
    per_label = {r["label"]: (r["total"], r["correct"])
                 for r in scoring.per_label_accuracy(published(spark), []).collect()}
    assert per_label == {
        c: (t, row[i]) for i, (c, t, row) in enumerate(zip(CLASSES, PUBLISHED_TOTALS, PUBLISHED))}


def test_metrics_ignore_order_and_partitioning(spark):
    df = published(spark)
    base = rows(scoring.agreement_metrics(df.coalesce(1), []).select(
        *[F.round(m, 12) for m in scoring.METRICS]))
    other = rows(scoring.agreement_metrics(df.repartition(7).orderBy(F.rand(3)), []).select(
        *[F.round(m, 12) for m in scoring.METRICS]))
    assert base == other


def test_kappa_limits(spark):
    assert one(scoring.agreement_metrics(pairs(spark, "AAB", "AAB"), ["exp"]))["kappa"] == 1.0
    single = one(scoring.agreement_metrics(pairs(spark, "AAA", "AAA"), ["exp"]))
    assert single["kappa"] is None and single["accuracy"] == 1.0
    empty = scoring.agreement_metrics(pairs(spark, "A", "A").where("false"), ["exp"])
    assert empty.count() == 0
    lost = one(scoring.agreement_metrics(pairs(spark, "AB", [None, None]), ["exp"]))
    assert (lost["kappa"], lost["accuracy"], lost["precision"]) == (0.0, 0.0, 0.0)


def test_alignment_is_by_item(spark):
    gold = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "item_id long, gold string")
    pred = spark.createDataFrame([(3, "C"), (2, "A"), (9, "Z")], "item_id long, pred string")
    assert rows(scoring.align(gold, pred, ["item_id"])) == [(2, "A", "B"), (3, "C", "C")]
    assert rows(scoring.alignment_audit(gold, pred, ["item_id"])) == [
        ("gold_only", 1), ("matched", 2), ("prediction_only", 1)]


def ratings(spark, table, gold=None):
    """One row per subject and run; labels sort like the numbers."""
    data = [
        ("x", "d", s, (gold or [r[0] for r in table])[s], run, value)
        for s, r in enumerate(table) for run, value in enumerate(r) if value != "skip"
    ]
    return spark.createDataFrame(
        [(e, d, s, g if isinstance(g, str) else f"L{g:02d}", run,
          v if v is None or isinstance(v, str) else f"L{v:02d}") for e, d, s, g, run, v in data],
        "exp string, dataset string, item_id long, gold string, run_idx int, pred string")


# Ratings of six subjects by four judges from Shrout and Fleiss, 1979.
SHROUT_FLEISS = [(9, 2, 5, 8), (6, 1, 3, 2), (8, 4, 6, 8), (7, 1, 2, 6), (10, 5, 6, 9), (6, 2, 4, 7)]


def icc(spark, table):
    patterns = consistency.rating_patterns(ratings(spark, table), ["exp"])
    return consistency.icc_two_way(patterns, ["exp"]).first()["icc"]


def test_icc_golden(spark):
    assert icc(spark, SHROUT_FLEISS) == pytest.approx(0.289764, abs=1e-6)
    assert icc(spark, SHROUT_FLEISS * 3) == pytest.approx(
        icc(spark, [r for r in SHROUT_FLEISS for _ in range(3)]), abs=1e-12)


def test_icc_undefined(spark):
    assert icc(spark, [(1,), (2,)]) is None
    assert icc(spark, [(1, 1), (1, 1)]) is None
    assert icc(spark, [(1, 2), (2, "skip"), (3, 1)]) is None
    assert icc(spark, [(1, 1), (2, 2), (3, 3)]) == pytest.approx(1.0)


def test_summary(spark):
    preds = ratings(
        spark, [("A", "A", "B"), ("A", "B", "B"), ("B", "B", "A"), ("B", None, "A")],
        gold=["A", "A", "B", "B"])
    got = consistency.condition_summary(preds, ["exp"]).first()
    assert got["best_run_idx"] == 0 and got["best_metrics"]["kappa"] == 1.0
    kappas = got["consistency"]["kappas_per_run"]
    assert len(kappas) == 3 and kappas[0] == 1.0 and kappas[2] < 0
    assert got["consistency"]["mean_kappa"] == pytest.approx(sum(kappas) / 3)
    codes = rows(consistency.label_codes(consistency.rating_patterns(preds, ["exp"]), ["exp"]))
    assert codes == [("x", "A", 0), ("x", "B", 1), ("x", "UNKNOWN", 2)]


def test_single_run_summary(spark):
    got = consistency.condition_summary(ratings(spark, [("A",), ("B",)]), ["exp"]).first()
    assert got["consistency"]["std_kappa"] == 0.0 and got["consistency"]["icc"] is None


def test_best_run_ties_and_undefined(spark):
    per_run = spark.createDataFrame(
        [("x", 0, None), ("x", 1, 0.5), ("x", 2, 0.5), ("y", 1, None), ("y", 0, None)],
        "exp string, run_idx int, kappa double")
    best = rows(consistency.best_run(per_run, ["exp"]).select("exp", "best_run_idx"))
    assert best == [("x", 1), ("y", 0)]


@pytest.mark.parametrize("size,accent,kappa", [
    (2, 0, 0.806728), (4, 0, 0.942480), (8, 0, 0.968495),
    (2, 1, 0.968788), (4, 1, 0.973906), (8, 1, 0.980760),
    (2, 3, 0.960290), (4, 3, 0.967063), (8, 3, 0.979030)])
def test_rule_annotator_golden(spark, sf001_dir, size, accent, kappa):
    preds = rules.predict_one(documents(spark, sf001_dir), Rule(0, size, accent), ["gold"])
    assert one(scoring.agreement_metrics(preds, []))["kappa"] == pytest.approx(kappa, abs=1e-6)


def test_patterns_of_a_grid_move_no_row_per_run(spark, sf_dir):
    """The rows of an item are made in one task: what is shuffled is the evidence of each text and the counts."""
    from kappaloom.operators import consistency, rules
    from kappaloom.plans.queries import documents, grid

    patterns = consistency.rating_patterns(rules.predict_grid(documents(spark, sf_dir), grid(5)), ["cond_id"])
    plan = patterns._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in dealt if "cond_id" in line and "item_id" in line]
    assert [line for line in dealt if "cond_id" in line and "ratings" in line]
    assert rows(patterns.select("n").agg(F.sum("n"))) == [(documents(spark, sf_dir).count() * 54,)]
