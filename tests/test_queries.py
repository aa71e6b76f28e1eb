"""Every registered query against its SQL, and the shape of the plans that matter."""

import re

import pytest
from oracle import connect, differences

import __spark_entry__ as registry
from kappaloom.plans import queries as q


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(q.QUERIES) == set(registry.ORACLES) and set(q.QUERIES) <= set(registry.queries())


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query(spark, sf_dir, con, name):
    assert differences(registry.queries()[name](spark, sf_dir), con, registry.oracle_sql()[name]) == []


def test_entry(spark):
    assert registry.entry(spark).count() == 2


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grid_annotation_shuffles_nothing(spark, sf_dir):
    """Beyond the spreading of the tiny test file the only exchange is the broadcast."""
    rows = q.rules.predict_grid(
        spark.createDataFrame([], "dataset string, item_id long, text string, gold string"), q.grid(5))
    text = plan(rows)
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("n", [1000, 1001])
def test_pool_reads_keys_only_and_ranks_by_bucket(spark, sf_dir, n):
    pool = q.sampling.stratified_pool(q.documents(spark, sf_dir), n)
    text = plan(pool)
    assert pool.columns == ["dataset", "item_id", "label", "rank_in_label"]
    windows = re.findall(r"windowspecdefinition\(([^)]*)", text)
    assert windows and all("_bucket" in w for w in windows)
    assert "text" not in text.split("ReadSchema")[1].split("\n")[0]


def test_test_split_moves_no_text(spark, sf_dir):
    items = q.documents(spark, sf_dir)
    text = plan(q.sampling.test_split(items, q.pool_of(items)))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_prediction_filter_prunes_folders(spark, tmp_path):
    rows = spark.createDataFrame(
        [("d", "m", "zero_shot", l, "c", 0, f"r{l}", 1, "A", "a", 1, None, "A", "exact", None)
         for l in ("long", "short")], q.results.PREDICTION_SCHEMA)
    path = str(tmp_path / "p")
    q.results.append_predictions(rows, path)
    kept = q.results.read_predictions(spark, path).where("length = 'long'")
    assert kept.count() == 1 and "PartitionFilters: [isnotnull(length" in plan(kept)
