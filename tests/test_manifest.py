"""Tables of generations: appends, compaction, views, and what a dead writer leaves."""

import os

import pytest
from plain_rows import rows

from kappaloom.sources import manifest

SCHEMA = "item_id long, text string, k string"


def part(spark, k, ids):
    return spark.createDataFrame([(i, f"t{i}", k) for i in ids], SCHEMA)


def data_files(path):
    return [f for _, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")]


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "table")
    for n in range(6):
        manifest.append(part(spark, "ab"[n % 2], range(n * 10, n * 10 + 10)), path, ["k"])
    return path


def test_appends_add_up(spark, table):
    got = manifest.read(spark, table, SCHEMA)
    assert got.count() == 60 and got.where("k = 'a'").count() == 30
    assert len(manifest.live_generations(spark, table)) == 6


def test_compaction_keeps_the_rows_in_fewer_files(spark, table):
    before, view = rows(manifest.read(spark, table, SCHEMA)), manifest.read(spark, table, SCHEMA)
    assert manifest.compact(spark, table, SCHEMA, ["k"]) == 6
    assert rows(manifest.read(spark, table, SCHEMA)) == before == rows(view)  # an older view goes on
    assert len(manifest.live_generations(spark, table)) == 1
    assert manifest.compact(spark, table, SCHEMA, ["k"]) == 0
    assert manifest.remove_dead(spark, table) == 6 + 6
    assert len(data_files(table)) == 2 and rows(manifest.read(spark, table, SCHEMA)) == before
    manifest.append(part(spark, "c", [100]), table, ["k"])
    assert manifest.read(spark, table, SCHEMA).count() == 61


def test_large_generations_are_left_alone(spark, table):
    large = manifest.live_generations(spark, table)[0]
    sizes = manifest.files(spark, table)
    assert set(sizes) == set(manifest.live_generations(spark, table)) and all(n >= 1 for n, _ in sizes.values())
    manifest.append(part(spark, "a", range(1000, 90_000)), table, ["k"])
    new = manifest.live_generations(spark, table)[-1]
    n, size = manifest.files(spark, table)[new]
    assert manifest.compact(spark, table, SCHEMA, ["k"], small=size // n) == 6
    live = manifest.live_generations(spark, table)
    assert new in live and large not in live and len(live) == 2
    assert manifest.read(spark, table, SCHEMA).count() == 60 + 89_000


def test_a_write_that_died_is_not_read(spark, table, monkeypatch):
    before = rows(manifest.read(spark, table, SCHEMA))
    monkeypatch.setattr(manifest, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    for write in (lambda: manifest.append(part(spark, "a", [7]), table, ["k"]),
                  lambda: manifest.compact(spark, table, SCHEMA, ["k"])):
        with pytest.raises(RuntimeError):
            write()
        assert rows(manifest.read(spark, table, SCHEMA)) == before
    assert manifest.remove_dead(spark, table) > 0
    assert rows(manifest.read(spark, table, SCHEMA)) == before


def test_dropped_partitions_and_an_empty_table(spark, table, tmp_path):
    manifest.drop_partitions(spark, table, ["k=a", "k=z"])
    assert {r.k for r in manifest.read(spark, table, SCHEMA).collect()} == {"b"}
    assert manifest.read(spark, str(tmp_path / "none"), SCHEMA).count() == 0
    assert manifest.compact(spark, str(tmp_path / "none"), SCHEMA, ["k"]) == 0
