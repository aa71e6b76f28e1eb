"""Cleaning, CSV scan, vocabulary, sampling."""

import hashlib

import pytest
from plain_rows import rows
from pyspark.sql import functions as F

from kappaloom.operators import sampling
from kappaloom.operators.cleaning import clean_items, label_vocabulary
from kappaloom.plans.queries import documents
from kappaloom.sources.items import read_items_csv


def items_of(spark, triples):
    return spark.createDataFrame(triples, "dataset string, item_id long, gold string").withColumn(
        "text", F.concat(F.lit("t"), F.col("item_id").cast("string")))


@pytest.mark.parametrize("bom", [b"", b"\xef\xbb\xbf"])
def test_csv_scan_and_cleaning(spark, tmp_path, bom):
    text = (
        'Requirement Statement,Label\r\n"He said ""hi"", ok"," A "\r\nfoo,\r\nNA,B\r\n"",C\r\n'
        ' bar ,D\r\n nb ,E\r\n"two\nlines",D\r\n'
    )
    (tmp_path / "items.csv").write_bytes(bom + text.encode())
    kept = clean_items(read_items_csv(spark, str(tmp_path / "items.csv"), "x"))
    assert rows(kept.select("text", "gold")) == [
        ('He said "hi", ok', "A"), ("bar", "D"), ("nb", "E"), ("two\nlines", "D")]
    assert rows(label_vocabulary(kept)) == [("x", "A", 0), ("x", "D", 1), ("x", "E", 2)]
    assert kept.select("item_id").distinct().count() == 4


def test_csv_errors(spark, tmp_path):
    (tmp_path / "items.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        read_items_csv(spark, str(tmp_path / "items.csv"), "x")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_items_csv(spark, str(tmp_path / "absent.csv"), "x")


def test_na_tokens_are_texts_without_the_option(spark):
    items = spark.createDataFrame([("d", 1, "NA", "x"), ("d", 2, None, "x")],
                                  "dataset string, item_id long, text string, gold string")
    assert clean_items(items).count() == 1
    assert clean_items(items, ["NA"]).count() == 0


def test_pool_golden(spark, sf001_dir):
    docs = documents(spark, sf001_dir).withColumn("dataset", F.lit("docs"))
    pool = sampling.stratified_pool(docs, 2, 42)
    assert rows(pool.select("label", "rank_in_label", "item_id")) == [
        ("English", 1, 464), ("English", 2, 795), ("French", 1, 298), ("French", 2, 65),
        ("German", 1, 103), ("German", 2, 690), ("Spanish", 1, 909), ("Spanish", 2, 439)]


def test_pool_and_test_set_partition_the_items(spark, sf_dir):
    docs = documents(spark, sf_dir)
    pool = sampling.stratified_pool(docs, 3).select("dataset", "item_id")
    test = sampling.test_split(docs, pool).select("dataset", "item_id")
    assert pool.intersect(test).count() == 0
    assert rows(pool.union(test)) == rows(docs.select("dataset", "item_id"))


@pytest.mark.parametrize("n", [1, 6, 40, 1000, 1001])
def test_draws_of_any_size(spark, n):
    """The smallest hashes of each group, also when one group holds most rows."""
    triples = [("a", i, "hot" if i % 3 else "rare") for i in range(3000)] + [("b", 9, "hot")]
    got = sampling.stratified_pool(items_of(spark, triples), n, 7)
    assert got.columns == ["dataset", "item_id", "label", "rank_in_label"]
    groups = {}
    for d, i, g in triples:
        groups.setdefault((d, g), []).append((hashlib.md5(f"7|{i}".encode()).hexdigest(), i))
    want = [(d, i, g, r + 1) for (d, g), ids in groups.items() for r, (_, i) in enumerate(sorted(ids)[:n])]
    assert rows(got) == sorted(want, key=lambda r: tuple(map(repr, r)))


def test_csv_ids_do_not_depend_on_the_splits(spark, tmp_path):
    lines = [f"text {i % 700 if i % 3 else 'hot'},{'AB'[i % 2]}" for i in range(5000)]
    (tmp_path / "items.csv").write_text("Requirement Statement,Label\n" + "\n".join(lines) + "\n")
    read = []
    for size in ("100m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = read_items_csv(spark, str(tmp_path / "items.csv"), "x", multi_line=False)
            read.append(rows(df.select("item_id", "text", "gold")))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert read[0] == read[1] and len({r[0] for r in read[0]}) == 5000


def test_csv_id_column(spark, tmp_path):
    (tmp_path / "items.csv").write_text("Requirement Statement,Label,key\nx,A,7\ny,B,9\n")
    got = read_items_csv(spark, str(tmp_path / "items.csv"), "x", id_col="key")
    assert rows(got) == [("x", 7, "x", "A"), ("x", 9, "y", "B")]


def test_sample_size_is_exact_and_order_free(spark):
    items = items_of(spark, [("a", i, "x") for i in range(100)] + [("b", i, "x") for i in range(5)])
    drawn = rows(sampling.uniform_sample(items, 20))
    assert [d[0] for d in drawn].count("a") == 20 and [d[0] for d in drawn].count("b") == 5
    assert rows(sampling.uniform_sample(items.repartition(13, "text"), 20)) == drawn
    assert sampling.uniform_sample(items, None).count() == 105


def test_round_robin_takes_labels_in_turn(spark):
    pool = spark.createDataFrame(
        [("d", 1, "A", 1), ("d", 2, "A", 2), ("d", 3, "A", 3), ("d", 4, "B", 1), ("d", 5, "C", 1)],
        "dataset string, item_id long, label string, rank_in_label int")

    def picked(n):
        ordered = sampling.round_robin_examples(pool, n).orderBy("pos")
        return [r["item_id"] for r in ordered.collect()]

    assert picked(1) == [1]
    assert picked(4) == [1, 4, 5, 2]
    assert picked(5) == picked(9) == [1, 2, 3, 4, 5]


def test_a_small_draw_is_one_pass(spark, tmp_path):
    spark.range(5_000).selectExpr("'d' AS dataset", "id AS item_id", "'hot' AS gold").write.parquet(str(tmp_path / "i"))
    plan = sampling.stratified_pool(spark.read.parquet(str(tmp_path / "i")), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("n", [1, 3, 99, 100, 101])
def test_both_ways_to_draw_agree(spark, monkeypatch, n):
    df = items_of(spark, [("d", i, "AB"[i % 3 == 0]) for i in range(400)]).unionByName(items_of(spark, [("d", 5, "B")] * 3))
    one = rows(sampling.first_by_hash(df, ["dataset", "gold"], n, 3))
    monkeypatch.setattr(sampling, "SMALL_DRAW", 0)
    assert rows(sampling.first_by_hash(df, ["dataset", "gold"], n, 3)) == one
