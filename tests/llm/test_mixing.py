import re

from pyspark.sql import functions as F

from kappaloom.llm.mixing import mix_sources


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, no int")


def targets_of(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        words = total - sum(cap * sizes[s] for s in capped)
        rest = sum(weight[s] for s in sizes if s not in capped)
        above = {s for s in sizes if s not in capped and cap * sizes[s] * rest < weight[s] * words}
        if not above:
            return {s: cap * sizes[s] if s in capped else words * weight[s] / rest for s in sizes}
        capped |= above


def check(spark, rows, near=0.03):
    df = table(spark, rows)
    got = mix_sources(df, keep=("source",)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = targets_of(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(want[r.source], 1)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.size * r.copies
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near * want[s] + 1
    return got


def rows_of(n, sources, words=lambda i: i % 37):
    return [(i, "w " * words(i), sources[i % len(sources)], 9, 9) for i in range(n)]


def test_targets_and_words(spark):
    check(spark, rows_of(3000, ["a", "b", "c", "d", None, "é", "B", "~"]))


def test_hot_source_and_caps(spark):
    check(spark, rows_of(2500, ["a"] * 8 + ["b", "c", "d"]))
    check(spark, rows_of(400, ["z"] * 20 + ["a", "b"]))


def test_reruns_agree_whatever_the_partitions(spark):
    rows = rows_of(1500, ["a", "b", "c", None])
    first = sorted(map(tuple, mix_sources(table(spark, rows)).collect()))
    again = sorted(map(tuple, mix_sources(table(spark, rows[::-1]).repartition(5)).collect()))
    assert first == again and first != sorted(map(tuple, mix_sources(table(spark, rows), seed="other").collect()))


def test_longer_texts_are_likelier(spark):
    got = check(spark, rows_of(6000, ["a", "b"], lambda i: 2 if i % 4 < 2 else 300), near=0.05)
    rate = {s: sum(r.copies for r in got if r.source == "b" and r.size == s) for s in (2, 300)}
    assert rate[300] > rate[2]


def test_edges(spark):
    rows = [(1, None, "a", 1, 1), (2, "", "a", 1, 1), (3, " \n", None, 1, 1)]
    check(spark, rows)
    assert mix_sources(table(spark, [])).count() == 0
    check(spark, [(1, "x y", "a", 1, 1)] * 40 + [(None, "x", "b", 1, 1)] * 3, near=0.2)
    check(spark, [(1, "x " * 200000, "a", 1, 1), (2, "y", "b", 1, 1)], near=1)


def test_main_path_is_native(spark):
    plan = mix_sources(table(spark, rows_of(50, ["a", "b"])))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_one_source_is_taken_once(spark):
    got = mix_sources(table(spark, rows_of(100, ["a"]))).agg(F.min("copies"), F.max("copies")).first()
    assert tuple(got) == (1, 1)
