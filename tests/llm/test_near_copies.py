import random
import re

import numpy as np
import pytest
from test_simhash import corpus

from kappaloom.llm import near_copies as nc
import corpus_pipeline as cp


def shingles(text, width=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(ws[i:i + width]) for i in range(len(ws) - width + 1)} or ({tuple(ws)} if ws else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(rows, similarity=0.8, width=5):
    """The component of each row, as the position of its first row."""
    sets = [shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and jaccard(sets[i], sets[j]) >= similarity:
                old = label[i]
                label = [label[j] if x == old else x for x in label]
    return label


def heads(rows, **settings):
    """Ids that stay, and how many rows have none."""
    of, label = {}, groups(rows, **settings)
    for (i, t), g in zip(rows, label):
        of.setdefault(g, []).append((i, t))
    out = []
    for members in of.values():
        ids = [i for i, _ in members if i is not None]
        out += [(min(ids), t) for t in {t for i, t in members if i == min(ids)}] if ids else [(None, t) for t in {t for _, t in members}]
    return sorted(out, key=repr)


def planted(seed, n=60):
    """(rows, pairs): originals with copies of Jaccard 0.8 to 0.95 in which words are replaced."""
    rnd = random.Random(seed)
    rows, pairs = [], []
    while len(pairs) < n:
        ws = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(60, 800))]
        copy = list(ws)
        for k in range(rnd.randint(1, max(1, len(ws) // 45))):
            copy[rnd.randrange(len(ws))] = f"x{seed}-{len(pairs)}-{k}"
        if 0.8 <= jaccard(shingles(" ".join(ws)), shingles(" ".join(copy))) <= 0.95:
            i = 10 * len(pairs)
            rows += [(i, " ".join(ws)), (i + 1, " ".join(copy))]
            pairs.append((i, i + 1))
    return rows, pairs


def test_stage_drops_copies_of_four_fifths(spark, docs_of, sf_dir):
    rows, pairs = planted(1)
    kept = {r.doc_id for r in cp.drop_near_copies(spark, docs_of(rows), sf_dir).collect()}
    assert kept == {a for a, _ in pairs}


def test_stage_keeps_what_is_less_alike(spark, docs_of, sf_dir):
    ws = [f"w{i}" for i in range(104)]  # 100 shingles
    near, far = list(ws), list(ws)
    for k in (20, 70):  # 90 of 110 shingles are shared
        near[k] = "x"
    for k in (20, 50, 80):  # 85 of 115
        far[k] = f"y{k}"
    rows = [(1, " ".join(ws)), (2, " ".join(near)), (3, " ".join(far))]
    assert sorted(r.doc_id for r in cp.drop_near_copies(spark, docs_of(rows), sf_dir).collect()) == [1, 3]


@pytest.mark.parametrize("seed,cut", [(2, None), (3, 300)])
def test_groups_against_brute_force(docs_of, monkeypatch, seed, cut):
    if cut:
        monkeypatch.setattr(nc, "UNIT_SHINGLES", cut)
        monkeypatch.setattr(nc, "BUFFER_BYTES", 2000)
    rows = corpus(seed)
    kept = nc.one_of_each_near_group(docs_of(rows))
    assert kept.columns == docs_of([]).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == heads(rows)


def test_copies_of_a_third_and_empty(docs_of):
    rows = [(i, "one text with some words in it" if i % 3 == 0 else f"w{i} x{i} y{i} z{i} q{i}") for i in range(3000)]
    assert nc.one_of_each_near_group(docs_of(rows)).count() == 2001
    assert nc.one_of_each_near_group(docs_of([])).count() == 0


def test_templated_sets_meet_few_others(monkeypatch):
    """Sets that share most entries but not enough: work per set does not grow with the bucket."""
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 60, 140)
    seen, spread = [], nc._spread
    monkeypatch.setattr(nc, "_spread", lambda edge, lists: (out := spread(edge, lists), seen.append(len(out[0])))[0])
    for n in (50, 500):
        seen.clear()
        sets = [np.unique(np.append(common, rng.integers(0, 1 << 60, 60))).astype(np.uint64) for _ in range(n)]
        sets += [sets[7], np.append(sets[9], np.uint64(1))]
        assert sorted(map(sorted, nc.set_links(sets, 0.8))) == [[7, n], [9, n + 1]]
        assert sum(seen) < 60 * (n + 20)


def test_simhash_names_candidates_and_the_sets_decide(spark, monkeypatch):
    from pyspark.sql import functions as F

    from kappaloom.llm import near_copies

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:200]), " ".join(words[:199]), " ".join(words[200:]), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    radii, real = [], near_copies.near_links

    def all_hang_together(prints, radius):
        radii.append((radius, real(prints, radius).columns))
        return prints.select(F.col("fp").alias("a"), F.lit(0).cast("long").alias("b"))

    monkeypatch.setattr(near_copies, "near_links", all_hang_together)
    groups = near_copies.near_copy_groups(docs, 5, 0.8)
    assert radii == [(4, ["a", "b"])]
    assert {r.least: r.component_id for r in groups.collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
