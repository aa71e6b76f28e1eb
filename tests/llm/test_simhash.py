import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from kappaloom.llm import simhash as sh
from kappaloom.llm.components import star_roots
from kappaloom.llm.xxh64 import xxh64_slices


def fingerprint(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(ws[i:i + width]) for i in range(len(ws) - width + 1)] or ([" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids, radius):
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                label[find(i)] = find(j)
    best = {}
    for x in range(len(prints)):
        if ids[x] is not None:
            best[find(x)] = min(best.get(find(x), ids[x]), ids[x])
    return [best.get(find(x)) for x in range(len(prints))]


def corpus(seed):
    rnd = random.Random(seed)
    base = [[rnd.choice("abcdefg") + str(rnd.randint(0, 9)) for _ in range(rnd.randint(1, 200))] for _ in range(25)]
    rows = []
    for i in range(150):
        ws = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            ws[rnd.randrange(len(ws))] = rnd.choice(["X", "y", "é"])
        rows.append((1000 - i, rnd.choice([" ", "\n"]).join(ws)))
    return rows + [(5, None), (6, ""), (7, " \t"), (8, "A"), (9, "a"), (10, "a b c"), (8, "A"), (None, "a b c"), (None, "q r s t u v")]


@pytest.mark.parametrize("width,radius", [(4, 4), (5, 7), (4, 0)])
def test_groups_against_brute_force(docs_of, width, radius):
    rows = corpus(width + radius)
    prints = [fingerprint(t, width) for _, t in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(
        rows, prints, components(prints, [i for i, _ in rows], radius))), key=repr)
    got = sh.simhash_groups(docs_of(rows), width, radius).collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_large_tries_are_cut_into_pairs(spark, docs_of, monkeypatch):
    monkeypatch.setattr(sh, "UNIT_ROWS", 3)
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 40, 60).tolist()
    for _ in range(300):
        prints.append(prints[rng.integers(len(prints))] ^ sum(1 << int(b) for b in rng.integers(0, 64, 3)))
    prints = sorted(set(x if x < 1 << 63 else x - (1 << 64) for x in prints))
    links = sh.near_links(spark.createDataFrame([(p,) for p in prints], "fp long"), 4)
    root = {r.a: r.b for r in star_roots(links).collect()}
    want = components([p % (1 << 64) for p in prints], list(range(len(prints))), 4)
    where = {p: i for i, p in enumerate(prints)}
    got = [where[root.get(p, p)] for p in prints]
    assert [min(i for i, g in enumerate(got) if g == x) for x in got] == want


def test_trie_join_finds_what_all_pairs_find():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for _ in range(3):
        flips = np.uint64(1) << rng.integers(0, 64, len(keys)).astype(np.uint64)
        keys = np.unique(np.concatenate([keys, keys ^ flips ^ (np.uint64(1) << np.uint64(rng.integers(64)))]))
    root = sh.TrieJoin(keys, 4, 0).run(np.array([[0, len(keys), 0, len(keys)]]))
    assert root.tolist() == components(keys.tolist(), list(range(len(keys))), 4)


def test_one_of_each_group_stays(docs_of):
    rows = corpus(1)
    prints = [fingerprint(t, 4) for _, t in rows]
    heads = {c for c in components(prints, [i for i, _ in rows], 4) if c is not None}
    kept = sh.one_of_each_group(docs_of(rows))
    assert kept.columns == docs_of([]).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([*heads, None], key=repr)


def test_copies_of_a_third_and_empty(docs_of):
    rows = [(i, "one text with some words" if i % 3 == 0 else f"w{i} x{i} y{i} z{i} q{i}") for i in range(3000)]
    got = sh.simhash_groups(docs_of(rows)).groupBy("component_id").count().where("count > 1").collect()
    assert [tuple(r) for r in got] == [(0, 1000)]
    assert sh.simhash_groups(docs_of([])).count() == 0 and sh.one_of_each_group(docs_of([])).count() == 0


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(9000, 9001), (5, 5)], "a long, b long")
    roots = {r.a: r.b for r in star_roots(links).collect()}
    assert roots == {**{i: 0 for i in range(1, 501)}, 9001: 9000}


def test_xxh64_of_slices():
    rng = random.Random(4)
    data = bytes(rng.randrange(256) for _ in range(5000))
    cuts = [sorted((rng.randrange(5000), rng.randrange(5000))) for _ in range(200)] + [[i, i + n] for i in (0, 7) for n in range(70)]
    got = xxh64_slices(data, np.array([a for a, _ in cuts]), np.array([b for _, b in cuts]))
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in cuts]


def test_very_long_text():
    text = "Some words here " * 100000
    assert sh.fingerprints(pa.array([text, "x"]), 4).tolist() == [fingerprint(text, 4), fingerprint("x", 4)]
