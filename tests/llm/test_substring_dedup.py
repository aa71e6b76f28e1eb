import hashlib
import random
import re

import numpy as np
import pytest

from kappaloom.llm import substring_dedup as sd


def brute(rows, span):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, ws in words:
        for p in range(len(ws) - span + 1):
            key, place = tuple(ws[p:p + span]), (1 << 63 if i is None else i, p)
            first[key] = min(first.get(key, place), place)
    out = []
    for i, ws in words:
        gone = set()
        for p in range(len(ws) - span + 1):
            if first[tuple(ws[p:p + span])] < (1 << 63 if i is None else i, p):
                gone.update(range(p, p + span))
        out.append((i, " ".join(w for p, w in enumerate(ws) if p not in gone), len(ws), len(gone)))
    return sorted(out, key=repr)


def run(docs_of, rows, span, **settings):
    got = sd.deduplicate_substrings(docs_of(rows), span=span, gram=3, **settings)
    return sorted(map(tuple, got.collect()), key=repr)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    passage = [rnd.choice("abcdefgh") + str(rnd.randint(0, 30)) for _ in range(40)]
    rows = []
    for i in range(n):
        ws = [rnd.choice("abcdefgh") + str(rnd.randint(0, 30)) for _ in range(rnd.randint(0, 80))]
        cut = rnd.randint(0, len(ws))
        a = rnd.randint(0, 20)
        if rnd.random() < 0.6:
            ws[cut:cut] = passage[a:a + rnd.randint(5, 40)]
        if rnd.random() < 0.2:
            ws += ["x"] * rnd.randint(1, 30)
        if rnd.random() < 0.2:
            ws += ["p", "q", "r"] * rnd.randint(1, 12)
        rows.append((i * 3, rnd.choice([" ", "\n", " \t"]).join(ws)))
    rows += [(500 + i, rows[5][1]) for i in range(30)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(docs_of, seed):
    rows = corpus(seed)
    assert run(docs_of, rows, 8) == brute(rows, 8)


def test_hot_buckets_and_small_buffers(docs_of, monkeypatch):
    monkeypatch.setattr(sd, "HOT_ROWS", 2)
    rows = corpus(4)
    assert run(docs_of, rows, 8) == brute(rows, 8)
    monkeypatch.setattr(sd, "HOT_ROWS", 20_000)
    spans, keep = sd._repeats(_table(["a b c", "b c d", "a b c d"]), 0, 3)
    assert spans.to_pylist() == [dict(doc=2, sign=0, start=0, n=2)] and keep.tolist() == [0, 1]


def _table(packed):
    import pyarrow as pa
    n = len(packed)
    return pa.table({"bucket": [1] * n, "packed": packed, "doc": list(range(n)),
                     "sign": pa.array([0] * n, pa.int64()), "start": pa.array([0] * n, pa.int32())})


def test_bucket_larger_than_a_buffer(spark):
    rows = [(7, " ".join(f"w{(i * 7 + j) % 40}" for j in range(6)), i, 0, 0) for i in range(200)]
    supers = spark.createDataFrame(rows, sd.SUPER_SCHEMA)
    got = {(r.doc, r.start + k) for r in sd.repeated_spans(supers, 4, buffer=300).collect() for k in range(r.n)}
    seen, want = set(), set()
    for _, packed, doc, *_ in rows:
        ws = packed.split(" ")
        for p in range(3):
            key = tuple(ws[p:p + 4])
            if key in seen:
                want.add((doc, p))
            seen.add(key)
    assert got == want


def test_edges(docs_of):
    long = " ".join(f"u{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, "   \n"), (4, "a b"), (5, long), (6, "v " + long), (None, long),
            (7, long), (7, long), (8, "a b"), (9, "x " * 100)]
    assert run(docs_of, rows, 20) == brute(rows, 20)
    assert run(docs_of, [], 20) == []


def test_one_id_with_two_texts(docs_of):
    a = " ".join(f"a{i}" for i in range(30))
    rows = [(1, a), (1, "z " + a), (2, a)]
    assert run(docs_of, rows, 20) == brute(rows, 20)


def test_digest_is_of_the_kept_words(docs_of):
    rows = corpus(5)
    plain = {r[0]: r[1] for r in run(docs_of, rows, 8)}
    for r in run(docs_of, rows, 8, digest=True):
        assert r[1] == hashlib.sha256(plain[r[0]].encode()).hexdigest()


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(sd, "_rolling", lambda values, width: np.zeros(len(values) - width + 1, np.uint64))
    ids = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    assert sd._first_seen(ids, np.array([0, 3, 6]), 3).tolist() == [0, 1, 0]


def test_texts_of_equal_32_bit_hash_without_id(docs_of, spark):
    """Rows without id whose texts share the hash that once told them apart."""
    from pyspark.sql import functions as F

    texts = spark.range(250_000).select(F.concat(*[
        F.concat(F.lit("w"), (F.xxhash64("id", F.lit(j)) % 100_000).cast("string"), F.lit(" ")) for j in range(25)]).alias("text"))
    pair = texts.groupBy(F.hash("text", F.length("text"))).agg(F.collect_list("text").alias("t")).where("size(t) > 1").head()
    first, second = pair["t"][:2]
    rows = [(1, first), (None, first), (None, second)]
    assert run(docs_of, rows, 20) == brute(rows, 20)
    kept = {t: n for _, t, _, n in run(docs_of, rows, 20) if n == 0}
    assert second.strip() in kept


def test_many_copies_without_id_are_one_place(docs_of):
    text = " ".join(f"c{i}" for i in range(60))
    rows = [(None, text)] * 3_000 + [(3, text)] * 500 + [(5, "y " + text)]
    got = run(docs_of, rows, 20)
    assert got == brute(rows, 20)
    assert sum(n == 60 for *_, n in got) == 3_001
