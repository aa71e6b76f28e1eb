"""The trie of conversation beginnings against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from kappaloom.llm import prefix_trie
from kappaloom.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, n_convs int"


def rebuilt(rows, every=100, below=6):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % below
        base = c - (c % every if c >= 0 else -(-c % every))
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def plain(rows):
    convs = rebuilt(rows)
    nodes = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    children = {p: [] for p in nodes}
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children[p]),
                    leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(parts)
    got = conversation_trie(df).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r) for r in got.collect()), key=repr)


def talk(c, texts, start=0):
    return [(c, start + i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)]


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample([*range(-130, 330)], 60):
        rows += talk(c, [rng.choice("ab") * rng.randint(0, 2) for _ in range(rng.randint(1, 11))])
    return rows


def edges():
    rows = talk(0, ["a", "b", "c"]) + talk(1, ["a", "b", "c"]) + talk(2, ["a", "b", "c"])
    rows += [(7, None, None, None), (7, 1, "user", "x"), (7, 1, "user", "x"), (7, 0, "user", "ü"), (None, 0, "user", "n")]
    rows += talk(100, []) + talk(101, ["only"]) + talk(250, ["no base", "b"]) + talk(-7, ["a", "b"])
    rows += talk(300, ["t" * 50_000, "u"]) + talk(301, ["t" * 50_000, "u"])
    return rows + [(9, 0, "a", "bc"), (10, 0, "ab", "c")]  # told apart where role and text meet


@pytest.mark.parametrize("rows", [edges(), random_rows(1), random_rows(2)], ids=["edges", "first", "second"])
def test_as_the_plain_version(spark, rows):
    assert found(spark, rows) == plain(rows)


def test_long_conversations_in_short_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SUPER", 2)
    rng = random.Random(3)
    texts = [rng.choice("xyz") for _ in range(90)]
    rows = talk(0, texts) + talk(1, texts) + talk(2, texts[:64]) + talk(3, texts[:40] + ["!"] * 20) + talk(400, texts[:9])
    assert found(spark, rows) == plain(rows)


def test_a_very_long_conversation(spark):
    rows = talk(5, [str(i) for i in range(9_000)]) + talk(6, ["a"])
    got = found(spark, rows, parts=8)
    want = rebuilt(rows)
    assert len(got) == len(want[5]) + len(want[6]) + 1
    assert sorted(r[1] for r in got if r[0] == 5)[-1] == len(want[5])
    assert {r[3:7] for r in got if r[0] == 5 and r[1] > 0} <= {(1, 1, 1, 0), (1, 0, 1, 0)}


def test_many_conversations_end_at_one_node(spark):
    rows = [r for c in range(25_000) for r in talk(100_000 + 100 * c, ["same"])]
    (root, node) = sorted(found(spark, rows, parts=8), key=lambda r: r[1])
    ids = ",".join(str(100_000 + 100 * c) for c in range(25_000))
    assert node == (100_000, 1, 100_000, 25_000, 0, 1, 4 * 24_999, hashlib.sha256(ids.encode()).hexdigest())
    assert root[:7] == (100_000, 0, None, 25_000, 1, 1, 4 * 24_999)


def test_no_conversation(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []
