"""Alignment of two tokenisers against a plain version on whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from kappaloom.llm.queries import BYTE_MODEL, PIECE_MODEL, op13_token_alignment, vocabulary
from kappaloom.llm.token_align import align, chunks_of, linked_tokens, token_alignment, vocabularies


def byte_table():
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            table[chr(256 + extra)] = b
            extra += 1
    return table


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary(BYTE_MODEL))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_MODEL)), byte_table()


def tokens_of(text, tools):
    """([(id, bytes)] of A, of B) from the libraries on the whole text; None where they don't spell it."""
    a, b, letters = tools
    if not text:
        return None
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (left, right) if all(b"".join(t for _, t in side) == whole for side in (left, right)) else None


def spans(side):
    at, out = 0, []
    for i, t in side:
        out.append((at, at + len(t), i))
        at += len(t)
    return out


def plain(rows, tools):
    docs, holds = [], Counter()
    for doc_id, text in rows:
        both = tokens_of(text, tools)
        if both is None:
            docs.append((doc_id, None, None, None))
            continue
        left, right = map(spans, both)
        links, j = [], 0
        for lo, hi, x in left:
            while right[j][1] <= lo:
                j += 1
            k = j
            while k < len(right) and right[k][0] < hi:
                links.append((x, right[k][2]))
                k += 1
        holds.update(set(links))
        cuts = sorted({e for _, e, _ in left} & {e for _, e, _ in right})
        groups, i, j = [], 0, 0
        for cut in cuts:
            a, b = [], []
            while i < len(left) and left[i][1] <= cut:
                a.append(str(left[i][2]))
                i += 1
            while j < len(right) and right[j][1] <= cut:
                b.append(str(right[j][2]))
                j += 1
            groups.append(",".join(a) + "|" + ",".join(b))
        docs.append((doc_id, (len(left), len(right)), links, groups))
    most = defaultdict(int)
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, n, links, groups in docs:
        if n is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((doc_id, *n, len(groups), len(links), sum(holds[p] == most[p[0]] for p in links),
                        sum(holds[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def own(docs):
    return token_alignment(docs, vocabulary(BYTE_MODEL), vocabulary(PIECE_MODEL))


def test_query_over_the_whole_table(spark, sf_dir, tools):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert found(op13_token_alignment(spark, sf_dir)) == plain(docs, tools)


EDGES = [
    (1, None), (2, ""), (3, " "), (4, "   lead and  two\n\n  spaces\t   x \n"), (5, "a▁b"), (6, "<|endoftext|> </s><s>"),
    (7, "日本語のテキスト と 中文"), (8, "ﬁ É ① é é ñ"), (9, "\x00\x01\x1f \x85   y"), (10, "🙂🙃 🙂🙃 x🙂"),
    (11, "x" * 40_000), (12, "word " * 20_000), (13, "no spaces," * 3_000), (14, "same text"), (15, "same text"),
    (15, "same text"), (None, "no id here"), (None, None), (16, "   a   b　 c"), (17, "don't I'LL we've 1234567 3.14 €5"),
    (18, "﻿mark ​ zero"), (19, "tab\t\tx\r\n\r\n  y"), (20, "çà été ß ü"), (21, "%% ## == -- \\\\ //"),
]


def test_edges(docs_of, tools):
    assert found(own(docs_of(EDGES))) == plain(EDGES, tools)


def test_empty_table(docs_of):
    assert found(own(docs_of([]))) == []


def test_whole_groups_on_request(docs_of, tools):
    got = token_alignment(docs_of([(1, "hello"), (2, None)]), vocabulary(BYTE_MODEL), vocabulary(PIECE_MODEL), digest=False)
    groups = dict((r["doc_id"], r["groups"]) for r in got.collect())
    a, b, _ = tools
    assert groups == {1: f"{','.join(map(str, a.encode(' hello').ids))}|{','.join(map(str, b.encode('hello')))}", 2: ""}


def test_chunks_are_encoded_as_in_the_whole(tools, spark, sf_dir):
    texts = [t for _, t in EDGES if t] + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() if r[0]]
    a, b, _ = tools
    both = vocabularies(vocabulary(BYTE_MODEL), vocabulary(PIECE_MODEL))
    view, counts = chunks_of(pa.array(texts))
    (a_ids, a_n), (b_ids, b_n) = both.encode(view.to_pylist())
    assert a_ids.tolist() == [i for t in texts for i in a.encode(" " + t, add_special_tokens=False).ids]
    assert b_ids.tolist() == [i for t in texts for i in b.encode(t)]
    assert counts.sum() == len(view) and (counts > 0).all()


def overlaps(a, b):
    starts_a, starts_b = [0, *a[:-1]], [0, *b[:-1]]
    return [(i, j) for i in range(len(a)) for j in range(len(b)) if max(starts_a[i], starts_b[j]) < min(a[i], b[j])]


@pytest.mark.parametrize("seed", range(8))
def test_divide_and_conquer_on_random_ends(seed):
    rng = np.random.default_rng(seed)
    first_a, first_b, a, b, at = [0], [0], [], [], 0
    for _ in range(12):
        size = int(rng.integers(1, 60))
        for ends, first in ((a, first_a), (b, first_b)):
            inner = np.flatnonzero(rng.random(size - 1) < rng.choice([0.02, 0.3, 0.9])) + 1
            ends += (at + inner).tolist() + [at + size]
            first.append(len(ends))
        at += size
    ends_a, ends_b = np.array(a), np.array(b)
    groups = align(ends_a, ends_b, np.array(first_a), np.array(first_b))
    assert ends_a[groups.hi_a - 1].tolist() == ends_b[groups.hi_b - 1].tolist() == sorted(set(a) & set(b))
    assert groups.lo_a.tolist() == [0, *groups.hi_a[:-1].tolist()] and groups.lo_b.tolist() == [0, *groups.hi_b[:-1].tolist()]
    got = list(zip(*(x.tolist() for x in linked_tokens(groups, ends_a, ends_b))))
    assert sorted(got) == overlaps(a, b) and len(got) == len(a) + len(b) - len(groups.lo_a)


def test_a_long_interval_with_one_end_far_from_its_middle():
    ends_a, ends_b = np.arange(1, 100_001) * 2, np.append(np.arange(100_000) * 2 + 1, 200_000)
    ends_b[7] = 14
    groups = align(ends_a, ends_b, np.array([0, 100_000]), np.array([0, 100_001]))
    assert ends_a[groups.hi_a - 1].tolist() == [14, 200_000]
