import functools
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from kappaloom.llm import lattice
from kappaloom.llm.language_id import fold
from kappaloom.llm.lm_score import lm_scores
from kappaloom.llm.queries import PIECE_MODEL, vocabulary


@pytest.fixture(scope="module")
def path():
    return vocabulary(PIECE_MODEL)


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def segmentations(path, log_p):
    """Forward sum and expected piece counts of a word, over the library's pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    piece = {m.id_to_piece(i): i for i in range(m.vocab_size())
             if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
    byte = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]

    def ways(word, at=0):
        if at == len(word):
            yield 1.0, ()
        for end in range(at + 1, min(len(word), at + 16) + 1):
            ids = (piece[word[at:end]],) if word[at:end] in piece else (
                tuple(byte[b] for b in word[at].encode()) if end == at + 1 else None)
            if ids:
                p = math.exp(sum(log_p[i] for i in ids))
                for q, rest in ways(word, end):
                    yield p * q, ids + rest

    @functools.lru_cache(None)
    def summed(word):
        every = list(ways("▁" + word))
        total = sum(p for p, _ in every)
        expected = Counter()
        for p, ids in every:
            for i in ids:
                expected[i] += p / total
        return total, expected

    return summed


def test_marginals_and_expected_counts(path):
    import numpy as np

    pieces = lattice.trie(path)
    log_p = np.log(np.maximum(pieces.prior, 1e-300))
    summed = segmentations(path, log_p)
    ws = ["the", "nation", "①x", "日本", "a▁b", "é", "😀a"]
    net = lattice.WordLattices(pa.array(ws), pieces)
    assert net.log_marginals(log_p) == pytest.approx([math.log(summed(w)[0]) for w in ws], rel=1e-12)
    want = np.zeros(pieces.size)
    for k, w in enumerate(ws):
        for i, x in summed(w)[1].items():
            want[i] += x * (k + 1)
    assert net.expected(log_p, np.arange(1.0, len(ws) + 1)) == pytest.approx(want, abs=1e-9)


def test_scores_against_brute_force(docs_of, path):
    rows = [(i, t) for i, t in enumerate(["The cat sat", "a cat", None, "", "the THE the", "né é", " \t", "dog cat\ncat"] * 3)]
    rows += [(3, "again cat"), (None, "cat")]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    got = lm_scores(docs_of(rows), fold() == 1, path, rounds=1).collect()
    train = Counter(t for i, text in rows if not held[i] for t in [*tokens(text), None])
    n, v = sum(train.values()), len(train)
    pieces = lattice.trie(path)
    import numpy as np
    prior = np.log(np.maximum(pieces.prior, 1e-300))
    seen = pieces.prior * 1000.0
    first = segmentations(path, prior)
    for word, c in train.items():
        if word is None:
            seen[pieces.end] += c
        else:
            for i, x in first(word)[1].items():
                seen[i] += x * c
    log_p = np.log(np.maximum(seen / seen.sum(), 1e-300))
    summed = segmentations(path, log_p)
    want = []
    for i, text in rows:
        ts = [*tokens(text), None]
        base = sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        score = (sum(math.log(summed(t)[0]) for t in ts[:-1]) + log_p[pieces.end]) / math.log(10)
        want.append((i, held[i], len(ts), sum(train[t] > 0 for t in ts), n, base, score))
    key = lambda r: (repr(r[0]), r[2], round(r[5], 6))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-4)


def test_very_long_words_and_empty(docs_of, path):
    got = lm_scores(docs_of([(1, "ab" * 20000 + " x"), (2, "日" * 5000)]), fold() == 1, path, rounds=1).collect()
    assert all(math.isfinite(r.score) and r.score < -100 for r in got)
    assert lm_scores(docs_of([]), fold() == 1, path).count() == 0


def test_nothing_to_learn_from(docs_of, path):
    from pyspark.sql import functions as F
    got = lm_scores(docs_of([(1, "a b")]), F.lit(True), path).collect()[0]
    assert (got.n_known, got.train_tokens, got.n_tokens) == (0, 0, 3) and got.base_score == 0.0 and got.score < 0
