import random

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from kappaloom.llm import token_counts as tc
from kappaloom.llm.queries import PIECE_MODEL, QUERIES, vocabulary

PATH = vocabulary(PIECE_MODEL)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_documents_against_the_library(spark, sf_dir, library):
    got = {r.doc_id: r for r in QUERIES["op9_token_counts"](spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        n = len(library.encode(d.text))
        assert (got[d.doc_id].n_tokens, got[d.doc_id].over_limit) == (n, n > 4096)
        assert got[d.doc_id].n_bytes == len(d.text.encode())


def test_edges(docs_of, library):
    texts = [None, "", " ", "   ", "a", " a", "<s>x</s><unk>", "<0x41>", "ﬁ①é", "a\x00b", "▁▁ ▁x▁", "\u3000y\xa0z", "a" * 3000,
             " " * 500 + "x", "日本語" * 400, "😀é" * 50, "word " * 40000, "\ufffd\u200b"]
    rows = list(enumerate(texts)) + [(None, "a b"), (3, "   ")]
    got = tc.token_counts(docs_of(rows), PATH).collect()
    assert [(r.doc_id, r.n_bytes, r.n_tokens) for r in got] == [
        (i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows]
    assert tc.token_counts(docs_of([]), PATH).count() == 0


def test_limit(docs_of):
    got = tc.token_counts(docs_of([(1, "a b c"), (2, "a b c d")]), PATH, limit=3).collect()
    assert [r.over_limit for r in got] == [False, True]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abcdeinotr  ▁é日\n<0", max_size=60), min_size=1, max_size=5))
def test_any_text(library, texts):
    assert tc.count_text_tokens(pa.array(texts), PATH).tolist() == [len(x) for x in library.encode(texts)]


def test_long_runs_without_spaces(library):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("theinganderstion") for _ in range(4000)) for _ in range(3)]
    assert tc.count_text_tokens(pa.array(texts), PATH).tolist() == [len(x) for x in library.encode(texts)]
