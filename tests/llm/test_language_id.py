import random
import string
import zlib

import pytest

from kappaloom.llm import language_id as li
from kappaloom.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf001_dir):
    rows = {r.doc_id: r for r in QUERIES["op6_language_id"](spark, sf001_dir).collect()}
    docs = spark.read.parquet(f"{sf001_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 5 == 0]
    assert all(rows[d.doc_id].held_out == (d in held) for d in docs)
    assert sum(rows[d.doc_id].lang_pred == d.lang for d in held) / len(held) > 0.95
    assert sum(r.rejected for r in rows.values()) / len(rows) < 0.02
    assert all(0 <= r.score <= 1 for r in rows.values())


@pytest.fixture
def model():
    return li.LanguageModel({
        "en": (b"the quick brown fox jumps over the lazy dog and then the other one with which they were " * 3),
        "de": ("der schnelle braune fuchs springt über den faulen hund und dann die anderen mit denen sie " * 3).encode()})


def test_edges(docs_of, model):
    rows = [(1, None), (2, ""), (3, "12 345 !!"), (4, "they were over the lazy dog with the other one"), (None, "über den faulen hund"),
            (5, "springt über den faulen hund " * 20000), (4, "they were over the lazy dog with the other one"), (6, "²³ ¼")]
    got = [(r.doc_id, r.lang_pred, r.rejected, r.score == 0) for r in li.identify(docs_of(rows), model).collect()]
    und = ("und", True, True)
    assert got == [(1, *und), (2, *und), (3, *und), (4, "en", False, False), (None, "de", False, False),
                   (5, "de", False, False), (4, "en", False, False), (6, *und)]
    kept = li.keep_identified(docs_of(rows), model)
    assert kept.columns == docs_of([]).columns and kept.count() == 4


def test_kept_columns_may_clash(docs_of, model):
    got = li.identify(docs_of([(1, "the lazy dog and the quick fox")]), model, keep=("lang", "fp")).collect()
    assert (got[0].lang, got[0].fp) == ("en", 0)


def test_sizes_against_plain_compression(model):
    import zstandard
    text = "The lazy dog, and then!"
    sizes = {}
    for lang, content in model.dictionaries.items():
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        sizes[lang] = len(zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=False, write_dict_id=False).compress(
            b"the lazy dog and then "))
    assert model.classify(text, model.compressors())[:2] == ("en", 1 - sizes["en"] / sizes["de"])


def test_training(docs_of):
    docs = docs_of([(i, "ein text mit wörtern") for i in range(50)] + [(99, None), (None, "x"), (100, "777")])
    trained = li.train(docs)
    assert list(trained.dictionaries) == ["en"] and trained.dictionaries["en"] == "ein text mit wörtern".encode()
    assert trained.classify("text mit", trained.compressors()) == ("en", 1.0, False)
    nothing = li.train(docs_of([]))
    assert nothing.classify("text", nothing.compressors()) == ("und", 0.0, True)
    assert li.identify(docs_of([]), trained).count() == 0
    with pytest.raises(ValueError):
        li.train(docs, max_languages=0)


def test_what_was_not_learned_is_rejected(spark):
    rnd = random.Random(3)

    def word():
        return "".join(rnd.choice(string.ascii_lowercase) for _ in range(rnd.randint(2, 9)))

    vocabulary = {lang: [word() for _ in range(1500)] for lang in ("aa", "bb", "cc", "dd")}

    def text(lang, least=1):
        # A fifth of the words is shared, as names and loan words are.
        return " ".join(rnd.choice(vocabulary["aa" if rnd.random() < 0.2 else lang]) for _ in range(rnd.randint(least, 300)))

    rows = [(i, text(lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 1200)]
    model = li.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tools = model.compressors()
    rejected = lambda texts: sum(model.classify(t, tools)[2] for t in texts) / len(texts)
    assert rejected([text(lang) for lang in ("bb", "cc") for _ in range(300)]) < 0.03
    assert rejected([text("dd", 50) for _ in range(300)]) > 0.9
    assert rejected([" ".join(word() for _ in range(rnd.randint(50, 300))) for _ in range(300)]) > 0.9
    assert rejected(["".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(800)) for _ in range(100)]) > 0.9
