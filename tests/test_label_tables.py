"""Labels as a table: the same answers as with labels in expressions, and as a plain matcher."""

import random

import numpy as np
import pytest

from kappaloom.functions.fuzzy import best_label
from kappaloom.operators import label_tables as lt
from kappaloom.operators.extract import STAGES, extract_labels
from kappaloom.operators.label_tables import closest, extract_with_table, fuzzy_matches, key_table
from plain_rows import rows

VOCABULARY = "dataset string, label string, label_ord int"
LABELS = {
    "deli": ["Cheese", "Blue Cheese", "blue cheese sauce", "C++", "sea-salt", "Seasalt", "x", "Ärger", "-ish", "12"],
    "shop": ["User", "Admin", "Smart Light", "SmartLight", "admin user", "Mobile App"],
}
ANSWERS = [
    "Cheese", " cheese. ", "BLUE  CHEESE", "the blue cheese sauce, please", "bluecheese", "sea salt", "a sea-salt b",
    "C++", "use C++ now", "C", "x y", "ärger", "Ärger!", "green-ish", "-ish", "12", "no 12 here", "chese", "blue cheez",
    "chees sause blu", "", "  \t", None, '"".', "admin", "admin user", "administrator", "smart_light", "the smartlight",
    "mobil app", "user admin", "User/Admin", "adminuser", "Usr", "smart lights on", "xx yy zz", "​", "mobile" * 30,
]


def vocabulary(spark, labels):
    return spark.createDataFrame([(d, l, i) for d, ls in labels.items() for i, l in enumerate(ls)], VOCABULARY)


def answers(spark, texts, labels):
    return spark.createDataFrame(
        [(d, k, t, "kept") for d in labels for k, t in enumerate(texts)], "dataset string, item_id long, raw string, copies string")


@pytest.mark.parametrize("stages", [STAGES, ("exact",), ("scan", "token"), ("fuzzy",)])
def test_same_as_with_labels_in_expressions(spark, stages):
    df = answers(spark, ANSWERS * 2, LABELS)
    want = extract_labels(df, LABELS, stages=stages)
    got = extract_with_table(df, vocabulary(spark, LABELS), stages=stages)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_words_tokens_and_labels_at_random(spark):
    rng = random.Random(5)
    words = ["red", "green", "red-green", "a", "b c", "c", "d_e", "7", "+", "++"]
    labels = {"d": list(dict.fromkeys(" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(40)))}
    texts = [rng.choice(["", "the ", "("]) + rng.choice([" ", "-", "_", ", "]).join(rng.sample(words, rng.randint(1, 5))) for _ in range(150)]
    df = answers(spark, texts, labels)
    assert rows(extract_with_table(df, vocabulary(spark, labels))) == rows(extract_labels(df, labels))


def test_small_blocks_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(lt, "BLOCK_LABELS", 7)
    monkeypatch.setattr(lt, "BLOCK_ANSWERS", 3)
    rng = random.Random(6)
    labels = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 20))) for _ in range(120)]
    labels = list(dict.fromkeys(labels))
    asked = list({"".join(rng.choice("abcde") for _ in range(rng.randint(1, 20))) for _ in range(60)} | set(labels[:5]))
    got = fuzzy_matches(spark.createDataFrame([("d", a) for a in asked], "book string, candidate string"),
                        vocabulary(spark, {"d": labels}), 0.7)
    want = [("d", a, best_label(a, labels, 0.7)) for a in asked]
    assert rows(got) == sorted(w for w in want if w[2] is not None)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_closest_is_the_plain_matcher(threshold):
    rng = random.Random(7)
    draw = lambda: "".join(rng.choice("abcdeföüß 🙂") for _ in range(rng.randint(1, 25)))
    labels = [draw() for _ in range(400)] + ["aaaa", "AAAA".lower(), "abab" * 60]
    asked = [draw() for _ in range(80)] + [l[:-1] + "z" for l in labels[:60]] + ["abab" * 59]
    found = {i: labels[k] for i, _, k in closest(asked, labels, np.arange(len(labels)), threshold)}
    for i, a in enumerate(asked):
        want = best_label(a, labels, threshold)
        assert found.get(i) == want, (a, want)


def test_bound_is_never_below_the_ratio():
    from difflib import SequenceMatcher

    rng = random.Random(8)
    texts = ["".join(rng.choice("abc de") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    signed = lt.Signatures(texts)
    for i, t in enumerate(texts):
        bound = signed.bounds(signed, i)
        assert all(bound[k] >= SequenceMatcher(None, t, u).ratio() or len(t) + len(u) == 0 for k, u in enumerate(texts))


def test_many_labels_few_comparisons(monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(6)) for _ in range(400)]
    labels = list(dict.fromkeys(" ".join(rng.sample(words, 3)) for _ in range(50_000)))
    asked = [l[:8] + "y" + l[9:] for l in labels[::1000]]
    calls = []
    real = lt.SequenceMatcher
    monkeypatch.setattr(lt, "SequenceMatcher", lambda *a: calls.append(1) or real(*a))
    found = closest(asked, labels, np.arange(len(labels)), 0.8)
    assert [labels[k] for _, _, k in found] == labels[::1000]
    assert len(calls) < 5 * len(asked)


def test_keys_of_labels_that_are_written_alike(spark):
    table = key_table(vocabulary(spark, {"d": ["A-B", "ab", "a b", "AB", ""]}))
    got = {(r.kind, r.key): r.label for r in table.collect()}
    assert got == {("as", "a-b"): "A-B", ("as", "ab"): "AB", ("as", "a b"): "a b", ("normal", "ab"): "AB",
                   ("word", "a-b"): "A-B", ("word", "ab"): "ab", ("word", "a b"): "a b", ("token", "ab"): "AB"}


def test_datasets_without_labels_and_empty_tables(spark):
    df = answers(spark, ["Cheese", None], {"deli": 0, "other": 0})
    got = {(r.dataset, r.item_id): (r.pred, r.stage) for r in extract_with_table(df, vocabulary(spark, LABELS)).collect()}
    assert got == {("deli", 0): ("Cheese", "exact"), ("deli", 1): (None, "empty"), ("other", 0): (None, "none"), ("other", 1): (None, "empty")}
    assert extract_with_table(df.limit(0), vocabulary(spark, LABELS)).collect() == []
    assert {r.stage for r in extract_with_table(df, vocabulary(spark, {})).collect()} == {"none", "empty"}


def test_query_over_all_parts_as_the_plain_matcher(spark, sf_dir):
    from kappaloom.plans.queries import kinds_of_part, part_answers, q_extract_part

    labels = sorted(r[0] for r in kinds_of_part(spark, sf_dir).select("gold").distinct().collect())
    golds = {r.item_id: r for r in part_answers(spark, sf_dir).collect()}
    got = {r.item_id: (r.pred, r.stage) for r in q_extract_part(*STAGES)(spark, sf_dir).collect()}
    assert got.keys() == golds.keys() and len(labels) == len(golds)
    read = 0
    for i, r in golds.items():
        want = (r.gold, ("exact", "exact", "scan", "token")[i % 6]) if i % 6 < 4 else (None, "empty")
        if i % 6 == 4:
            pred = best_label(r.raw.lower()[:30], labels, 0.8)
            want, read = (pred, "fuzzy" if pred else "none"), read + (pred == r.gold)
        assert got[i] == want
    assert read > len(golds) / 10


def test_few_labels_stay_in_expressions(spark):
    from kappaloom.plans.experiment import few_labels

    table = vocabulary(spark, {"d": [f"l{i}" for i in range(20)]})
    assert few_labels(table) and few_labels(table, 20) and not few_labels(table, 19)


@pytest.mark.parametrize("most", [1_000, 3])
def test_runs_of_characters_settle_what_the_plain_matcher_says(spark, monkeypatch, most):
    monkeypatch.setattr(lt, "GRAM", 4)
    monkeypatch.setattr(lt, "GRAM_LABELS", most)
    rng = random.Random(10)
    words = ["large", "ring", "bolt", "gear", "größe", "cold"]
    labels = list(dict.fromkeys(f"{rng.choice(words)} {rng.choice(words)} no {rng.randint(1, 400)}" for _ in range(400)))
    labels += ["Cold Ring no 7", "cold ring NO 7"]

    def spoilt(text):
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(text))
            text = text[:i] + rng.choice(["", "x", "no"]) + text[i + rng.randint(0, 1):]
        return text

    asked = sorted({spoilt(l.lower())[:30] for l in labels[::2]} | {"", "no", "cold ring no 7", "zzzz zzzz zzzz"})
    asked_rows = spark.createDataFrame([("d", a) for a in asked], "book string, candidate string")
    want = {a: best_label(a, labels, 0.8) for a in asked}
    settled = {r.candidate: r.label for r in lt.matches_by_grams(asked_rows, vocabulary(spark, {"d": labels}), 0.8).collect()}
    assert settled == {a: want[a] for a in settled} and len(settled) > (len(asked) / 2 if most > 3 else 0)
    got = {r.candidate: r.label for r in fuzzy_matches(asked_rows, vocabulary(spark, {"d": labels}), 0.8).collect()}
    assert got == {a: w for a, w in want.items() if w is not None}


def test_answers_with_a_close_label_are_not_held_against_all_labels(spark, monkeypatch):
    labels = [f"large ring no {i}" for i in range(10_000, 12_000)]
    asked = spark.createDataFrame([("d", f"t{l}") for l in labels[::10]], "book string, candidate string")
    monkeypatch.setattr(lt, "closest", None)  # no block may be compared
    got = {r.candidate: r.label for r in fuzzy_matches(asked, vocabulary(spark, {"d": labels}), 0.8).collect()}
    assert got == {f"t{l}": l for l in labels[::10]}


def test_pieces_travel_without_their_texts(spark):
    df = spark.createDataFrame([(7, "d", "blue cheese sauce")], "answer long, dataset string, cleaned string")
    limits = spark.createDataFrame([("d", 9, 30)], "book string, most int, longest int")
    found = lt.pieces(df, limits, ("exact", "scan", "token"))
    assert dict(found.dtypes) == {"answer": "bigint", "mark": "binary", "place": "int"}
    assert {len(r.mark) for r in found.collect()} == {16}
