"""Label extraction."""

import random
from difflib import SequenceMatcher

import pytest
from plain_rows import rows
from pyspark.sql import functions as F

from kappaloom.functions.fuzzy import best_label
from kappaloom.operators.extract import any_of, extract_labels, stage_audit

LABELS = ["English", "French", "German", "OldEnglish", "PartTimer", "Spanish"]
GOLDEN = [
    (None, None, "empty"), ("", None, "empty"), ("   ", None, "empty"), (" \x1c", None, "empty"),
    ("German", "German", "exact"), ("  GERMAN.  ", "German", "exact"),
    ('"German" .', "German", "exact"), ('"french"', "French", "exact"),
    ("part timer", "PartTimer", "exact"), ("Part-Timer!", "PartTimer", "exact"),
    ("old english", "OldEnglish", "exact"), ("éGerman", "German", "exact"),
    ("The label is: Spanish.", "Spanish", "scan"),
    ("english or OldEnglish", "OldEnglish", "scan"), ("english or german", "English", "scan"),
    ("German\n\nbecause", "German", "scan"), ("French_text", "French", "token"),
    ("so: _spanish_", "Spanish", "token"), ("éGerman it is", "German", "token"),
    ("Germans", "German", "fuzzy"), ("Frensh", "French", "fuzzy"),
    ("PartTimerX", "PartTimer", "fuzzy"), ("Timer", None, "none"), ("Old-Eng", None, "none"),
    ("spanishfrench", None, "none"), ("Klingon", None, "none"), ("...", None, "none"),
]


def run(spark, answers, labels, **options):
    df = spark.createDataFrame(list(enumerate(answers)), "id int, raw string")
    out = extract_labels(df, labels, **options).orderBy("id").collect()
    return [(r["pred"], r["stage"]) for r in out]


def test_golden(spark):
    got = run(spark, [g[0] for g in GOLDEN], LABELS)
    assert list(zip([g[0] for g in GOLDEN], got)) == [(g[0], g[1:]) for g in GOLDEN]


def test_threshold_is_inclusive(spark):
    labels = ["SmartThermostat", "MobileApp", "Sensor"]
    assert run(spark, ["Thermostat", "Mobile"], labels) == [
        ("SmartThermostat", "fuzzy"), ("MobileApp", "fuzzy")]
    assert run(spark, ["Thermostat"], labels, threshold=0.81) == [(None, "none")]


def test_labels_with_special_characters(spark):
    labels = ["C++", "A.B", "x y", "日本", "p|q", r"q\E"]
    answers = ["c++", "use C++ here", "A.B", "AxB now", "it is X  y, yes", "日本", "はい 日本 です", r"a p|q"]
    got = [p for p, _ in run(spark, answers, labels, stages=("exact", "scan"))]
    assert got == ["C++", None, "A.B", None, "x y", "日本", "日本", "p|q"]


def test_word_boundaries_are_unicode_aware(spark):
    assert run(spark, ["die éfrenchy x", "x french² x", "x (French) x"], ["French"],
               stages=("scan",)) == [(None, "none"), (None, "none"), ("French", "scan")]


def test_last_of_equal_normal_forms_wins(spark):
    assert run(spark, ["old english"], ["Old-English", "OldEnglish"]) == [("OldEnglish", "exact")]


def test_datasets_use_their_own_labels(spark):
    df = spark.createDataFrame(
        [("a", "red"), ("b", "red"), ("b", "Circl"), ("a", "Circl"), ("c", "red")],
        "dataset string, raw string")
    got = rows(extract_labels(df, {"a": ["Red"], "b": ["Circle"]}))
    assert got == [("a", "Circl", None, "none"), ("a", "red", "Red", "exact"),
                   ("b", "Circl", "Circle", "fuzzy"), ("b", "red", None, "none"),
                   ("c", "red", None, "none")]


def test_bad_vocabularies():
    with pytest.raises(ValueError):
        extract_labels(None, [])
    with pytest.raises(ValueError):
        extract_labels(None, ["A", ""])


def test_audit_counts(spark):
    df = spark.createDataFrame([("German",), ("German",), ("",), ("zzz",)], "raw string")
    assert rows(stage_audit(extract_labels(df, LABELS), [])) == [
        ("empty", 1), ("exact", 2), ("none", 1)]


def test_fuzzy_parity_with_plain_search(spark):
    rng = random.Random(5)
    alphabet = "abcdeglmnr"
    answers = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    for label in LABELS:
        for _ in range(40):
            chars = list(label.lower())
            for _ in range(rng.randint(1, 3)):
                chars[rng.randrange(len(chars))] = rng.choice(alphabet)
            answers.append("".join(chars))

    def plain(candidate):
        ratios = [SequenceMatcher(None, candidate, l.lower()).ratio() for l in LABELS]
        best = max(ratios)
        return LABELS[ratios.index(best)] if best >= 0.8 else None

    expected = [plain(a) for a in answers]
    assert [best_label(a, LABELS, 0.8) for a in answers] == expected
    got = [p for p, _ in run(spark, answers, LABELS, stages=("fuzzy",))]
    assert got == expected
    assert sum(e is not None for e in expected) > 50


def test_longest_label_of_a_shared_beginning(spark):
    labels = ["Rye", "Rye bread", "Rye-", "bread", "Bread"]
    answers = ["a rye breads", "it is rye bread now", "rye-x bread", "x RYE", "new bread here"]
    assert [p for p, _ in run(spark, answers, labels, stages=("scan",))] == [
        "Rye", "Rye bread", "bread", "Rye", "bread"]


def test_one_pattern_for_many_labels():
    import re
    words = {w: "(?!x)" for w in ("ab", "abc", "b", "abd")}
    pattern = re.sub(r"\\Q(.*?)\\E", lambda m: re.escape(m[1]), any_of(words))
    assert [re.match(pattern, t) and re.match(pattern, t)[0] for t in ("abcx", "abc", "abx", "abd", "bx", "b")] == [
        "ab", "abc", None, "abd", None, "b"]


def test_large_vocabulary(spark):
    import time

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8)).title()
    many = sorted({word() for _ in range(1500)})
    answers = spark.range(20000).select(F.concat(F.lit("It is a "), F.element_at(
        F.array(*map(F.lit, many[:50])), (F.col("id") % 50 + 1).cast("int")), F.lit(" thing")).alias("raw")).cache()
    answers.count()
    seconds = {}
    for size in (50, 1500, 50, 1500):
        start = time.perf_counter()
        out = extract_labels(answers, many[:size], stages=("exact", "scan", "token"))
        assert out.where("stage = 'scan'").count() == 20000
        seconds[size] = time.perf_counter() - start
    assert seconds[1500] < 3 * seconds[50] + 2


def test_distinct_answers_are_read_once_for_all_their_rows(spark, monkeypatch):
    from kappaloom.operators import extract

    texts = ["English", "it is french.", None, "  ", "Germn", "nothing", "ENGLISH"]
    df = spark.createDataFrame(
        [(d, i, texts[i % 7], i) for d in ("a", None) for i in range(140)],
        "dataset string, item_id int, raw string, kept int").withColumn("item_id", F.nullif("item_id", F.lit(3)))
    labels = ["English", "French", "German"]
    want = extract_labels(df, labels)
    real, seen = extract.extract_labels, []

    def counted(rows, *args, **options):
        seen.append(rows.count())
        return real(rows, *args, **options)

    monkeypatch.setattr(extract, "extract_labels", counted)
    for limit in (extract.BROADCAST_BYTES, 0):
        got = extract.extract_distinct(df, labels, limit=limit)
        assert got.columns == want.columns
        assert rows(got) == rows(want)
    assert seen == [14, 14]
    assert extract.extract_distinct(df.limit(0), labels).collect() == []
