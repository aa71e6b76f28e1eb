import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from kappaloom.llm import secret_scan as ss

BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24))


def brute(text):
    spans = []
    for k, (_, pattern, least) in enumerate(BASE):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[1] if k == 0 else m[0]) >= least:
                spans.append((m.start(), k, m.end()))
    return ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(spans))


TEXTS = [
    None, "", "password=abc", "PassWord : 'abcdef'", "secret=token: abcdef1", "token=token=abcdef", "é😀 api_key = \"x/y+z==\" end",
    "AKIA" + "A" * 16, "AKIA" + "A" * 15, "AKIAAKIA" + "0" * 15, "x" + "0f" * 12 + "y", "0f" * 11, "0f" * 300,
    "apikey=abcdefgh" + "ab12" * 8 + "token=zzzzzzz", "paſſword=abcdef", "toKen=abcdef",
    "token=abcdef " * 500, "a" * 5000 + " secret=abcdefg",
]


def test_base_spans_against_brute_force(docs_of):
    got = {r.doc_id: r for r in ss.secret_report(docs_of(list(enumerate(TEXTS)))).collect()}
    for i, text in enumerate(TEXTS):
        want = brute(text)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [want.count(k) for k, *_ in BASE]
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))


def random_token(rnd, n):
    return "".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(n))


def test_random_runs_are_added_and_ordinary_ones_are_not(docs_of):
    rnd = random.Random(5)
    keys = [random_token(rnd, 48) for _ in range(20)]
    plain = ["release-notes-for-version-2024-final", "internal/service/account/settings2/report",
             "550e8400-e29b-41d4-a716-446655440000", "zzzzzzzzzzzzzzzzzzzzzzzzzzzz1", "12345678901234567890123",
             "QuarterlyReportForTheInternalService2021"] * 10
    rows = [(i, f"see {k} here") for i, k in enumerate(keys)]
    rows += [(100 + i, f"see {k} here") for i, k in enumerate(plain)]
    got = {r.doc_id: r.spans for r in ss.secret_report(docs_of(rows)).collect()}
    found = [i for i in range(20) if got[i] == "random:4:52"]
    assert len(found) >= 17
    assert not any(got[100 + i] for i in range(len(plain)))


def test_length_counts(spark):
    rnd = random.Random(6)
    rows = [(random_token(rnd, n), n) for n in (20, 80) for _ in range(40)]
    runs = ss.battery(spark.createDataFrame(rows, "token string, n long"))
    p = {r.n: r.p for r in runs.groupBy("n").agg(F.max("p_text").alias("p")).collect()}
    assert p[80] < p[20] and runs.where("p_random < 0.001").count() <= 2


def test_runs_that_touch_a_base_span_are_left_out(docs_of):
    key = random_token(random.Random(7), 60)
    rows = [(i, f"token={key}") for i in range(5)]
    assert all(r.n_random == 0 and r.n_assign == 1 for r in ss.secret_report(docs_of(rows)).collect())


def test_redaction(docs_of):
    rows = [(1, "é token=abcdefg end"), (2, "clean"), (3, None), (4, "x " + "0a" * 12), (1, "é token=abcdefg end"),
            (5, "secret=" + "0a" * 20 + " token=zzzzzz"), (None, "password=abcdefg!")]
    got = sorted((r.doc_id or 0, r.text, r.n_chars, r.fp) for r in ss.redact(docs_of(rows)).collect() if r.text)
    assert got == [(0, "[SECRET]!", 9, 0), (1, "é [SECRET] end", 14, 0), (1, "é [SECRET] end", 14, 0), (2, "clean", 5, 0),
                   (4, "x [SECRET]", 10, 0), (5, "[SECRET] [SECRET]", 17, 0)]


def test_empty(docs_of):
    assert ss.secret_report(docs_of([])).count() == 0 and ss.redact(docs_of([])).count() == 0


def test_main_path_is_native(docs_of):
    plan = ss.secret_report(docs_of([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("pattern,alphabet", ss.ENCODINGS)
def test_alphabets_have_distinct_symbols(pattern, alphabet):
    assert len(set(alphabet)) == len(alphabet) and re.search(pattern, alphabet)


def test_battery_and_discoveries_against_sql(docs_of):
    import duckdb
    import pandas as pd
    from oracle import differences

    from kappaloom.llm.oracles import ORACLES

    rnd = random.Random(9)
    alphabets = (string.ascii_letters + string.digits, string.digits + "abcdef", string.ascii_uppercase + "234567",
                 string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/-_")
    texts = [t for t in TEXTS]
    for _ in range(150):
        al = rnd.choice(alphabets)
        texts.append("é " + "".join(rnd.choice(al) for _ in range(rnd.randint(15, 70))) + rnd.choice([" end", "", ", token=abcdef"]))
        texts.append("-".join(rnd.choice("release notes for version internal settings".split()) for _ in range(5)) + "7")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    report = ss.secret_report(docs_of(list(enumerate(texts))))
    assert differences(report, con, ORACLES["op3_secret_scan"]) == []
    assert report.where("n_random > 0").count() > 30


ALPHABETS = {
    "base62": string.ascii_letters + string.digits, "lower": string.ascii_lowercase + string.digits,
    "letters": string.ascii_lowercase, "mixed letters": string.ascii_letters, "base32": string.ascii_uppercase + "234567",
}


def slugs(rnd, n):
    """Ordinary long runs: titles, paths, names in camel case, words run together, with numbers and years."""
    words = ("annual report release notes version internal settings service account user data table index quarterly "
             "summary image header footer green mountain river customer order invoice payment monthly weather station "
             "Donau schiff fahrt gesellschaft bibliothek entreprise developpement ventana biblioteca").split()
    out = []
    while len(out) < n:
        ws = [rnd.choice(words) for _ in range(rnd.randint(3, 7))]
        kind = rnd.randrange(5)
        run = ("-".join(ws), "/".join(ws), "".join(w.title() for w in ws), "_".join(ws).upper(), "".join(ws))[kind]
        run += rnd.choice(["", "", str(rnd.randint(1, 9)), f"-{rnd.randint(1990, 2030)}", f"_v{rnd.randint(1, 20)}"])
        if len(run) >= 20:
            out.append(run)
    return out


def test_recall_beside_thousands_of_ordinary_runs(docs_of):
    rnd = random.Random(11)
    keys = [(name, n, "".join(rnd.choice(alphabet) for _ in range(n)))
            for name, alphabet in ALPHABETS.items() for n in (20, 24, 32, 40) for _ in range(150)]
    plain = slugs(rnd, 5_000)
    rows = [(i, f"see {k} here") for i, (_, _, k) in enumerate(keys)] + [(100_000 + i, f"see {k} here") for i, k in enumerate(plain)]
    got = {r.doc_id: r.n_random for r in ss.secret_report(docs_of(rows)).select("doc_id", "n_random").collect()}
    found = {}
    for i, (name, n, _) in enumerate(keys):
        found.setdefault((name, n), []).append(got[i])
    recall = {k: sum(v) / len(v) for k, v in found.items()}
    false = sum(got[100_000 + i] for i in range(len(plain)))
    print(recall, false)
    assert false <= 0.01 * len(plain)
    assert all(r >= 0.9 for (name, n), r in recall.items() if name in ("base62", "lower", "mixed letters", "base32"))
    assert all(r >= 0.9 for (name, n), r in recall.items() if name == "letters" and n >= 32)


def test_recall_of_a_few_keys_alone(docs_of):
    rnd = random.Random(12)
    rows = [(i, f"key {random_token(rnd, 20 + i % 3)}.") for i in range(100)]
    assert sum(r.n_random for r in ss.secret_report(docs_of(rows)).collect()) >= 90
