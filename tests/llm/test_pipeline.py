"""The pipeline's stages against brute force over what each predecessor kept."""

import re

import pytest
from test_decontaminate import brute as leaks
from test_mixing import targets_of
from test_near_copies import heads
from test_secret_scan import brute as base_spans

import __spark_entry__
import corpus_pipeline as cp
from kappaloom.llm import language_id
from kappaloom.session import materialize


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(materialize(stage(spark, out[-1], sf_dir), name))
    return out


def by_id(df):
    rows = df.collect()
    found = {r.doc_id: r for r in rows}
    assert len(found) == len(rows)
    return found


def test_columns(stages):
    assert all(d.columns == stages[0].columns and d.schema == stages[0].schema for d in stages[1:-1])
    assert stages[-1].columns[:5] == stages[0].columns
    assert [name for name, _ in cp.STAGES] == [
        "language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "mix_sources"]


def test_language(stages):
    model = language_id.train(stages[0].where(language_id.fold() != 0))
    tools = model.compressors()
    want = {i for i, r in by_id(stages[0]).items() if not model.classify(r.text, tools)[2]}
    assert set(by_id(stages[1])) == want and len(want) > 0.97 * stages[0].count()


def test_near_copies(stages):
    rows = sorted((i, r.text) for i, r in by_id(stages[1]).items())
    assert sorted(((i, r.text) for i, r in by_id(stages[2]).items()), key=repr) == heads(rows, similarity=0.8, width=5)


def test_benchmark(spark, sf_dir, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = by_id(stages[2])
    shared = {w for _, t in items for w in t.lower().split()}
    some = [(i, r.text) for i, r in rows.items() if sum(w in shared for w in r.text.lower().split()) > 10]
    bad = {d for d, *_ in leaks(some[:60], items)}
    kept = set(by_id(stages[3]))
    assert not bad & kept and all(i in kept for i, _ in some[:60] if i not in bad)
    assert len(kept) >= 0.9 * len(rows)


def test_secrets(stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    assert set(before) == set(after)
    for i, r in after.items():
        assert not base_spans(r.text) and r.n_chars == len(r.text)
        if not base_spans(before[i].text) and "[SECRET]" not in r.text:
            assert r.text == before[i].text


def test_mix(stages):
    sizes = {}
    docs = by_id(stages[4])
    for r in docs.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    want = targets_of(sizes)
    for r in by_id(stages[5]).values():
        assert r.text == docs[r.doc_id].text and 1 <= r.copies <= 3 and r.taken == r.copies * r.size
        assert r.target == pytest.approx(want[r.source])


def test_run_is_all_stages(spark, sf_dir, stages):
    key = ["doc_id", "taken"]
    assert sorted(map(tuple, cp.run(spark, sf_dir).select(*key).collect())) == sorted(map(tuple, stages[-1].select(*key).collect()))
    assert __spark_entry__.queries()["pipeline"] is cp.run


NAMES = ["cuts", "last", "size", "copies", "target", "taken", "source_size", "_id", "_own", "_sign", "_row", "_key", "fp", "a.b"]


def awkward(spark, rows):
    """documents with null ids, null and empty texts, repeats, and columns of the stages' own names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(
        [(i, t, lang, source, None if t is None else len(t), *[f"{n}!" for n in NAMES]) for i, t, lang, source in rows], schema)


def awkward_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs]
    text = rows[0][1]
    return rows + [
        (None, text + " token=abcdefgh", None, None), (None, text + " token=abcdefgh", None, None), (None, None, None, "s"),
        (9001, None, "en", None), (9002, "", None, "s"), (9003, "1234 5678", "en", "s"), rows[1], rows[1],
        (9004, "secret=abcdefgh " + " ".join(f"word{i}" for i in range(30_000)), "en", "s"),
        (rows[2][0], "another text of that id " + rows[3][1], "en", "s")]


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES], ids=[n for n, _ in cp.STAGES])
def test_stages_keep_awkward_rows_and_columns(spark, sf_dir, stage):
    docs = awkward(spark, awkward_rows(spark, sf_dir))
    got = stage(spark, docs, sf_dir)
    made = ["size", "source_size", "target", "taken", "copies"] if stage is cp.mix else []
    assert sorted(got.columns) == sorted(set(docs.columns) | set(made))
    rows = got.collect()
    assert rows
    for r in rows:
        assert all(r[n] == f"{n}!" for n in NAMES if n not in made)
    ids = [r.doc_id for r in rows]
    if stage is cp.redact_secrets:
        assert len(rows) == docs.count() and sum("[SECRET]" in (r.text or "") for r in rows) >= 3
        assert {r.n_chars for r in rows if r.text is None} == {None}
    if stage is cp.drop_near_copies:
        assert len(set(map(str, rows))) == len(rows) and sum(not r.text for r in rows) == 1
    if stage is cp.identify_language:
        assert all(r.text for r in rows) and 9003 not in ids
    if stage is cp.drop_contaminated:
        assert sum(r.text is None for r in rows) == 2 and 9002 in ids


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES], ids=[n for n, _ in cp.STAGES])
def test_stages_of_an_empty_table(spark, sf_dir, stage):
    got = stage(spark, awkward(spark, []), sf_dir)
    assert got.count() == 0 and set(got.columns) >= {"doc_id", "text", "lang", "source", "n_chars", *NAMES[:2]}


def test_an_empty_benchmark_leaves_everything(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = awkward(spark, awkward_rows(spark, sf_dir))
    assert cp.drop_contaminated(spark, docs, str(tmp_path)).count() == docs.count()
