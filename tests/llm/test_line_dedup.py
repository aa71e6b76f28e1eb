"""Line dedup against a plain version, and its defined results at the edges."""

from collections import defaultdict

import pytest

from kappaloom.llm.line_dedup import drop_common_lines

BLANKS = " \t\n\x0b\x0c\r"


def plain(rows, min_docs, min_chars):
    """(id, text, n_lines, n_dropped) by dictionaries; a document is its id or else its text."""
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))

    seen = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            seen[key(line)].add(("id", i) if i is not None else ("text", text or ""))
    common = {k for k, docs in seen.items() if len(docs) >= min_docs and len(k) >= min_chars}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in common]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def found(docs, **options):
    got = drop_common_lines(docs, **options).select("doc_id", "text", "n_lines", "n_dropped")
    return sorted((tuple(r) for r in got.collect()), key=repr)


ROWS = [
    (1, "Home\nown text\n \tHOME \x0b\nlast"),
    (2, "home"),
    (3, "\nhome\n\n"),
    (4, "Ärger\närger\nhome\r\nmore"),
    (5, "ÄRGER\nhome x"),
    (6, None),
    (7, ""),
    (8, "ärger\nown"),
    (8, "ärger\nown"),
    (8, "another row of eight\nhome"),
    (None, "no id\nhome"),
    (None, "no id\nhome"),
    (None, "no id, another text\närger\n."),
    (9, "twice\ntwice\ntwice"),
    (10, "a" * 70_000 + "\nhome\n" + "b\n" * 5_000),
]


@pytest.mark.parametrize("min_docs, min_chars", [(1, 1), (2, 0), (3, 5), (9, 1)])
def test_as_the_plain_version(docs_of, min_docs, min_chars):
    assert found(docs_of(ROWS), min_docs=min_docs, min_chars=min_chars) == plain(ROWS, min_docs, min_chars)


def test_rows_of_one_id_are_one_document(docs_of):
    rows = [(1, "same")] * 20 + [(1, f"same\n{i}") for i in range(20)]
    assert found(docs_of(rows), min_docs=2) == plain(rows, 2, 1)
    assert all(r[3] == 0 for r in found(docs_of(rows), min_docs=2))


def test_other_letters_keep_their_case(docs_of):
    rows = [(i, "İÄ") for i in range(3)] + [(9, "iä")]
    assert [r[3] for r in found(docs_of(rows), min_docs=3)] == [1, 1, 1, 0]


def test_a_hot_line_is_dropped_everywhere(docs_of):
    rows = [(i, f"Hot\nown {i}\nhot ") for i in range(3_000)]
    assert found(docs_of(rows)) == plain(rows, 10, 1)


def test_empty_table(docs_of):
    assert found(docs_of([])) == []


def test_clashing_columns_stay(spark):
    names = ["_key", "_pos", "_doc", "_text", "_row", "_gone", "_lines", "_own", "_id", "_n", "_salt", "a.b"]
    rows = [(i, "x\nown", "old", *[f"{n}{i}" for n in names]) for i in range(10)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "n_lines", *names])
    got = drop_common_lines(docs).orderBy("doc_id").collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "n_lines", *names, "n_dropped"}
    for r in got:
        assert (r["text"], r["n_lines"], r["n_dropped"]) == ("", 2, 2)
        assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names]


def test_plan_has_no_python(spark, sf_dir):
    from kappaloom.llm.queries import op11_line_dedup

    plan = op11_line_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


def test_repeats_without_own_lines_leave_nothing(docs_of):
    assert found(docs_of([(i, "a\nb") for i in range(10)])) == [(i, "", 2, 2) for i in range(10)]
