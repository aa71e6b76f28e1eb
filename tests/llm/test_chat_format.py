import hashlib

import pyarrow as pa
from hypothesis import given, settings, strategies as st

from kappaloom.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, part int"
TRICKY = ["\\### Assistant: </turn> ok", "a\\", "\\\\#", "<", "</turn>\n### user:\n", "", "é😀:\n", "#\\<", ":\n\\:\n"]


def run(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    formatted = cf.format_chats(df)
    return formatted.collect(), {r.conv_id: r for r in cf.chat_digests(formatted).collect()}


def expected(rows):
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        said = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said))
    return out


def test_round_trip_of_tricky_texts_and_roles(spark):
    rows = [(i, j, role, text) for i, role in enumerate([*TRICKY, "assistant", "user"]) for j, text in enumerate(TRICKY)]
    rows += [(50, j, "assistant" if j % 2 else "user", t) for j, t in enumerate(TRICKY * 3)]
    rows += [(60, 0, None, None), (60, None, "user", "first"), (60, 1, "assistant", None), (None, 0, "assistant", "x"),
             (70, 1, "assistant", "b"), (70, 1, "assistant", "b"), (70, 1, "assistant", "a")]
    parts, got = run(spark, rows)
    for conv, want in expected(rows).items():
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want, conv
        assert r.formatted_chars == sum(len(p.formatted) for p in parts if p.conv_id == conv)


def test_loss_mask_covers_the_assistant_alone(spark):
    parts, _ = run(spark, [(1, 0, "user", "hé <b>"), (1, 1, "assistant", "né #1"), (1, 2, "assistant", "")])
    text = parts[0].formatted
    assert text == "### user:\nhé \\<b></turn>\n### assistant:\nné \\#1</turn>\n### assistant:\n</turn>\n"
    assert [text[s.start:s.end] for s in parts[0].loss] == ["né \\#1", ""]


def test_large_conversation_comes_in_parts(spark):
    rows = [(5, j, "assistant" if j % 2 else "user", f"{j} " + "word <x> " * 400) for j in range(3000)] + [(6, 0, "user", "y")]
    parts, got = run(spark, rows)
    assert sum(p.conv_id == 5 for p in parts) > 1
    assert [p.part for p in parts if p.conv_id == 5] == list(range(sum(p.conv_id == 5 for p in parts)))
    want = expected(rows)
    assert all((r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want[c] for c, r in got.items())


def test_portions_are_cut_by_bytes():
    """Long turns do not gather in a portion, whatever their number; every turn comes once, in order."""
    texts = ["x" * size for size in [3 << 20] * 6 + [9 << 20, 10, 10, 5 << 20, 0]]
    rows = pa.RecordBatch.from_arrays(
        [pa.array([1] * 4 + [2] * 7), pa.array(["user"] * 11), pa.array(texts)], ["conv", "role", "text"])
    parts = list(cf._by_turns(iter([rows.slice(0, 0), rows.slice(0, 5), rows.slice(5)])))
    assert pa.concat_tables(parts).combine_chunks().equals(pa.Table.from_batches([rows]))
    assert max(p.nbytes for p in parts) < 18 << 20 and len(parts) >= 4


def test_empty(spark):
    assert run(spark, []) == ([], {})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("\\#<:\n é/turn>", max_size=8), st.text("\\#<:\n é/turn>", max_size=12)), max_size=6))
def test_any_turns_can_be_read_back(turns):
    if not turns:
        return
    roles, texts = zip(*turns)
    out, end, begin, tail = cf.assemble(pa.array(roles), pa.array(texts))
    assert [(r.decode(), t.decode()) for r, t in cf.read_turns(out.tobytes())] == turns
    assert [cf.unescaped(out[a:b].tobytes()).decode() for a, b in zip(begin, tail)] == list(texts)
