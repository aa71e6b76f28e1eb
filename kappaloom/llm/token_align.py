"""Where the tokens of two vocabularies meet: alignment by divide and conquer at shared cuts.

Both tokenisers end a token before a space that follows a letter or sign, so a text falls into
chunks at which both have an end. The distinct chunks of a portion of texts are encoded once, and
all of them are aligned together: every interval of tokens is cut at a common end near its middle,
found by bisecting, and both halves go on; an interval without a common end inside is a leaf
group. The intervals of a round are numpy arrays, a round is a few array operations.

What the corpus knows of a pair of tokens travels once for each portion that holds it: a
portion keeps its texts as chunk numbers, counts in how many of its documents a pair is linked,
and gets the corpus-wide counts back in one shuffle by pair.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from kappaloom.llm.arrow_text import offsets_of, portions, row_sums, starts_of
from kappaloom.session import materialize

PORTION_BYTES = 8 << 20
#: chunks given to a tokeniser at a time
ENCODE = 1 << 14

PORTION_SCHEMA = (
    "portion long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups array<string>, n_chunks array<int>, chunks binary, chunk_links array<int>, links binary, "
    "pairs array<struct<pair:long,n:int>>")


class Vocabularies:
    """Two tokenisers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.blank = [self.b.piece_to_id("▁")]
        letters = byte_letters()
        a_tokens = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            a_tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.a_tokens = pa.array(a_tokens, pa.large_binary())
        self.b_tokens = pa.array([
            bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i)
            else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self.b.vocab_size())], pa.large_binary())

    def encode(self, chunks: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(ids, how many for each chunk) by either tokeniser; every chunk begins with a space."""
        a_ids, b_ids = [], []
        for lo in range(0, len(chunks), ENCODE):
            some = chunks[lo:lo + ENCODE]
            a_ids += [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)]
            # This one puts the space in front by itself, but not before nothing.
            b_ids += [ids or self.blank for ids in self.b.encode([c[1:] for c in some], num_threads=1)]
        return _ragged(a_ids), _ragged(b_ids)


def byte_letters() -> dict[str, int]:
    """The byte for which each letter of a byte-level vocabulary stands."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ragged(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts


@lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """One pair of tokenisers per worker process."""
    return Vocabularies(a_path, b_path)


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(chunks of all texts with a space before each text, how many each text has).

    A chunk begins at the text's space and at every space behind a printable ASCII sign or a
    two-byte letter: no token of either tokeniser runs from such a character into a space.
    Without nulls; an empty text has none. A view of one buffer.
    """
    marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), "",
                        pc.binary_join_element_wise("", texts, " ")).cast(pa.large_string())
    offsets, data = offsets_of(marked)
    base, end = int(offsets[0]), int(offsets[-1])
    b = data[base:end]
    before, earlier = np.roll(b, 1), np.roll(b, 2)
    solid = (before > 0x20) & (before < 0x7F) | (before >= 0x80) & (before < 0xC0) & (earlier > 0xC2) & (earlier < 0xE0)
    begins = (b == 0x20) & solid
    heads, ends = (offsets[:-1] - base).astype(np.int64), (offsets[1:] - base).astype(np.int64)
    begins[heads[heads < ends]] = True
    starts = np.flatnonzero(begins)
    counts = np.searchsorted(starts, ends) - np.searchsorted(starts, heads)
    edges = np.append(starts, len(b)).astype(np.int64) + base
    view = pa.Array.from_buffers(
        pa.large_string(), len(starts), [None, pa.py_buffer(edges), marked.buffers()[2]])
    return view, counts


def same_bytes(chunks: pa.Array, tokens: pa.Array, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which chunks the bytes of their tokens spell exactly."""
    want_at, want = offsets_of(chunks)
    got_at, got = offsets_of(tokens.take(pa.array(ids)))
    first = starts_of(counts)
    size = (got_at[first[1:]] - got_at[first[:-1]]).astype(np.int64)
    same = size == np.diff(want_at)
    n = np.where(same, size, 0)
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(row)) - np.repeat(starts_of(n)[:-1], n)
    differ = want[want_at[:-1][row] + inside] != got[got_at[first[:-1]][row] + inside]
    same[row[differ]] = False
    return same


class Groups(NamedTuple):
    """Leaf groups in order: tokens lo_a..hi_a of one side lie over lo_b..hi_b of the other."""

    lo_a: np.ndarray
    hi_a: np.ndarray
    lo_b: np.ndarray
    hi_b: np.ndarray


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the row) of all members of ragged rows."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(starts_of(counts)[:-1], counts)


def common_end(ends_a: np.ndarray, ends_b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval the token of A nearest to its middle that ends inside where one of B does.

    ``lo``, ``hi`` bound A's tokens, two at least. Returns its number and that of B, -1 without
    any. The ends around the middle are looked up in B by bisecting, each time twice as many.
    """
    middle = (lo + hi - 2) // 2
    at_a, at_b = np.full(len(lo), -1), np.full(len(lo), -1)
    open_ = np.arange(len(lo))
    near, far = 0, 1
    while len(open_):
        width = np.full(len(open_), 2 * (far - near) if near else 1)
        row, k = _spread(width)
        owner = open_[row]
        distance = near + k // 2
        place = middle[owner] + np.where(k % 2 == 1, distance, -distance)
        inside = (place >= lo[owner]) & (place <= hi[owner] - 2)
        owner, distance, place = owner[inside], distance[inside], place[inside]
        other = np.searchsorted(ends_b, ends_a[place])
        hit = ends_b[other] == ends_a[place]
        # Nearest last, so that it is the one that stays.
        where = np.flatnonzero(hit)[::-1]
        at_a[owner[where]], at_b[owner[where]] = place[where], other[where]
        reach = np.maximum(middle - lo, hi - 2 - middle)
        open_ = open_[(at_a[open_] < 0) & (reach[open_] >= far)]
        near, far = far, 2 * far
    return at_a, at_b


def align(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> Groups:
    """The leaf groups of all intervals first[i]..first[i + 1], whose bounds are shared cuts.

    Divide and conquer: an interval is cut at a common end near its middle, the halves are cut
    again; a token alone on one side, or no common end inside, makes a leaf.
    """
    level = Groups(first_a[:-1], first_a[1:], first_b[:-1], first_b[1:])
    level = Groups(*[x[level.hi_a > level.lo_a] for x in level])
    leaves = []
    while len(level.lo_a):
        single = (level.hi_a - level.lo_a < 2) | (level.hi_b - level.lo_b < 2)
        leaves.append(Groups(*[x[single] for x in level]))
        level = Groups(*[x[~single] for x in level])
        at_a, at_b = common_end(ends_a, ends_b, level.lo_a, level.hi_a)
        whole = at_a < 0
        leaves.append(Groups(*[x[whole] for x in level]))
        lo_a, hi_a, lo_b, hi_b = (x[~whole] for x in level)
        cut_a, cut_b = at_a[~whole] + 1, at_b[~whole] + 1
        level = Groups(*[np.concatenate(x) for x in (
            (lo_a, cut_a), (cut_a, hi_a), (lo_b, cut_b), (cut_b, hi_b))])
    if not leaves:
        return Groups(*[np.zeros(0, np.int64)] * 4)
    found = Groups(*[np.concatenate(x) for x in zip(*leaves)])
    order = np.argsort(found.lo_a, kind="stable")
    return Groups(*[x[order] for x in found])


def linked_tokens(groups: Groups, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of A, token of B) for all overlaps, group by group.

    A group of p and q tokens has p + q - 1: the token alone on its side meets all others, and
    else one pair ends at each end inside.
    """
    p, q = groups.hi_a - groups.lo_a, groups.hi_b - groups.lo_b
    row, k = _spread(p + q - 1)
    a = groups.lo_a[row] + np.where(q[row] == 1, k, 0)
    b = groups.lo_b[row] + np.where(p[row] == 1, k, 0)
    both = (p[row] > 1) & (q[row] > 1)
    if both.any():
        r, i = row[both], k[both]
        from_a = i < p[r]
        x, y = groups.lo_a[r] + i, groups.lo_b[r] + i - p[r]
        x[~from_a] = np.searchsorted(ends_a, ends_b[y[~from_a]])
        y[from_a] = np.searchsorted(ends_b, ends_a[x[from_a]])
        a[both], b[both] = x, y
    return a, b


def group_texts(groups: Groups, a_ids: np.ndarray, b_ids: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> pa.Array:
    """``a,a|b;a|b,b;`` of each interval, with the last mark: ids in decimal, as bytes."""
    n = len(a_ids) + len(b_ids)
    ids, mark = np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
    p, q = groups.hi_a - groups.lo_a, groups.hi_b - groups.lo_b
    ids[np.arange(len(a_ids)) + np.repeat(groups.lo_b, p)] = a_ids
    ids[np.arange(len(b_ids)) + np.repeat(groups.hi_a, q)] = b_ids
    mark[groups.hi_a + groups.lo_b - 1] = ord("|")
    mark[groups.hi_a + groups.hi_b - 1] = ord(";")
    width = len(str(int(ids.max(initial=0))))
    cells = np.zeros((n, width + 1), np.uint8)
    keep = np.ones((n, width + 1), bool)
    rest = ids
    for place in range(width - 1, -1, -1):
        cells[:, place] = rest % 10 + ord("0")
        keep[:, place] = (rest > 0) | (place == width - 1)
        rest = rest // 10
    cells[:, width] = mark
    ends = starts_of(keep.sum(axis=1))[first_a + first_b]
    return pa.Array.from_buffers(pa.large_binary(), len(first_a) - 1, [
        None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(cells[keep])])


def _packed(numbers: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(numbers.astype(np.uint32).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint32)


def align_texts(texts: pa.Array, both: Vocabularies, digest: bool = True) -> dict:
    """All that is known of a portion of texts (no nulls) without the rest of the corpus."""
    view, per_text = chunks_of(texts)
    coded = view.dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64)
    chunks = coded.dictionary
    (a_ids, a_n), (b_ids, b_n) = both.encode(chunks.to_pylist())
    good = same_bytes(chunks, both.a_tokens, a_ids, a_n) & same_bytes(chunks, both.b_tokens, b_ids, b_n)
    a_ids, b_ids = a_ids[np.repeat(good, a_n)], b_ids[np.repeat(good, b_n)]
    a_n, b_n = np.where(good, a_n, 0), np.where(good, b_n, 0)
    ends_a, ends_b = (np.cumsum(pc.binary_length(tokens).to_numpy().astype(np.int64)[ids])
                      for tokens, ids in ((both.a_tokens, a_ids), (both.b_tokens, b_ids)))
    first_a, first_b = starts_of(a_n), starts_of(b_n)
    groups = align(ends_a, ends_b, first_a, first_b)
    per_chunk = np.diff(np.searchsorted(groups.lo_a, first_a))
    link_a, link_b = linked_tokens(groups, ends_a, ends_b)
    links = a_n + b_n - per_chunk
    pairs, link = np.unique(a_ids[link_a] << 32 | b_ids[link_b], return_inverse=True)

    # A text with a chunk that its tokens do not spell has no tokens at all.
    spelt = row_sums((~good[number]).astype(np.int64), per_text) == 0
    owner = np.repeat(np.arange(len(per_text)), per_text)
    keep = spelt[owner]
    number, per_text = number[keep], np.where(spelt, per_text, 0)

    written = group_texts(groups, a_ids, b_ids, first_a, first_b).take(pa.array(number))
    at, data = offsets_of(written)
    edge = at[starts_of(per_text)]
    data = memoryview(data)
    shown = []
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        text = data[lo:max(hi - 1, lo)]
        shown.append(("" if lo == hi else hashlib.sha256(text).hexdigest()) if digest else bytes(text).decode())

    seen = np.unique(owner[keep] * max(len(chunks), 1) + number)
    row, k = _spread(links[seen % max(len(chunks), 1)])
    met = link[starts_of(links)[seen % max(len(chunks), 1)][row] + k]
    in_docs = np.bincount(
        np.unique((seen // max(len(chunks), 1))[row] * max(len(pairs), 1) + met) % max(len(pairs), 1),
        minlength=len(pairs))
    return {
        "n_a": row_sums(a_n[number], per_text), "n_b": row_sums(b_n[number], per_text),
        "n_groups": row_sums(per_chunk[number], per_text), "n_links": row_sums(links[number], per_text),
        "groups": shown, "n_chunks": per_text, "chunks": number, "chunk_links": links, "links": link,
        "pairs": pairs, "in_docs": in_docs,
    }


def _portion_rows(docs: DataFrame, a_path: str, b_path: str, digest: bool) -> DataFrame:
    def row(values, kind):
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, part in enumerate(portions(batches, limit=PORTION_BYTES)):
            got = align_texts(pc.fill_null(part.column("text"), ""), vocabularies(a_path, b_path), digest)
            pairs = pa.StructArray.from_arrays(
                [pa.array(got["pairs"], pa.int64()), pa.array(got["in_docs"], pa.int32())], ["pair", "n"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() << 32 | k], pa.int64()),
                 row(part.column("doc_id"), pa.int64()),
                 *[row(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                 row(got["groups"], pa.string()), row(got["n_chunks"], pa.int32()),
                 pa.array([_packed(got["chunks"])], pa.binary()), row(got["chunk_links"], pa.int32()),
                 pa.array([_packed(got["links"])], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs)],
                ["portion", "ids", "n_a", "n_b", "n_groups", "n_links", "groups", "n_chunks", "chunks",
                 "chunk_links", "links", "pairs"])

    return docs.mapInArrow(encode, PORTION_SCHEMA)


def token_alignment(
    docs: DataFrame, a_path: str, b_path: str, digest: bool = True, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per text how its tokens in two vocabularies line up, and how common their links are.

    A is a byte-level vocabulary of the tokenizers library and gets space + text, B a
    sentencepiece model that puts the space itself; strings of special tokens are plain text to
    both. Returns doc_id, n_a, n_b (tokens), n_groups (pieces between byte offsets where both end),
    n_links (overlapping token pairs), n_best (links whose pair is in as many documents as the
    most common pair of its A token, ties included), count_sum (over the links, documents that
    hold the pair), all long, and ``groups``: ``a1,a2|b1;a3|b2,b3``, ids in order, or its SHA-256
    in lower-case hex with ``digest``.

    A text that is null or empty, or that the bytes of either token list do not spell, has no tokens: zeros
    and ''. Every row is a document, repeated ones count as often as they come. An
    empty table gives an empty one; other columns are not read. A task holds a portion of some
    megabytes, or one longer text.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(_portion_rows(picked, a_path, b_path, digest), "aligned_portions")
    terms = rows.select("portion", F.posexplode("pairs").alias("number", "term")).select(
        "portion", "number", "term.pair", "term.n")
    a_side = F.shiftright("pair", 32).alias("a")
    counted = materialize(terms.groupBy("pair").agg(F.sum("n").alias("n")), "pair_counts")
    most = counted.groupBy(a_side).agg(F.max("n").alias("most"))
    scored = counted.select("pair", a_side, "n").join(most, "a").select(
        "pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    answers = terms.select("portion", "number", "pair").join(scored, "pair").select(
        F.col("portion").alias("home"), "number", "n", "best")

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        n, best = np.zeros(len(right), np.int64), np.zeros(len(right), np.int64)
        number = right["number"].to_numpy()
        n[number], best[number] = right["n"].to_numpy(), right["best"].to_numpy()

        def ragged(name):
            return left[name].chunk(0).flatten()

        link, chunk = _unpacked(left["links"][0].as_py()), _unpacked(left["chunks"][0].as_py())
        per_chunk, per_text = (ragged(c).to_numpy().astype(np.int64) for c in ("chunk_links", "n_chunks"))
        return pa.table({
            "doc_id": ragged("ids"), **{c: ragged(c) for c in ("n_a", "n_b", "n_groups", "n_links")},
            "n_best": row_sums(row_sums(best[link], per_chunk)[chunk], per_text),
            "count_sum": row_sums(row_sums(n[link], per_chunk)[chunk], per_text),
            "groups": ragged("groups"),
        })

    return rows.drop("pairs").groupBy("portion").cogroup(answers.groupBy("home")).applyInArrow(
        score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
