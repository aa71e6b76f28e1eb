"""Removal of repeated passages, found by super-k-mer partitioning.

A window is ``span`` consecutive words. Its minimiser is the smallest hash among the
``gram``-word sequences in it. Consecutive windows of a document with the same minimiser form
a super-k-mer, which belongs to that minimiser's bucket; equal windows always meet there.

1. Every super-k-mer sends its place and a 64-bit hash of its words to its bucket. Of those that
   are alike as a whole all but the earliest are repeats; one that is alone in its bucket has
   no equal window elsewhere.
2. What is left, different super-k-mers of one bucket, travels there as packed strings, and
   sorting the windows of a bucket tells which of them occurs earlier elsewhere.
3. The repeated windows return to their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from kappaloom.llm.arrow_text import offsets_of, portions, starts_of, words
from kappaloom.llm.xxh64 import xxh64_slices
from kappaloom.session import materialize

#: rows of a bucket above which its windows get buckets of their own ...
HOT_ROWS = 20_000
#: ... and at most so many buckets can be that hot, as the share of all rows grows along
HOT_BUCKETS = 1_000_000
BUFFER_BYTES = 4 << 20
LAST_ID = (1 << 63) - 1
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_STEP_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))

PLACE_SCHEMA = "bucket long, mark long, doc long, sign long, start int, n int, twice boolean"
SUPER_SCHEMA = "bucket long, packed string, doc long, sign long, start int"
SPAN_SCHEMA = "doc long, sign long, start int, n int"
FOUND_SCHEMA = f"{SPAN_SCHEMA}, open boolean, bucket long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _PRIME
    return x ^ (x >> np.uint64(29))


def _word_hashes(flat: pa.Array) -> np.ndarray:
    """XXH64 of every word, computed once for each distinct one."""
    coded = flat.dictionary_encode()
    offsets, data = offsets_of(coded.dictionary)
    hashes = xxh64_slices(data.tobytes(), offsets[:-1], offsets[1:])
    return hashes[coded.indices.to_numpy()]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _STEP), np.full(n, _STEP_BACK)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive values, from prefix sums modulo 2^64."""
    up, down = _powers(len(values))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up, dtype=np.uint64)])
    return _mix((total[width:] - total[:-width]) * down[:len(values) - width + 1])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def _spaced(flat: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one space behind each, and where each begins and ends."""
    offsets, data = offsets_of(flat)
    n = np.diff(offsets).astype(np.int64)
    out = np.full(int(n.sum()) + len(flat), 0x20, np.uint8)
    place = np.arange(int(n.sum())) + np.repeat(np.arange(len(flat)), n)
    out[place] = data[offsets[0]:offsets[-1]]
    begin = (offsets[:-1] - offsets[0]).astype(np.int64) + np.arange(len(flat))
    return out.tobytes(), begin, begin + n


class SuperKmers:
    """The super-k-mers of one portion of texts, as ragged arrays.

    ``first`` and ``last`` are the first words of their first and last window.
    """

    def __init__(self, texts: pa.Array, span: int, gram: int):
        self.span = span
        self.flat, counts = words(texts)
        self.doc_start = starts_of(counts)[:-1]
        self.owner = self.first = self.last = np.zeros(0, np.int64)
        self.bucket = self.hashes = np.zeros(0, np.uint64)
        self.twice = np.zeros(0, bool)
        if len(self.flat) < span:
            return
        self.hashes = _word_hashes(self.flat)
        grams = _rolling(self.hashes, gram)
        low = _sliding_min(grams, span - gram + 1)
        windows = np.maximum(counts - span + 1, 0)
        at = np.repeat(self.doc_start - starts_of(windows)[:-1], windows) + np.arange(windows.sum())
        owner = np.repeat(np.arange(len(counts)), windows)
        bucket = low[at]
        new = np.ones(len(at), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])
        cut = np.flatnonzero(new)
        self.owner, self.bucket, self.first = owner[cut], bucket[cut], at[cut]
        self.last = at[np.append(cut[1:], len(at))[:len(cut)] - 1]
        # A window can only be repeated inside its own super-k-mer if the minimiser comes again
        # before a window has passed.
        again = np.zeros(len(grams), bool)
        for j in range(1, span - gram + 2):
            again[j:] |= grams[j:] == grams[:-j]
        seen = starts_of(again.astype(np.int64))
        self.twice = seen[self.last + span - gram + 1] > seen[self.first]

    def marks(self) -> np.ndarray:
        """A hash of all words of each super-k-mer."""
        up, down = _powers(len(self.hashes))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * up, dtype=np.uint64)])
        size = self.last + self.span - self.first
        return _mix((total[self.last + self.span] - total[self.first]) * down[self.first] + size.astype(np.uint64))

    def start(self) -> np.ndarray:
        return (self.first - self.doc_start[self.owner]).astype(np.int32)


def _earliest(code: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each row the row with the same code that has the smallest (doc, start)."""
    order = np.lexsort((start, doc, code))
    head = np.concatenate([[True], code[order[1:]] != code[order[:-1]]])
    group = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    out = np.empty(len(order), np.int64)
    out[order] = order[group]
    return out


def _places(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """Places of the super-k-mers of ``docs`` (doc, sign, text).

    Of those of a portion that are alike only the earliest goes to its bucket; the others are
    repeats, say so by a negative ``n``, and go anywhere.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            part = _one_of_each_text(part)
            found = SuperKmers(part.column("text"), span, gram)
            if not len(found.first):
                continue
            doc = part.column("doc").to_numpy()[found.owner]
            sign = part.column("sign").to_numpy()[found.owner]
            start, mark = found.start(), found.marks()
            n = (found.last - found.first + 1).astype(np.int32)
            head = _earliest(mark ^ _mix(found.bucket), doc, start)
            later = (doc[head] < doc) | ((doc[head] == doc) & (start[head] < start))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.where(later, _mix(doc.view(np.uint64)), found.bucket).view(np.int64)),
                pa.array(mark.view(np.int64)), pa.array(doc), pa.array(sign), pa.array(start),
                pa.array(np.where(later, -n, n)), pa.array(found.twice)],
                ["bucket", "mark", "doc", "sign", "start", "n", "twice"])

    return docs.mapInArrow(split, PLACE_SCHEMA)


def _one_of_each_text(part: pa.RecordBatch) -> pa.RecordBatch:
    """The portion with one row for each (doc, sign): repeats of a row are one place."""
    doc, sign = part.column("doc").to_numpy(), part.column("sign").to_numpy()
    order = np.lexsort([sign, doc])
    again = (doc[order[1:]] == doc[order[:-1]]) & (sign[order[1:]] == sign[order[:-1]])
    if not again.any():
        return part
    return part.take(pa.array(np.sort(order[np.concatenate([[True], ~again])])))


def _meet(places: DataFrame) -> DataFrame:
    """(doc, sign, start, n, open, bucket): known repeats, and with ``open`` what needs its words.

    The rows of a bucket stream in order of (mark, doc, start): the first of a mark is the
    earliest, and it stays open where its bucket has another mark or it may repeat itself.
    Rows of repeated texts are one place and lie side by side: one of them goes on.
    """
    order = ["bucket", "mark", "doc", "start", "sign"]
    dealt = places.repartition("bucket").sortWithinPartitions(*order)

    names = places.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the last mark so far that may still turn out open: its first
        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if held is not None:
                rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
            fresh = np.ones(len(rows["n"]), bool)
            fresh[1:] = np.any([rows[c][1:] != rows[c][:-1] for c in (*order, "n")], axis=0)
            rows = {c: values[fresh] for c, values in rows.items()}
            bucket, mark, n = rows["bucket"], rows["mark"], rows["n"]
            known = n < 0
            live = np.flatnonzero(~known)
            b, m = bucket[live], mark[live]
            new = np.ones(len(live), bool)
            new[1:] = (b[1:] != b[:-1]) | (m[1:] != m[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(live)), 0)) if len(live) else live
            d, s = rows["doc"][live], rows["start"][live]
            repeat = (d[head] < d) | ((d[head] == d) & (s[head] < s))
            known[live[repeat]] = True
            first = np.flatnonzero(new)
            more = np.zeros(len(first), bool)
            same = b[first[1:]] == b[first[:-1]]
            more[1:] |= same
            more[:-1] |= same
            if held is not None and held["open"][0] and len(first):
                more[0] = True
            # Equal rows of one document are the same place; each keeps its state.
            more |= rows["twice"][live][first]
            state = more[np.searchsorted(first, head)] if len(live) else np.zeros(0, bool)
            ready = ~repeat
            if len(live):
                ready &= head != head[-1]
            out = np.concatenate([np.flatnonzero(known), live[ready & state]])
            is_open = np.concatenate([np.zeros(int(known.sum()), bool), np.ones(int((ready & state).sum()), bool)])
            yield _found(rows, out, is_open)
            if len(live):
                last = live[(head == head[-1]) & ~repeat]
                held = {c: rows[c][last] for c in names}
                held["open"] = np.full(len(last), bool(more[-1]))
        if held is not None and held["open"][0]:
            yield _found(held, np.arange(len(held["doc"])), np.ones(len(held["doc"]), bool))

    return dealt.mapInArrow(judge, FOUND_SCHEMA)


def _found(rows: dict, at: np.ndarray, is_open: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[c][at]) for c in ("doc", "sign", "start")]
        + [pa.array(np.abs(rows["n"][at])), pa.array(is_open), pa.array(rows["bucket"][at])],
        ["doc", "sign", "start", "n", "open", "bucket"])


def _packed(texts: DataFrame, found: DataFrame, span: int) -> DataFrame:
    """The open super-k-mers as packed strings; the windows of a hot bucket each by itself."""
    wanted = found.where("open")
    per_bucket = wanted.groupBy("bucket").count().where(F.col("count") > HOT_ROWS)
    total = per_bucket.agg(F.sum("count")).first()[0] or 0
    hot_rows = per_bucket.where(F.col("count") > max(HOT_ROWS, total // HOT_BUCKETS)).collect() if total else []
    hot = np.unique(np.array([r["bucket"] for r in hot_rows], np.int64))
    per_text = wanted.groupBy("doc", "sign").agg(F.collect_set(F.struct("start", "n", "bucket")).alias("wanted"))
    joined = texts.join(per_text, ["doc", "sign"]).select("doc", "sign", "text", "wanted")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            part = _one_of_each_text(part)
            flat, counts = words(part.column("text"))
            text, begin, end = _spaced(flat)
            lists = part.column("wanted")
            owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
            runs = lists.flatten()
            start, n, bucket = (runs.field(c).to_numpy() for c in ("start", "n", "bucket"))
            if len(hot):
                single = _in_sorted(bucket, hot)
                times = np.where(single, n, 1)
                inner = np.arange(times.sum()) - np.repeat(starts_of(times)[:-1], times)
                owner, start, bucket = (np.repeat(x, times) for x in (owner, start, bucket))
                n = np.where(np.repeat(single, times), 1, np.repeat(n, times))
                start = (start + inner).astype(np.int32)
            first = starts_of(counts)[:-1][owner] + start
            lo, hi = begin[first], end[first + n + span - 2]
            if len(hot):
                own = _in_sorted(bucket, hot)
                bucket = np.where(own, xxh64_slices(text, lo, np.where(own, hi, lo)).view(np.int64), bucket)
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket), pa.array([text[s:e] for s, e in zip(lo.tolist(), hi.tolist())], pa.binary()).cast(pa.string()),
                part.column("doc").take(pa.array(owner)), part.column("sign").take(pa.array(owner)),
                pa.array(start)], ["bucket", "packed", "doc", "sign", "start"])

    return joined.mapInArrow(pack, SUPER_SCHEMA)


def _in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def _first_seen(ids: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """For each window (its first position in ``ids``), the first window with the same words."""
    hashes = _rolling(_mix(ids.astype(np.uint64) + np.uint64(1)), span)[at]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    left, right = at[order[:-1][same]], at[order[1:][same]]
    if any((ids[left + j] != ids[right + j]).any() for j in range(span)):
        # Different windows with one hash: sort the words themselves.
        order = np.lexsort([ids[at + j] for j in range(span - 1, -1, -1)])
        left, right = at[order[:-1]], at[order[1:]]
        same = np.ones(len(left), bool)
        for j in range(span):
            same &= ids[left + j] == ids[right + j]
    head = np.concatenate([[True], ~same])
    group = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    out = np.empty(len(order), np.int64)
    out[order] = order[group]
    return out


def _repeats(rows: pa.Table, carried: int, span: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """Spans of repeated windows in ``rows``, in order of (bucket, doc, start), and the rows
    that hold the first of some window. The first ``carried`` rows are reported already."""
    doc, sign, start = (rows[c].to_numpy() for c in ("doc", "sign", "start"))
    flat, n_words = words(rows["packed"].combine_chunks())
    windows = np.maximum(n_words - span + 1, 0)
    owner = np.repeat(np.arange(len(doc)), windows)
    inner = np.arange(len(owner)) - np.repeat(starts_of(windows)[:-1], windows)
    ids = flat.dictionary_encode().indices.to_numpy()
    first = _first_seen(ids, starts_of(n_words)[:-1][owner] + inner, span)
    place = start[owner] + inner
    repeated = (doc[owner[first]] < doc[owner]) | (
        (doc[owner[first]] == doc[owner]) & (place[first] < place))
    keeps = np.zeros(len(doc), bool)
    keeps[owner[~repeated]] = True
    hit = np.flatnonzero(repeated & (owner >= carried))
    fresh = np.ones(len(hit), bool)
    fresh[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])
    cut = np.flatnonzero(fresh)
    begin, n = hit[cut], np.diff(np.append(cut, len(hit)))
    row = owner[begin]
    spans = pa.RecordBatch.from_arrays(
        [pa.array(doc[row]), pa.array(sign[row]),
         pa.array((start[row] + inner[begin]).astype(np.int32)), pa.array(n.astype(np.int32))],
        ["doc", "sign", "start", "n"])
    return spans, np.flatnonzero(keeps)


def repeated_spans(supers: DataFrame, span: int, buffer: int = BUFFER_BYTES) -> DataFrame:
    """(doc, sign, start, n): n consecutive windows from ``start`` on that occur earlier.

    A bucket comes in the order of its documents, so whole buckets are judged in portions; of a
    bucket larger than a portion only rows with a window not seen before are held.
    """
    dealt = supers.repartition("bucket").sortWithinPartitions("bucket", "doc", "start")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = carried = 0
        limit = buffer
        for part in portions(batches, "packed", buffer):
            held.append(part)
            size += part.nbytes
            if size < limit:
                continue
            rows = pa.Table.from_batches(held)
            bucket = rows["bucket"].to_numpy()
            tail = int(np.searchsorted(bucket, bucket[-1]))  # sorted; the last one may go on
            if tail:
                yield _repeats(rows.slice(0, tail), min(carried, tail), span)[0]
                rows, carried = rows.slice(tail), max(carried - tail, 0)
                limit = buffer
            else:
                spans, keep = _repeats(rows, carried, span)
                yield spans
                rows, carried = rows.take(pa.array(keep)), len(keep)
                limit = max(buffer, 2 * rows.nbytes)
            rows = rows.combine_chunks()
            held, size = rows.to_batches(), rows.nbytes
        if held:
            yield _repeats(pa.Table.from_batches(held), carried, span)[0]

    return dealt.mapInArrow(judge, SPAN_SCHEMA)


def deduplicate_substrings(
    docs: DataFrame, span: int = 20, gram: int = 5, id_col: str = "doc_id", text_col: str = "text",
    digest: bool = False,
) -> DataFrame:
    """(doc_id, kept, n_words, n_removed) for every row: the words that stay.

    A word goes if a window of ``span`` words that covers it starts earlier, too: in a row with
    a smaller id, or before in the same text; windows are judged on the input. Kept words are
    joined by one space; with ``digest`` their SHA-256 comes instead. A null text has no words.
    Rows with one id are judged as if they had the same place: a window of one makes no window
    at the same start of another a repeat. A null id comes after all others; rows without id are
    told apart by 64 bits of their text. Repeated rows are one place, so their number costs no more
    than a scan, and give repeated results. An empty table gives an empty one; other columns
    are not read.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.xxhash64(F.col(text_col), F.length(text_col)).alias("sign"), F.col(text_col).alias("text"))
    found = materialize(_meet(_places(rows.select("doc", "sign", "text"), span, gram)), "places")
    texts = rows.select("doc", "sign", "text")
    spans = found.where("not open").select("doc", "sign", "start", "n").unionByName(
        repeated_spans(_packed(texts, found, span), span))
    per_text = spans.groupBy("doc", "sign").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    marked = rows.join(per_text, ["doc", "sign"], "left").select("doc_id", "text", "spans")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            flat, counts = words(part.column("text"))
            edge = starts_of(counts)
            lists = part.column("spans")
            times = pc.fill_null(lists.value_lengths(), 0).to_numpy()
            runs = lists.flatten()
            lo = np.repeat(edge[:-1], times) + runs.field("start").to_numpy()
            gone = np.bincount(lo, minlength=len(flat) + 1).astype(np.int64)
            gone -= np.bincount(lo + runs.field("n").to_numpy() + span - 1, minlength=len(flat) + 1)
            stay = np.cumsum(gone[:len(flat)]) == 0
            left = np.concatenate([[0], np.cumsum(stay)])[edge]
            kept = pc.binary_join(pa.ListArray.from_arrays(
                pa.array(left, pa.int32()), flat.filter(pa.array(stay))), " ")
            if digest:
                kept = pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in kept], pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), kept, pa.array(counts, pa.int64()),
                 pa.array(counts - np.diff(left), pa.int64())],
                ["doc_id", "kept", "n_words", "n_removed"])

    return marked.mapInArrow(keep, "doc_id long, kept string, n_words long, n_removed long")
