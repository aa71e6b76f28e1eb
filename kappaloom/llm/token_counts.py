"""Token counts of a byte-fallback BPE model by rank-synchronous array merging.

The model's pieces never hold a space mark behind another character, so no merge crosses
from a word into the space run of the next: a text falls apart into pre-tokens (a run of
space marks and the characters up to the next run) whose merges are independent. Distinct
pre-tokens of a portion lie as one ragged numpy array of symbols; each round every sequence
merges its lowest-rank pair, all sequences at once, until none has a pair left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from kappaloom.llm.arrow_text import offsets_of, portions, row_sums
from kappaloom.llm.lookup import LongTable

SPACE_MARK = "▁"
NONE = np.iinfo(np.int32).max
TOKEN_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class RankMerger:
    """The merge table of one sentencepiece BPE model.

    Symbols are pieces and single characters. ``rank`` orders the pieces by falling score;
    pieces of equal score share a rank, the leftmost pair then goes first.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        plain = [i for i in range(model.vocab_size()) if not (
            model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = [model.id_to_piece(i) for i in plain]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError("this vocabulary joins words: pre-tokens are not independent")
        scores = np.array([model.get_score(i) for i in plain])
        number = {p: i for i, p in enumerate(pieces)}
        chars = sorted({c for p in pieces for c in p} | {SPACE_MARK})
        for c in chars:
            number.setdefault(c, len(number))
        levels = {s: r for r, s in enumerate(sorted(set(scores.tolist()), reverse=True))}
        rank = [levels[s] for s in scores.tolist()]
        pairs = {}
        for p in pieces:
            for cut in range(1, len(p)):
                left, right = number.get(p[:cut]), number.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (rank[number[p]], number[p])
        keys = np.array(sorted(pairs), np.int64)
        self.table = LongTable(keys)
        self.ranks = np.array([pairs[k][0] for k in keys.tolist()] + [NONE], np.int32)
        self.merged = np.array([pairs[k][1] for k in keys.tolist()] + [-1], np.int32)
        #: symbol of each code point; characters outside the model have none
        self.of_char = np.full(0x110000, -1, np.int32)
        for c in chars:
            self.of_char[ord(c)] = number[c]
        self.of_char[0x20] = self.of_char[ord(SPACE_MARK)]
        #: tokens that a character left alone stands for: itself, or its UTF-8 bytes
        points = np.arange(0x110000)
        self.alone = (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int8)
        for c in chars:
            if number[c] < len(pieces):
                self.alone[ord(c)] = 1
        self.alone[0x20] = self.alone[ord(SPACE_MARK)]

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of neighbouring symbols; rank NONE where they don't merge."""
        key = left.astype(np.int64) << 32 | right
        key[(left < 0) | (right < 0)] = -1
        at = self.table.find(key)  # -1 reads the last entry: no rank
        return self.ranks[at], self.merged[at]

    def counts(self, tokens: pa.Array) -> np.ndarray:
        """Surviving symbols of each pre-token."""
        n = len(tokens)
        if not n:
            return np.zeros(0, np.int64)
        lengths = pc.utf8_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        start, data = offsets_of(tokens)
        points = np.frombuffer(
            data[start[0]:start[-1]].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        return self.merge(points, lengths)

    def merge(self, points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        tokens = np.zeros(len(lengths), np.int64)
        seq = np.repeat(np.arange(len(lengths)), lengths)
        sym = self.of_char[points]
        left_alone = self.alone[points].astype(np.int64)
        rank, into = self._neighbours(sym, seq)
        while len(seq):
            first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            size = np.diff(np.append(first, len(seq)))
            lowest = np.minimum.reduceat(rank, first)
            done = lowest == NONE
            if done.any():
                weights = np.add.reduceat(left_alone, first)
                tokens[seq[first[done]]] = weights[done]
                stay = np.repeat(~done, size)
                seq, sym, left_alone, rank, into = (
                    x[stay] for x in (seq, sym, left_alone, rank, into))
                continue
            at = self._choose(rank, sym, into, seq, np.repeat(lowest, size))
            sym[at], left_alone[at] = into[at], 1
            stay = np.ones(len(seq), bool)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            seq, sym, left_alone, rank, into = (x[stay] for x in (seq, sym, left_alone, rank, into))
            now = place[at]
            near = np.zeros(len(seq), bool)
            near[now] = near[np.maximum(now - 1, 0)] = True
            self._renew(np.flatnonzero(near), sym, seq, rank, into)
        return tokens

    def _neighbours(self, sym, seq):
        rank, into = np.full(len(seq), NONE, np.int32), np.full(len(seq), -1, np.int32)
        self._renew(np.arange(len(seq)), sym, seq, rank, into)
        return rank, into

    def _renew(self, at, sym, seq, rank, into):
        """Rank the pairs that begin at these positions again."""
        rank[at], into[at] = NONE, -1
        at = at[at + 1 < len(seq)]
        at = at[seq[at] == seq[at + 1]]
        rank[at], into[at] = self.pair(sym[at], sym[at + 1])

    def _choose(self, rank, sym, into, seq, lowest):
        """Positions to merge this round: the places of each sequence's lowest-rank pair.

        All of them, from the left without overlap; only the leftmost where a merge would
        create a pair of a rank that is lower still, which then has to go before the others.
        """
        at = np.flatnonzero(rank == lowest)
        new_run = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (seq[at[1:]] != seq[at[:-1]])])
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        leftmost = np.concatenate([[True], seq[at[1:]] != seq[at[:-1]]])
        if leftmost.all():
            return at
        new = into[at]
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, len(seq) - 1)
        # A neighbour may itself be merged this round.
        mark = np.full(len(seq) + 1, -1, np.int32)
        mark[at], mark[at + 1] = new, new
        left = np.where(mark[before] >= 0, mark[before], sym[before])
        right = np.where(mark[after] >= 0, mark[after], sym[after])
        low = lowest[at]
        lower = np.zeros(len(at), bool)
        for x, y, near in ((sym[before], new, before), (left, new, before),
                           (new, sym[after], after), (new, right, after)):
            lower |= (self.pair(x, y)[0] < low) & (seq[near] == seq[at]) & (near != at)
        alone = np.zeros(int(seq[-1]) + 1, bool)
        alone[seq[at[lower]]] = True
        return at[~alone[seq[at]] | leftmost]


@lru_cache(maxsize=4)
def merger(model_path: str) -> RankMerger:
    """One table per worker process."""
    return RankMerger(model_path)


def pre_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pre-tokens of all texts, how many each text has); the texts hold no null.

    A non-empty text gets the model's leading space mark. The tokens are a view of one
    buffer: only offsets are computed.
    """
    marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), "",
                        pc.binary_join_element_wise("", texts, " ")).cast(pa.large_string())
    offsets, data = offsets_of(marked)
    base, end = int(offsets[0]), int(offsets[-1])
    b = data[base:end]
    space = b == 0x20
    mark = np.flatnonzero(b == 0xE2)
    mark = mark[mark + 2 < len(b)]
    mark = mark[(b[mark + 1] == 0x96) & (b[mark + 2] == 0x81)]
    behind = np.zeros(len(b) + 3, bool)  # positions right behind a space or a mark
    behind[1:len(b) + 1] = space
    behind[mark + 3] = True
    begins = space
    begins[mark] = True
    begins &= ~behind[:len(b)]
    ends = (offsets[1:] - base).astype(np.int64)
    heads = (offsets[:-1] - base).astype(np.int64)
    begins[heads[heads < ends]] = True
    starts = np.flatnonzero(begins)
    counts = np.searchsorted(starts, ends) - np.searchsorted(starts, heads)
    edges = np.append(starts, len(b)).astype(np.int64) + base
    view = pa.Array.from_buffers(
        pa.large_string(), len(starts), [None, pa.py_buffer(edges), marked.buffers()[2]])
    return view, counts


def count_text_tokens(texts: pa.Array, model_path: str) -> np.ndarray:
    """Tokens of each text of the array, which holds no null."""
    view, per_text = pre_tokens(texts)
    if not len(view):
        return np.zeros(len(texts), np.int64)
    distinct = view.dictionary_encode()
    sizes = merger(model_path).counts(distinct.dictionary)
    return row_sums(sizes[distinct.indices.to_numpy()], per_text)


def token_counts(
    docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    The counts are those of the model's library without begin, end or added special tokens.
    A null or empty text has 0 bytes and 0 tokens. Repeated rows give repeated results, an
    empty table an empty one; other columns are not read. No shuffle: a task works on
    portions of a few megabytes, a longer text by itself.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, limit=8 << 20):
            texts = pc.fill_null(part.column("text"), "")
            tokens = count_text_tokens(texts, model_path)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pc.binary_length(texts).cast(pa.int64()),
                 pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(count, TOKEN_SCHEMA)
