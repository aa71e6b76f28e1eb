"""Marginal probability of words under a unigram model of subword pieces.

All segmentations of a word into pieces of an existing vocabulary count, each with the
product of its pieces' probabilities; a forward recursion in log space sums them. Words are
worked on together: edges of all their lattices lie in one array, ordered by where they end.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kappaloom.llm.arrow_text import offsets_of, starts_of
from kappaloom.llm.lookup import LongTable

SPACE_MARK = "▁"
_CODES = 21  # bits of a code point


class PieceTrie:
    """The pieces of a sentencepiece model with byte fallback, as a trie of hashed steps.

    Piece numbers are those of the model. ``prior`` follows the rank of the model's scores as
    1 / (rank + 10); ``END`` is the model's end of a text.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.size, self.end = model.vocab_size(), model.eos_id()
        plain = [i for i in range(self.size) if not (
            model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        steps: dict[int, int] = {}
        at_state = [-1]
        for i in plain:
            state = 0
            for c in model.id_to_piece(i):
                key = state << _CODES | ord(c)
                if key not in steps:
                    steps[key] = len(at_state)
                    at_state.append(-1)
                state = steps[key]
            at_state[state] = i
        keys = np.array(list(steps), np.int64)
        self.table = LongTable(keys)
        self.next_state = np.array(list(steps.values()) + [-1], np.int64)
        self.piece_at = np.array(at_state, np.int64)
        usable = np.array(plain + self.bytes.tolist() + [self.end])
        order = sorted(plain, key=lambda i: -model.get_score(i))
        rank = {i: r for r, i in enumerate(order)}
        weight = np.array([1.0 / (rank.get(i, len(order)) + 10) for i in usable.tolist()])
        self.prior = np.zeros(self.size)
        self.prior[usable] = weight / weight.sum()

    def edges(self, points: np.ndarray, lengths: np.ndarray):
        """(start, end, piece) of every piece found in the ragged words, and those of fallbacks.

        A character that is no piece itself gets one edge with piece -1, worth its bytes.
        """
        offset = starts_of(lengths)
        word_end = np.repeat(offset[1:], lengths)
        live = np.arange(len(points))
        state = np.zeros(len(points), np.int64)
        starts, ends, pieces = [], [], []
        alone = np.ones(len(points), bool)
        step = 0
        while len(live):
            found = self.table.find(state << _CODES | points[live + step].astype(np.int64))
            state = self.next_state[found]
            go = state >= 0
            live, state = live[go], state[go]
            piece = self.piece_at[state]
            hit = piece >= 0
            starts.append(live[hit])
            ends.append(live[hit] + step + 1)
            pieces.append(piece[hit])
            if step == 0:
                alone[live[hit]] = False
            step += 1
            go = live + step < word_end[live]
            live, state = live[go], state[go]
        lost = np.flatnonzero(alone)
        return (np.concatenate([*starts, lost]), np.concatenate([*ends, lost + 1]),
                np.concatenate([*pieces, np.full(len(lost), -1)]))


@lru_cache(maxsize=4)
def trie(model_path: str) -> PieceTrie:
    """One trie per worker process."""
    return PieceTrie(model_path)


def _fallback_bytes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of the characters, how many each has)."""
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    n = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64)
    return np.frombuffer(data, np.uint8), n


class WordLattices:
    """The lattices of an array of distinct words, each with the space mark in front."""

    def __init__(self, words: pa.Array, pieces: PieceTrie):
        marked = pc.binary_join_element_wise(SPACE_MARK, words, "")
        offsets, data = offsets_of(marked)
        self.lengths = pc.utf8_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
        self.points = np.frombuffer(
            data[offsets[0]:offsets[-1]].tobytes().decode().encode("utf-32-le"), np.uint32)
        self.pieces = pieces
        start, end, piece = pieces.edges(self.points, self.lengths)
        # Nodes: one before every character and one behind the last, word after word.
        word = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.first = starts_of(self.lengths + 1)[:-1]
        self.last = self.first + self.lengths
        depth = end - starts_of(self.lengths)[word[start]]
        order = np.lexsort((end, depth))
        self.start, self.end = (start + word[start])[order], (end + word[start])[order]
        self.piece, self.depth = piece[order], depth[order]
        self.lost = np.flatnonzero(self.piece < 0)
        lost_at = self.start[self.lost] - word[start][order][self.lost]
        self.lost_bytes, self.lost_n = _fallback_bytes(self.points[lost_at])

    def weights(self, log_p: np.ndarray) -> np.ndarray:
        """Log probability of every edge."""
        out = log_p[self.piece]
        if len(self.lost):
            each = log_p[self.pieces.bytes[self.lost_bytes]]
            out[self.lost] = np.add.reduceat(each, starts_of(self.lost_n)[:-1])
        return out

    def _recursion(self, weight, source, target, layers, at_start):
        value = np.full(int(self.lengths.sum()) + len(self.lengths), -np.inf)
        value[at_start] = 0.0
        for lo, hi in layers:
            term = value[source[lo:hi]] + weight[lo:hi]
            to = target[lo:hi]
            head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            top = np.maximum.reduceat(term, head)
            size = np.diff(np.append(head, hi - lo))
            value[to[head]] = top + np.log(np.add.reduceat(np.exp(term - np.repeat(top, size)), head))
        return value

    @staticmethod
    def _layers(depth: np.ndarray) -> list[tuple[int, int]]:
        cut = np.flatnonzero(np.concatenate([[True], depth[1:] != depth[:-1]])) if len(depth) else []
        return list(zip(cut, [*cut[1:], len(depth)])) if len(depth) else []

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all ways to each node."""
        return self._recursion(weight, self.start, self.end, self._layers(self.depth), self.first)

    def log_marginals(self, log_p: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability."""
        return self.forward(self.weights(log_p))[self.last]

    def expected(self, log_p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, ``counts`` occurrences of each."""
        weight = self.weights(log_p)
        ahead = self.forward(weight)
        depth = self.start - self.first[np.searchsorted(self.first, self.start, "right") - 1]
        order = np.lexsort((self.start, -depth))
        behind = self._recursion(weight[order], self.end[order], self.start[order],
                                 self._layers(depth[order]), self.last)
        word = np.searchsorted(self.first, self.start, "right") - 1
        share = np.exp(ahead[self.start] + weight + behind[self.end] - ahead[self.last][word]) * counts[word]
        out = np.bincount(np.where(self.piece >= 0, self.piece, 0), np.where(self.piece >= 0, share, 0.0),
                          minlength=self.pieces.size)
        if len(self.lost):
            each = np.repeat(share[self.lost], self.lost_n)
            out += np.bincount(self.pieces.bytes[self.lost_bytes], each, minlength=self.pieces.size)
        return out
