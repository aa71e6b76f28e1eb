"""An offline predictor with the contract of a remote model."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc

from kappaloom.operators.annotate import TransientError
from kappaloom.operators.prompts import ITEM_CLOSE, ITEM_OPEN
from kappaloom.operators.rules import ACCENTS, LABELS, LEXICON, Rule


#: keeps the letters a-z of UTF-8 bytes, all others become spaces
LETTERS = bytes(b if ord("a") <= b <= ord("z") else 0x20 for b in range(256))


def item_text(prompt: str) -> str:
    """The item inside a prompt: after the last opening mark, up to the last closing one."""
    return prompt[prompt.rindex(ITEM_OPEN) + len(ITEM_OPEN):prompt.rindex(ITEM_CLOSE)]


class LexiconPredictor:
    """Labels the item of a prompt by stop words, a batch at a time; answers like a chatty model."""

    def __init__(self, rule: Rule, answer: str = " {label}.\n"):
        self.answer = answer
        self.words = {label: {LEXICON[label][r].encode() for r in rule.ranks} for label in LABELS}
        self.accent_weight = rule.accent_weight

    def labels(self, texts: pa.Array) -> list[str | None]:
        """The best label of every text, first by name on ties, None without evidence."""
        return [self.label(lower) for lower in pc.utf8_lower(texts).to_pylist()]

    def label(self, lower: str) -> str | None:
        """All words of a text are counted at once, in C: a pass of its own for each is ten times as slow."""
        counts = Counter(lower.encode().translate(LETTERS).split())
        scores = {label: sum(counts[w] for w in words) for label, words in self.words.items()}
        if self.accent_weight:
            for label in LABELS:
                scores[label] += self.accent_weight * sum(map(lower.count, ACCENTS[label]))
        best = max(LABELS, key=scores.get)
        return best if scores[best] else None

    def predict_batch(self, prompts: list[str], run_idxs: list[int]) -> list[str | None]:
        texts = [item_text(p) for p in prompts]
        distinct = list(dict.fromkeys(texts))
        label = dict(zip(distinct, self.labels(pa.array(distinct, pa.string()))))
        return [self.answer.format(label=label[t]) if label[t] else None for t in texts]

    def predict(self, prompt: str, run_idx: int) -> str | None:
        return self.predict_batch([prompt], [run_idx])[0]


class BusyPredictor(LexiconPredictor):
    """Fails for a passing reason as often as the number before the first bar of a prompt says."""

    attempt = 1

    def predict(self, prompt: str, run_idx: int) -> str | None:
        if self.attempt <= int(prompt.split("|", 1)[0]):
            raise TransientError("busy")
        return super().predict(prompt, run_idx)
