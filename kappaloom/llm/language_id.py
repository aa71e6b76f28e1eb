"""Language identification by compression with one zstandard dictionary per language."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kappaloom.llm.arrow_text import portions

UNDETERMINED = "und"
_NO_LETTERS = re.compile(r"[\W\d_]+")
PREDICTION = "doc_id long, lang_pred string, score double, rejected boolean"
#: Least compressed bytes, without a dictionary, of a text of each size class but the first.
SIZES = (32, 64, 128, 256, 512, 1024)
#: Characters that held-out texts are cut to for the small classes, besides the whole text (a start of a
#: text has larger margins than a text of that length, so the large ones take whole texts alone), and
#: the margins a class asks for.
CUTS, LEAST_MARGINS = (25, 50, 100, 200), 200


def plain(text: str) -> str:
    """Lower-case letters and single spaces: what a language shows in, whatever the layout."""
    return _NO_LETTERS.sub(" ", text.lower())


@dataclass(frozen=True)
class LanguageModel:
    """One raw-content dictionary per language, and how it is used.

    A text is compressed in pieces of ``piece`` bytes, so that what a long text repeats
    itself does not hide what it shares with a dictionary. ``min_margin`` is the least share
    by which the smallest size has to be under the next one; ``margins`` has larger ones by size
    class, what a text takes without a dictionary, so that repetitions count as the short texts
    they are.
    """

    dictionaries: dict[str, bytes] = field(default_factory=dict)
    level: int = 3
    piece: int = 2048
    min_margin: float = 0.001
    margins: tuple[float, ...] = ()

    def compressors(self) -> list:
        """One for each language and, if there is any, a last one without a dictionary."""
        import zstandard

        made = []
        for content in self.dictionaries.values():
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=self.level)
            made.append(zstandard.ZstdCompressor(
                level=self.level, dict_data=held, write_content_size=False, write_dict_id=False))
        if made:
            made.append(zstandard.ZstdCompressor(level=self.level, write_content_size=False))
        return made

    def pieces(self, letters: str) -> list[bytes]:
        data = letters.encode()
        return [data[i:i + self.piece] for i in range(0, len(data), self.piece)]

    def size_class(self, letters: str, compressors: list) -> int:
        return bisect_right(SIZES, sum(len(compressors[-1].compress(p)) for p in self.pieces(letters)))

    def classify(self, text: str | None, compressors: list) -> tuple[str, float, bool]:
        """(language, score, rejected); the score is the margin, 0 to 1."""
        letters = plain(text or "")
        if not compressors or not any(map(str.isalpha, letters)):
            return UNDETERMINED, 0.0, True
        pieces = self.pieces(letters)
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in compressors[:len(self.dictionaries)]]
        best = int(np.argmin(sizes))
        others = sizes[:best] + sizes[best + 1:]
        margin = 1.0 - sizes[best] / min(others) if others else 1.0
        narrow = margin < self.min_margin or (
            margin < max(self.margins, default=0.0) and margin < self.margins[self.size_class(letters, compressors)])
        return list(self.dictionaries)[best], margin, narrow


def train(
    labelled: DataFrame, rows_per_language: int = 512, row_chars: int = 1000,
    dictionary_bytes: int = 128 << 10, max_languages: int = 1000, quantile: float = 0.005, **settings,
) -> LanguageModel:
    """Fit on a bounded sample of ``labelled`` (doc_id, text, lang).

    For each language about ``rows_per_language`` rows are drawn by a hash of the id, each
    gives its first ``row_chars`` characters, repeats left out, until the dictionary is full; at
    most three quarters of the rows are drawn. About as many of the others give the margins
    below which texts are rejected (see ``held_out_margins``).
    The counts behind the draw cover all rows. More than ``max_languages`` labels is an error.
    Rows with a null in any of the three columns or without a letter teach nothing.
    """
    known = labelled.where("lang is not null and text is not null and doc_id is not null")
    per_lang = known.groupBy("lang").count().limit(max_languages + 1)
    if per_lang.count() > max_languages:
        raise ValueError(f"more than {max_languages} languages to learn")
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place, own = chance * F.col("count"), F.least(F.lit(float(rows_per_language)), 0.75 * F.col("count"))
    counted = known.join(F.broadcast(per_lang), "lang")
    drawn = counted.where(place < own)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "sample")
    sample = drawn.select("lang", "doc_id", F.substring("text", 1, row_chars).alias("sample")).withColumn(
        "n", F.row_number().over(order)).where(F.col("n") <= rows_per_language)
    content: dict[str, dict[str, None]] = {}
    for row in sample.orderBy("lang", "n").collect():
        words = plain(row["sample"])
        if words.strip():
            content.setdefault(row["lang"], {})[words] = None
    model = LanguageModel({
        lang: "\n".join(texts).encode()[:dictionary_bytes] for lang, texts in sorted(content.items())
    }, **settings)
    others = counted.where((place >= own) & (place < own + F.lit(float(rows_per_language))))
    return replace(model, margins=held_out_margins(others, model, quantile))


def held_out_margins(held_out: DataFrame, model: LanguageModel, quantile: float) -> tuple[float, ...]:
    """The ``quantile`` of the margins of ``held_out`` (text), whole and cut short, by size class.

    Texts of the learned languages, so it is the share of them that a class loses. A class of
    fewer than ``LEAST_MARGINS`` margins takes the next smaller one's, the smallest none.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.compressors()
        for part in portions(batches):
            found = []
            for text in part.column(0).to_pylist():
                for cut in {text[:n] for n in (*CUTS, len(text))}:
                    lang, margin, _ = model.classify(cut, tools)
                    if lang != UNDETERMINED:
                        found.append((model.size_class(plain(cut), tools), margin))
            sizes, margins = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(margins, pa.float64())], ["size", "margin"])

    per_size = held_out.select("text").mapInArrow(measure, "size int, margin double").groupBy("size").agg(
        F.count("*").alias("n"), F.percentile_approx("margin", quantile).alias("margin")).collect()
    least = {r["size"]: r["margin"] for r in per_size if r["n"] >= LEAST_MARGINS}
    out = [0.0]
    for size in range(len(SIZES) + 1):
        out.append(least.get(size, out[-1]))
    return tuple(out[1:])


def identify(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, lang_pred, score, rejected, ``keep`` columns) of every whole text.

    The language is the one whose dictionary compresses the text best, ties to the first by
    name; ``rejected`` where the margin is narrower than nearly all of the learned languages'. A text that is null or has no letter is
    ``und`` with score 0 and rejected, so is every text if nothing was learned. Repeated rows
    give repeated results; only the id, the text and ``keep`` are read. No shuffle.
    """
    schema = ", ".join([PREDICTION, *[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for part in portions(batches):
            lang, score, rejected = zip(*(
                model.classify(t.as_py(), compressors) for t in part.column(1)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(rejected, pa.bool_()), *part.columns[2:]],
                ["doc_id", "lang_pred", "score", "rejected", *keep])

    picked = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep)
    return picked.mapInArrow(lambda batches: predict(_named(batches)), schema)


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` (with a column text) that ``model`` does not reject, all columns kept."""
    names, at = docs.columns, docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for part in portions(_named(batches, at)):
            stay = [not model.classify(t.as_py(), compressors)[2] for t in part.column(at)]
            yield pa.RecordBatch.from_arrays(part.filter(pa.array(stay, pa.bool_())).columns, numbers)

    numbers = [f"_{i}" for i in range(len(names))]
    numbered = docs.toDF(*numbers)
    return numbered.mapInArrow(keep, numbered.schema).toDF(*names)


def _named(batches: Iterator[pa.RecordBatch], at: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches with column ``at`` named text, whatever the others are called."""
    for batch in batches:
        names = [f"_{i}" for i in range(batch.num_columns)]
        names[at] = "text"
        yield pa.RecordBatch.from_arrays(batch.columns, names)


def fold(id_col: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo ``folds``; a row without id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)), F.lit(0))
