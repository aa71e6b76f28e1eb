"""Lines that many documents share are dropped from all of them; columns and joins only.

A line stands as the MD5 of its normalised form (128 bits, so that no two lines of a large
corpus meet by chance), a text as the MD5 of itself. Keys are made in one pass over the texts
and written; counting and joining work on keys, and the texts are read once more to be
reassembled from the positions that stay.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from kappaloom.operators.joins import skew_join
from kappaloom.session import materialize

SPACES = " \t\n\x0b\x0c\r"
#: a document: its id, or its text where it has none
DOCUMENT = ["_doc", "_text"]


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case and other letters as they are."""
    bare = F.btrim(line, F.lit(SPACES))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, ascii_uppercase, ascii_lowercase))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(_doc, _text, _pos, _key): the keys of all lines that may be dropped, one pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_doc"), _digest(text).alias("_text"), text.alias("_whole"))
    lines = rows.select("_doc", "_text", F.posexplode(_lines(F.col("_whole"))).alias("_pos", "_line"))
    keyed = lines.withColumn("_line", line_key(F.col("_line")))
    return keyed.where(F.char_length("_line") >= min_chars).select(
        *DOCUMENT, "_pos", _digest(F.col("_line")).alias("_key"))


def common_lines(keys: DataFrame, min_docs: int) -> DataFrame:
    """The rows of ``keys`` whose key stands in at least ``min_docs`` documents.

    Occurrences are counted first, combined inside each task: they bound the documents from
    above and leave few keys. Only for the occurrences of these are documents told apart. Keys
    that own a large share of the lines are salted.
    """
    often = materialize(
        keys.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_docs), "often")
    total = often.agg(F.sum("_n")).first()[0] or 0
    hits = materialize(skew_join(keys, often, "_key", "_n", total, "_text"), "line_hits")
    # Without an id the text names the document; with one it does not matter.
    document = F.struct(F.col("_doc"), F.when(F.col("_doc").isNull(), F.col("_text")))
    enough = (
        hits.select("_key", document.alias("_d")).groupBy("_key", "_d").agg(F.count("*").alias("_n"))
        .groupBy("_key").agg(F.count("*").alias("_docs"), F.sum("_n").alias("_n"))
        .where(F.col("_docs") >= min_docs).drop("_docs"))
    return skew_join(hits, materialize(enough, "common_lines"), "_key", "_n", total, "_text")


def drop_common_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` without the lines found in at least ``min_docs`` documents, and what was done.

    Texts are split at \\n. A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends
    and with A-Z lowered; keys shorter than ``min_chars`` code points are never dropped. A common
    key loses all its lines in every document; the others stay, joined by \\n. ``n_lines`` counts
    the lines before, ``n_dropped`` those that went (both long); columns of these names in
    ``docs`` are replaced, all others are kept whatever their names.

    A null or empty text is one empty line; a null text comes back as ''. Rows of one id
    are one document, however often they come; rows without id are one document for each different
    text. Repeated rows give repeated results, an empty table an empty one. The lines of a single
    text must fit a task, nothing else is held together.
    """
    gone = common_lines(materialize(line_keys(docs, min_chars, id_col, text_col), "line_keys"), min_docs)
    places = gone.groupBy(*DOCUMENT).agg(F.array_sort(F.collect_set("_pos")).alias("_gone"))
    text = F.col(f"_row.{text_col}")
    rows = docs.select(F.struct("*").alias("_row"))
    rows = rows.withColumn("_id", F.col(f"_row.{id_col}")).withColumn(
        "_own", _digest(F.coalesce(text, F.lit(""))))
    met = rows.join(
        places, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_text")), "left")
    # Two readers of the split keep it a column of its own, computed once for a row.
    met = met.select("_row", "_gone", _lines(text).alias("_lines"))
    n = F.size("_lines")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_gone"))
    kept = F.array_join(F.transform(stay, lambda p: F.get(F.col("_lines"), p)), "\n")
    made = {
        text_col: F.when(F.col("_gone").isNull(), F.coalesce(text, F.lit(""))).otherwise(kept),
        "n_lines": n.cast("long"),
        "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
    }
    names = [*docs.columns, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns]]
    return met.select(*[made[c].alias(c) if c in made else F.col(f"_row.`{c}`").alias(c) for c in names])
