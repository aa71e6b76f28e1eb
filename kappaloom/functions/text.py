"""String expressions shared by cleaning, prompting and label extraction."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from kappaloom.fixed_values import ANSWER_EDGE_CHARS, INSTRUCTION_END

# What counts as white space in Python, as characters and as a Java regex class.
SPACES = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))
SPACE = r"[\s\x1c-\x1f]"
# What Python's \w matches: letters, every kind of number, underscore.
WORD = r"[\p{L}\p{N}_]"


def strip_space(c: Column) -> Column:
    """Trim Unicode white space (Spark's plain trim removes U+0020 only)."""
    return F.btrim(c, F.lit(SPACES))


def squeeze_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+", " ")


def clean_answer(c: Column) -> Column:
    """Trim space, then quote and punctuation marks at both ends, then squeeze space."""
    return squeeze_space(F.btrim(strip_space(c), F.lit(ANSWER_EDGE_CHARS)))


def normal_form(c: Column) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def normal_form_py(label: str) -> str:
    return re.sub("[^a-z0-9]", "", label.lower())


def quoted(literal: str) -> str:
    """Java regex that matches ``literal`` itself."""
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def is_word_char(ch: str) -> bool:
    return ch == "_" or ch.isalnum()


def model_answer(raw: Column, echo_end: str | None = None) -> Column:
    """Trimmed model response, null when empty.

    With ``echo_end`` only the text after its last occurrence counts, for backends
    that echo the instruction.
    """
    if echo_end:
        raw = F.substring_index(raw, echo_end, -1)
    return F.nullif(strip_space(raw), F.lit(""))


def instruction(prompt: Column, wrapper: tuple[str, str]) -> Column:
    """Prompt inside a backend's instruction format."""
    return F.concat(F.lit(wrapper[0]), prompt, F.lit(wrapper[1]))


ECHO_END = INSTRUCTION_END
