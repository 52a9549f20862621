"""Column expressions over raw text and over values read from text files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a word is a run of letters of any script.
WORD_PATTERN = r"\p{L}+"


def words(text: Column, pattern: str = WORD_PATTERN) -> Column:
    """Lower-cased words of ``text`` in order, as an array."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def split_words(line: Column) -> Column:
    """Words of a single-space separated line; double spaces yield empty words."""
    return F.split(line, " ", -1)


def fields(line: Column) -> Column:
    """Tab-separated fields of a line."""
    return F.split(line, "\t", -1)
