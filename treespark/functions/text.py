"""Text functions with the whitespace and word classes the readers and the vocabulary need."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters counted as white space, as a regular-expression class body.
WHITESPACE = (
    r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# A word is a run of word characters, or a run of other visible characters.
WORD_PATTERN = r"(?U)\w+|[^\w\s]+"


# A mark is any punctuation, or one of the ASCII signs that are counted as such.
MARKS = r"\p{P}$+<=>^`|~"
MARKED_PATTERN = rf"(?U)[{MARKS}]|[^\s{MARKS}]+"


def stripped(text: Column) -> Column:
    """Text without leading and trailing white space of any kind; ``trim`` knows blanks only."""
    return F.regexp_replace(text, f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


def is_blank(text: Column) -> Column:
    return F.length(stripped(text)) == 0


def words(line: Column) -> Column:
    """Space-separated words of a line; empty and white-space-only pieces are dropped."""
    return F.filter(F.split(stripped(line), " "), lambda w: ~is_blank(w))


def pre_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def marked_tokens(text: Column) -> Column:
    """Words between white space and marks; every mark is a word of its own."""
    return F.regexp_extract_all(text, F.lit(MARKED_PATTERN), F.lit(0))


@F.pandas_udf(StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFD", t), na_action="ignore")


def normalised(text: Column, decompose: bool = True, lowercase: bool = True) -> Column:
    """Canonical decomposition, then lower case."""
    out = _decomposed(text) if decompose else text
    return F.lower(out) if lowercase else out

