"""Words of a text."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space beyond ASCII is part of a word, as for Java's ``\\s``.
BLANKS = r"\s+"


def words(text: Column) -> Column:
    """Array of words: split on white space, ASCII punctuation stripped, lower case, none empty."""
    stripped = F.transform(F.split(text, BLANKS), lambda w: F.lower(F.btrim(w, F.lit(string.punctuation))))
    return F.filter(stripped, lambda w: w != "")


def word_rows(df, text: str, name: str = "word"):
    """A row per word of ``text``. As ``words``, but with plain columns, which Spark compiles, in the place of lambdas."""
    pieces = df.select(F.explode(F.split(F.col(text), BLANKS)).alias(name))
    return pieces.select(F.lower(F.btrim(F.col(name), F.lit(string.punctuation))).alias(name)).where(F.col(name) != "")
