"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Whitespace as Python's str.split() sees it: Unicode white space plus U+001C..U+001F.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, WHITESPACE), lambda t: t != "")


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; 0 for empty or missing text.

    Only the first and the last piece of a split can be empty.
    """
    pieces = F.split(text, WHITESPACE)
    n = F.size(pieces)
    empty = (F.element_at(pieces, 1) == "").cast("int") + (
        (n > 1) & (F.element_at(pieces, -1) == "")
    ).cast("int")
    return F.coalesce(n - empty, F.lit(0)).cast("long")
