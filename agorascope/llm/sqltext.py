"""Words and lines of texts with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = "\t\n\x0b\x0c\r"  # with the space, the white space of words
SPACES = f"[ {BREAKS}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Maximal runs of other than space, tab, line feed, vertical tab, form feed, return."""
    return F.array_remove(F.split(text, SPACES), "")


def has_word(text: Column) -> Column:
    return text.rlike(f"[^ {BREAKS}]")


def lower_az(text: Column) -> Column:
    """A-Z as a-z; other letters as they are, so that ``lower`` serves ASCII texts only."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines(text: Column) -> Column:
    """The lines, split at line feeds, that have a word."""
    return F.filter(F.split(text, "\n", -1), has_word)


def normal_line(line: Column) -> Column:
    """Lower case A-Z, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(lower_az(line), SPACES, " "))
