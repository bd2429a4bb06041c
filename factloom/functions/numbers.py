"""Printed numbers to DOUBLE. Every function gives NULL where nothing can be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted shapes of a printed number, in the order of trial.
THOUSANDS_COMMA = r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"
THOUSANDS_SPACE = r"^-?\d{1,3}( \d{3})+(\.\d+)?$"
DECIMAL_COMMA = r"^-?\d+,\d{1,2}$"
PLAIN = r"^-?\d+(\.\d+)?$"
# A number in a table cell, and one in running text where a space never groups digits.
NUMBER_IN_CELL = r"[-+]?\d{1,3}(?:[,\s]\d{3})+(?:\.\d+)?|[-+]?\d+(?:[.,]\d+)?"
NUMBER_IN_TEXT = r"[-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?|[-+]?\d+(?:[.,]\d+)?"
# The words that scale a number.
MAGNITUDES = {"thousand": 1e3, "million": 1e6, "billion": 1e9}


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def parse_number(text: Column) -> Column:
    """The number `text` prints, or NULL.

    Three digits after a comma are always thousands; a leading plus sign, an empty
    text and NULL give NULL.
    """
    t = _trimmed(text)
    shaped = (
        F.when(t.rlike(THOUSANDS_COMMA), F.replace(t, F.lit(","), F.lit("")))
        .when(t.rlike(THOUSANDS_SPACE), F.replace(t, F.lit(" "), F.lit("")))
        .when(t.rlike(DECIMAL_COMMA), F.replace(t, F.lit(","), F.lit(".")))
        .when(t.rlike(PLAIN), t)
    )
    return shaped.try_cast("double")


def first_number(cell: Column) -> Column:
    """The first number in a table cell, or NULL."""
    found = F.regexp_extract(cell, f"(?U)({NUMBER_IN_CELL})", 1)
    return parse_number(F.when(found != "", found))


def numbers_in_text(line: Column) -> Column:
    """All readable numbers of a line of running text, in order."""
    parsed = F.transform(F.regexp_extract_all(line, F.lit(f"({NUMBER_IN_TEXT})"), F.lit(1)), parse_number)
    return F.filter(parsed, lambda v: v.isNotNull())


def has_number(cell: Column) -> Column:
    """Whether a table cell prints a number; false for NULL."""
    return F.coalesce(cell.rlike(f"(?U){NUMBER_IN_CELL}"), F.lit(False))


def any_notation(text: Column) -> Column:
    """The number in any plain, exponent or printed notation, or NULL."""
    return F.coalesce(_trimmed(text).try_cast("double"), parse_number(text))
