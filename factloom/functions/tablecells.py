"""Functions on headers, rows and cells of ragged string tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.readings import unit_of_row_udf
from factloom.functions.text import tokens

YEAR = r"\b((?:19|20)\d{2})\b"
# First cells that say what a column holds instead of naming a row.
COLUMN_WORDS = ("metric", "metrics", "indicator", "indicators", "description", "descriptions", "topic", "kpi")


def text_of(cell: Column) -> Column:
    """The cell, or an empty text for NULL."""
    return F.coalesce(cell, F.lit(""))


def has_year(cell: Column) -> Column:
    """Whether a cell holds a year."""
    return text_of(cell).rlike(YEAR)


def effective(headers: Column, rows: Column) -> Column:
    """Struct (headers, rows): the first row taken for headers if only it holds years."""
    promote = ~F.exists(headers, has_year) & (F.size(rows) > 0) & F.exists(F.get(rows, 0), has_year)
    promote = F.coalesce(promote, F.lit(False))
    return F.struct(F.when(promote, F.get(rows, 0)).otherwise(headers).alias("headers"), F.when(promote, F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))).otherwise(rows).alias("rows"))


def year_column(headers: Column, report_year: Column) -> Column:
    """0-based place of the header with the latest year not after `report_year`, the first on ties; NULL if there is none."""
    years = F.transform(headers, lambda h, i: F.struct(F.regexp_extract(text_of(h), YEAR, 1).try_cast("int").alias("y"), (-i).alias("i")))
    return -F.array_max(F.filter(years, lambda s: s["y"].isNotNull() & (s["y"] <= report_year)))["i"]


def structural_score(headers: Column, report_year: Column) -> Column:
    """1.0 if a header holds a year and the report's year, else 0.5."""
    fits = F.exists(headers, lambda h: has_year(h) & F.contains(text_of(h), report_year.cast("string")))
    return F.when(fits, 1.0).otherwise(0.5)


def label_cell(row: Column) -> Column:
    """The cell that names a row: the second if the first is a column word."""
    first = text_of(F.get(row, 0))
    return F.when(F.lower(F.trim(first)).isin(*COLUMN_WORDS) & (F.size(row) > 1), text_of(F.get(row, 1))).otherwise(first)


def row_score(query: Column, label: Column, wanted: Column | None = None, held: Column | None = None) -> Column:
    """1.0 if the label holds the query, 0.8 if it holds all its words, else 0.6 times their share.

    `wanted` and `held` are the words of query and label where they are at hand already.
    """
    wanted = tokens(query) if wanted is None else wanted
    overlap = F.size(F.array_intersect(wanted, tokens(label) if held is None else held))
    share = F.when(overlap == F.size(wanted), 0.8).otherwise(overlap / F.greatest(F.size(wanted), F.lit(1)) * 0.6)
    return F.when(F.contains(F.lower(label), F.lower(query)), 1.0).otherwise(share)


def infer_unit(headers: Column, row: Column, value_col: Column, accepted: Column) -> Column:
    """Struct (multiplier, unit) of a value by the first source that states an accepted unit, or of NULLs.

    Sources in order: the value's cell (its magnitude doesn't count), a unit column, the
    second cell unless it is the value, the value's header, the label, any header; of the
    last three the whole text comes before its parts.
    """
    return unit_of_row_udf(headers, row, value_col, accepted)
