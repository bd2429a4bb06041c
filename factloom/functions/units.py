"""Units of rule extraction as column expressions; NULL where a unit or conversion is unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.readings import robust_unit_udf, value_udf
from factloom.registry import CONVERSIONS, UNIT_ALIASES


def _map(pairs: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def canonical_unit(unit: Column) -> Column:
    """The unit that a spelling stands for, or NULL."""
    bare = F.regexp_replace(F.regexp_replace(unit, r"(?U)^\s+|\s+$", ""), r"[.,;:]+$", "")
    return F.try_element_at(_map(UNIT_ALIASES), F.lower(bare))


def canonical_unit_robust(text: Column) -> Column:
    """Struct (multiplier, unit) of a unit in a header or cell, with brackets, a year, split letters or a magnitude word; or of NULLs."""
    return robust_unit_udf(text)


def to_canonical_value(value: Column, unit: Column, canonical: Column) -> Column:
    """`value` in `canonical`, or NULL."""
    source, target = canonical_unit(unit), F.coalesce(canonical_unit(canonical), canonical)
    factor = F.try_element_at(_map({f"{a}|{b}": x for (a, b), x in CONVERSIONS.items()}), F.concat(source, F.lit("|"), target))
    return F.when(source == target, value).otherwise(value * factor)


def family(units: Column) -> Column:
    """Canonical units of a family; unknown ones are left out."""
    return F.array_distinct(F.filter(F.transform(units, canonical_unit), lambda u: u.isNotNull()))


def parse_value(text: Column, accepted: Column) -> Column:
    """Struct (value, unit) of the first number with an `accepted` canonical unit, or of NULLs.

    Number, magnitude and unit in this order come first, then magnitude, unit and number,
    then unit and number; of each shape the first acceptable match counts.
    """
    return value_udf(text, accepted)
