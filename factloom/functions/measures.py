"""Reading units and scales as they are printed, and their factors to a canonical unit."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Spellings of units (lower case, compatibility forms folded, single blanks), by the unit
# they are a multiple of. CO2 masses are spelled as a mass and a CO2 suffix.
MASS = {
    "t": {"t": 1.0, "tonne": 1.0, "tonnes": 1.0, "metric ton": 1.0, "metric tons": 1.0, "ton (metric)": 1.0, "tons (metric)": 1.0, "metric tonnes": 1.0, "tonne(s)": 1.0, "tonnen": 1.0, "toneladas": 1.0, "ton": 1.0, "tons": 1.0},
    "kt": {"kt": 1.0, "kilotonne": 1.0, "kilotonnes": 1.0, "kilotons": 1.0},
    "Mt": {"mt": 1.0, "megatonne": 1.0, "megatonnes": 1.0, "megatons": 1.0},
    "kg": {"kg": 1.0, "kgs": 1.0, "kilogram": 1.0, "kilograms": 1.0, "kilogrammes": 1.0},
    "short ton": {"short ton": 1.0, "short tons": 1.0, "us ton": 1.0, "us tons": 1.0, "us short ton": 1.0, "us short tons": 1.0},
    "lb": {"lb": 1.0, "lbs": 1.0, "pound": 1.0, "pounds": 1.0},
}
OTHER = {
    "kWh": {"kwh": 1.0, "kw h": 1.0, "kilowatt hour": 1.0, "kilowatt hours": 1.0, "kilowatt-hours": 1.0},
    "MWh": {"mwh": 1.0, "mw h": 1.0, "megawatt hour": 1.0, "megawatt hours": 1.0, "megawatt-hours": 1.0},
    "GWh": {"gwh": 1.0, "gw h": 1.0, "gigawatt hour": 1.0, "gigawatt hours": 1.0, "gigawatt-hours": 1.0},
    "TWh": {"twh": 1.0, "tw h": 1.0, "terawatt hour": 1.0, "terawatt hours": 1.0, "terawatt-hours": 1.0},
    "GJ": {"gj": 1.0, "gigajoule": 1.0, "gigajoules": 1.0},
    "TJ": {"tj": 1.0, "terajoule": 1.0, "terajoules": 1.0},
    "PJ": {"pj": 1.0, "petajoule": 1.0, "petajoules": 1.0},
    "MMBtu": {"mmbtu": 1.0, "million btu": 1.0},
    "toe": {"toe": 1.0, "tonnes of oil equivalent": 1.0, "tons of oil equivalent": 1.0},
    "m3": {"m3": 1.0, "m 3": 1.0, "cubic metre": 1.0, "cubic metres": 1.0, "cubic meter": 1.0, "cubic meters": 1.0, "cu m": 1.0, "cbm": 1.0, "dam3": 1e3, "dam 3": 1e3, "hm3": 1e6, "hm 3": 1e6},
    "ML": {"ml": 1.0, "megalitre": 1.0, "megalitres": 1.0, "megaliter": 1.0, "megaliters": 1.0, "gl": 1e3, "gigalitres": 1e3, "gigaliters": 1e3},
    "kL": {"kl": 1.0, "kilolitre": 1.0, "kilolitres": 1.0, "kiloliter": 1.0, "kiloliters": 1.0},
    "L": {"l": 1.0, "litre": 1.0, "litres": 1.0, "liter": 1.0, "liters": 1.0},
    "Mm3": {"mm3": 1.0, "mm 3": 1.0},
    "US gallon": {"us gallon": 1.0, "us gallons": 1.0, "gal (us)": 1.0, "gallons (us)": 1.0, "us gal": 1.0},
    "million US gallon": {"million us gallon": 1.0, "million us gallons": 1.0, "mgal (us)": 1.0},
    "ha": {"ha": 1.0, "hectare": 1.0, "hectares": 1.0},
    "km2": {"km2": 1.0, "km 2": 1.0, "square kilometre": 1.0, "square kilometres": 1.0, "square kilometers": 1.0, "sq km": 1.0},
    "acre": {"ac": 1.0, "acre": 1.0, "acres": 1.0},
    "m2": {"m2": 1.0, "m 2": 1.0, "square metre": 1.0, "square metres": 1.0, "square meters": 1.0, "sq m": 1.0},
}
CO2_SUFFIXES = ("co2e", "co2eq", "co2-eq", "co2 e", "co2 eq", "co2-e", "co 2 e", "co 2 eq", "co 2eq", "co 2e", "of co2 equivalent", "co2 equivalent", "of co2e")
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "bn": 1e9, "mn": 1e6, "mio": 1e6, "mrd": 1e9, "tsd": 1e3, "k": 1e3, "'000": 1e3, "000": 1e3, ".000": 1e3, "1,000": 1e3, "1000": 1e3}
CELL_SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "bn": 1e9, "mn": 1e6, "m": 1e6, "k": 1e3}


def _spellings() -> dict[str, tuple[str, float]]:
    found: dict[str, tuple[str, float]] = {}
    for unit, names in OTHER.items():
        found |= {name: (unit, times) for name, times in names.items()}
    for unit, names in MASS.items():
        for name, times in names.items():
            found[name] = (unit, times)
            for suffix in CO2_SUFFIXES:
                for gap in ("", " "):
                    found[f"{name}{gap}{suffix}"] = (f"{unit} CO2e" if unit == "short ton" else f"{unit}CO2e", times)
    return found


SPELLINGS = _spellings()


WHITE = re.compile(r"\s+")
GAPS = re.compile(r"[^\S ]+|  +")


def folded(text: str) -> str:
    """Lower case, compatibility forms, plain apostrophes and single blanks."""
    t = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower().replace("’", "'").replace("‘", "'").replace("\xad", "")
    return WHITE.sub(" ", t) if GAPS.search(t) else t


def _pattern(words: list[str]) -> str:
    """One pattern of all `words`, sharing beginnings, longest first."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def rendered(node: dict) -> str:
        branches = [re.escape(c) + rendered(n) for c, n in sorted(node.items()) if c]
        if not branches:
            return ""
        return f"(?:{'|'.join(branches)}){'?' if '' in node else ''}"

    return rendered(tree)


_SCALE, _UNIT = _pattern(list(SCALES)), _pattern(list(SPELLINGS))
MENTION = re.compile(rf"(?<![\w/])(?:(?P<scale>(?<![\d,.]){_SCALE})(?P<gap> ?))?(?P<unit>{_UNIT})(?![\w/²³]|-[a-z])")
WHOLE = re.compile(rf"(?:(?P<scale>{_SCALE})(?P<gap> ?))?(?P<unit>{_UNIT})")


@lru_cache(100_000)
def read_unit(text: str | None) -> tuple[str, float] | None:
    """(unit of the factor table, how many of it) that a unit field, header or cell states alone, or None."""
    if not text:
        return None
    t = folded(text).strip(" .,;:*·|")
    bare = re.sub(r"\. ?(?:19|20)\d\d$", "", t).strip(" .,;:")
    bare = re.sub(r"^(?:unit|units|in|figures in|all figures in)\b[: ]*", "", bare)
    for candidate in (t, t.strip("()[]{} ."), bare, bare.strip("()[]{} .,;:")):
        if m := WHOLE.fullmatch(candidate):
            unit, times = SPELLINGS[m["unit"]]
            return unit, times * SCALES.get(m["scale"] or "", 1.0)
    return None


def mentions(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, unit, times) of units in a folded text."""
    return [(m.start(), m.end(), SPELLINGS[m["unit"]][0], SPELLINGS[m["unit"]][1] * SCALES.get(m["scale"] or "", 1.0)) for m in MENTION.finditer(text)]


NUMBER = re.compile(r"(?<![\w.,])[-+]?\d{1,3}(?:[ ,\xa0 ']\d{3})+(?:\.\d+)?(?![\d])|(?<![\w.,])[-+]?\d+(?:[.,]\d+)?(?:e[-+]\d{1,3})?(?![\d])")
SCALED = re.compile(r" ?(thousand|million|billion|bn|mn|k|m)(?![\w])")


PLAIN = re.compile(r"[-+]?\d{1,3}(?:,\d{3})*(?:\.\d+)?|[-+]?\d+(?:\.\d+)?")
SEPARATORS = re.compile(r"[ \xa0\u202f']")
THOUSANDS = re.compile(r"[-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?")


def to_number(text: str) -> float | None:
    """The number a matched text prints; a comma before one or two last digits is decimal."""
    if PLAIN.fullmatch(text):
        return float(text.replace(",", ""))
    t = SEPARATORS.sub("", text)
    t = t.replace(",", "" if THOUSANDS.fullmatch(t) else ".")
    try:
        return float(t)
    except ValueError:
        return None


def numbers(text: str) -> list[tuple[int, int, float]]:
    """(start, end, number) of the numbers in a folded text."""
    if PLAIN.fullmatch(text):
        return [(0, len(text), float(text.replace(",", "")))]
    found = []
    for m in NUMBER.finditer(text):
        v = to_number(m[0])
        if v is not None:
            found.append((m.start(), m.end(), v))
    return found
