"""Indicators, unit spellings, conversions and thresholds of rule extraction, as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The indicators the rules know.
KPIS = [
    {
        "kpi": "scope_1_emissions",
        "query": "Scope 1 direct greenhouse gas emissions",
        "queries": ["Total gross Scope 1 GHG emissions", "Scope 1 direct greenhouse gas emissions tCO2e", "Scope 1 (direct) emissions"],
        "unit_family": ["tCO2e", "ktCO2e", "MtCO2e", "t CO2-eq", "t CO2e", "tonnes CO2e"],
        "canonical_unit": "tCO2e",
        "lo": 1e2,
        "hi": 1e9,
        "negative_tokens": ["scope 2", "scope 3", "scopes 1, 2", "methane", "intensity", "per ", "fugitive", "equity"],
        "page_negative_phrases": None,
    },
    {
        "kpi": "total_energy_consumption",
        "query": "Total energy consumption",
        "queries": ["Total energy consumption MWh", "Energy consumption GWh", "Total energy consumed across operations"],
        "unit_family": ["MWh", "GWh", "TWh", "GJ", "TJ", "PJ", "kWh"],
        "canonical_unit": "MWh",
        "lo": 1e2,
        "hi": 1e9,
        "negative_tokens": ["renewable", "produced", "production", "intensity", "per ", "discontinued", "equity"],
        "page_negative_phrases": None,
    },
    {
        "kpi": "water_consumption",
        "query": "Total water consumption",
        "queries": ["Total freshwater consumption million m3", "Water consumption m3", "Total water consumed"],
        "unit_family": ["m3", "m³", "ML", "megaliters", "megalitres", "kL", "thousand m3", "cubic metres", "Mm3", "Mm³"],
        "canonical_unit": "m3",
        "lo": 1e1,
        "hi": 1e10,
        "negative_tokens": ["withdrawal", "withdrawn", "abstracted", "discharge", "discharged", "intake", "recycled", "reclaimed", " net ", "discontinued"],
        "page_negative_phrases": ["financial control"],
    },
]
# Spellings of units, lower case.
UNIT_ALIASES = {
    "kwh": "kWh", "mwh": "MWh", "gwh": "GWh", "twh": "TWh", "gj": "GJ", "tj": "TJ", "pj": "PJ",
    "tco2e": "tCO2e", "t co2e": "tCO2e", "t co2-eq": "tCO2e", "tco2eq": "tCO2e", "t co2eq": "tCO2e",
    "tonnes co2e": "tCO2e", "tonnes co2-eq": "tCO2e", "tonnes co2eq": "tCO2e",
    "ktco2e": "ktCO2e", "kt co2e": "ktCO2e", "ktco2eq": "ktCO2e",
    "mtco2e": "MtCO2e", "mt co2e": "MtCO2e", "mtco2eq": "MtCO2e",
    "m3": "m3", "m³": "m3", "cubic metres": "m3", "cubic meters": "m3",
    "ml": "ML", "megalitres": "ML", "megaliters": "ML", "thousand m3": "ML", "kl": "kL", "mm3": "Mm3", "mm³": "Mm3",
}
# Factors by unit and canonical unit.
CONVERSIONS = {
    ("kWh", "MWh"): 1e-3, ("MWh", "MWh"): 1.0, ("GWh", "MWh"): 1e3, ("TWh", "MWh"): 1e6,
    ("GJ", "MWh"): 1.0 / 3.6, ("TJ", "MWh"): 1e3 / 3.6, ("PJ", "MWh"): 1e6 / 3.6,
    ("tCO2e", "tCO2e"): 1.0, ("ktCO2e", "tCO2e"): 1e3, ("MtCO2e", "tCO2e"): 1e6,
    ("m3", "m3"): 1.0, ("kL", "m3"): 1.0, ("ML", "m3"): 1e3, ("Mm3", "m3"): 1e6,
}
# Thresholds.
TOLERANCE = 0.01
HEADER_SIMILARITY = 0.55
RRF_K = 60
HYBRID_ALPHA = 0.5
UNIT_BONUS = 0.1
RULE_PAGES, MODEL_PAGES = 25, 16
CONTEXT_CHARS, SNIPPET_CHARS = 4000, 160
LEAST_KEYWORD_SHARE, RANK_BONUS, TOTAL_BONUS = 0.15, 0.5, 0.3
TABLE_TIE, LINE_TIE = 0.05, 0.05
YEAR_SHAPED_PENALTY = 0.5
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
SUBSTANTIVE_CHARS, MAJORITY = 100, 0.5

KPI_SCHEMA = "kpi string, query string, queries array<string>, unit_family array<string>, canonical_unit string, lo double, hi double, negative_tokens array<string>, page_negative_phrases array<string>"


def kpis(spark: SparkSession) -> DataFrame:
    """The indicators as a table."""
    return spark.createDataFrame([tuple(k.values()) for k in KPIS], KPI_SCHEMA)
