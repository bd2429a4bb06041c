import pytest
from pyspark.sql import functions as F

from factloom.functions import measures, numbers, readings, tablecells, text, units, vectors


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("r")).first()["r"]


def test_parse_number(spark):
    cases = {"1234": 1234.0, "1,234.5": 1234.5, "12,5": 12.5, "0,75": 0.75, "1,23": 1.23, "12,345": 12345.0, "1 234 567": 1234567.0, "-1,234.5": -1234.5, "abc": None, "": None, "+5": None, "0,123": 123.0, " 7 ": 7.0, None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", numbers.parse_number(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in rows} == cases
    assert all(readings.number(k) == v for k, v in cases.items() if k is not None)


def test_any_notation(spark):
    rows = spark.createDataFrame([("2.475E+06",), ("1,234.5",), ("x",), (None,), (" -3 ",)], "t string").select(numbers.any_notation(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in rows] == [2475000.0, 1234.5, None, None, -3.0]


def test_units(spark):
    cases = {"gwh": "GWh", "t CO2-eq": "tCO2e", "MtCO2eq.": "MtCO2e", "m3;": "m3", "cubic metres": "m3", "megalitres": "ML", "thousand m3": "ML", "fathoms": None, None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", units.canonical_unit(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in rows} == cases
    robust = {"(Mm 3 )": None, "WATER": None, "MtCO 2eq": (1.0, "MtCO2e"), "million cubic metres.2025": (1e6, "m3"), "millionMWh": (1e6, "MWh"), "million m3": (1e6, "m3"), "[MWh]": (1.0, "MWh"), "": None}
    robust["(Mm 3 )"] = (1.0, "Mm3")
    assert {k: readings.robust_unit(k) for k in robust} == robust
    conversions = [(1.2, "GWh", "MWh", 1200.0), (3600.0, "GJ", "MWh", 1000.0), (1.5, "ktCO2e", "tCO2e", 1500.0), (5.0, "ML", "m3", 5000.0), (1.0, "fathoms", "m3", None), (2.0, "ha", "ha", None)]
    rows = spark.createDataFrame([c[:3] for c in conversions], "v double, u string, c string").select(units.to_canonical_value(F.col("v"), F.col("u"), F.col("c")).alias("r")).collect()
    for r, c in zip(rows, conversions, strict=True):
        assert r["r"] is None and c[3] is None or r["r"] == pytest.approx(c[3])


def test_parse_value():
    water, energy = frozenset(["m3", "ML", "kL", "Mm3"]), frozenset(["MWh", "GWh", "TWh", "GJ", "TJ", "PJ", "kWh"])
    cases = [("1.2 million m³", water, (1.2e6, "m3")), ("2.5 billion kWh", energy, (2.5e9, "kWh")), ("5 mlg of it", water, None), ("1000 USD", energy, None), ("total million MWh 269 289", energy, (269e6, "MWh")), ("(MWh) 84,399,860 x", energy, (84399860.0, "MWh")), ("millionm 3 | 53.6 | 47.3", water, (53.6e6, "m3")), ("(Mm3) 42 12", water, (42.0, "Mm3")), (".000 m3 32,141", water, (32141000.0, "m3"))]
    for t, family, expected in cases:
        assert readings.value_in(t, family) == expected, t


def test_parse_value_column(spark):
    frame = spark.createDataFrame([("5 GWh", ["GWh"]), (None, ["GWh"]), ("5 GWh", None), ("", ["GWh"])], "t string, a array<string>")
    assert [r["p"]["value"] for r in frame.select(units.parse_value(F.col("t"), F.col("a")).alias("p")).collect()] == [5.0, None, None, None]


def test_normalize_co2(spark):
    cases = {"MtCO\n2eq 18.95": "MtCO2eq 18.95", "Scope 1\n2 e": "Scope 1\n2 e", "CO 2 eq": "CO2eq", "t CO 2 e": "t CO2e", "MtCOe 5\n2\n": "MtCO2e 5\n", "a\n2\nb": "a\n2\nb", "tCO 18.95 20.2\n2e": "tCO2e 18.95 20.2", None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.normalize_co2(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in rows} == cases
    assert all(readings.joined_co2(k) == v for k, v in cases.items() if k is not None)


def test_text(spark):
    assert one(spark, text.split_sentences(F.col("t")), t=("string", "It rose. We (all) saw! (Yes.) no. ok")) == ["It rose.", "We (all) saw!", "(Yes.) no. ok"]
    assert one(spark, text.bm25_tokens(F.col("t")), t=("string", "A-b 12é")) == ["a", "b", "12"]
    assert one(spark, text.heading_text(F.col("t")), t=("string", "## Water\nbody\n # Two")) == "## water  # two"
    assert one(spark, text.header_string(F.col("h"), F.col("r")), h=("array<string>", ["", "2024", None]), r=("array<array<string>>", [["Total", "1"], [], None])) == "2024 | Total"
    assert one(spark, text.keywords(F.col("q")), q=("array<string>", ["Total gross of it", "Total net"])) == ["total", "gross"]


def test_cells(spark):
    headers = ["Tons", "2024", "2025", "%\n25/24", "2026", "2040"]
    assert one(spark, tablecells.year_column(F.col("h"), F.lit(2025)), h=("array<string>", headers)) == 2
    assert one(spark, tablecells.year_column(F.col("h"), F.lit(1990)), h=("array<string>", headers)) is None
    promoted = one(spark, tablecells.effective(F.col("h"), F.col("r")), h=("array<string>", ["", ""]), r=("array<array<string>>", [["", "2024"], ["a", "1"]]))
    assert promoted["headers"] == ["", "2024"] and promoted["rows"] == [["a", "1"]]
    empty = one(spark, tablecells.effective(F.col("h"), F.col("r")), h=("array<string>", []), r=("array<array<string>>", []))
    assert empty["rows"] == []
    for label, expected in (("Total energy consumption (all)", 1.0), ("consumption of total energy", 0.8), ("energy bill", 0.2), ("none", 0.0)):
        assert one(spark, tablecells.row_score(F.lit("Total energy consumption"), F.col("l")), l=("string", label)) == pytest.approx(expected)


def test_unit_of_row():
    accepted = frozenset(["m3", "Mm3"])
    assert readings.unit_of_row(["", "Unit", "2025"], ["Water", "(Mm 3 )", "42"], 2, accepted) == (1.0, "Mm3")
    assert readings.unit_of_row(["", "2025"], ["Water", "42 m3"], 1, accepted) == (1.0, "m3")
    assert readings.unit_of_row(["", "million cubic metres.2025"], ["Water", "42"], 1, accepted) == (1e6, "m3")
    assert readings.unit_of_row(["x (Mm3)", "2025"], ["Water", "42"], 1, accepted) == (1.0, "Mm3")
    assert readings.unit_of_row(["", "2025"], ["Water", "42"], 1, accepted) is None


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [-1.0]), ([0.0], [1.0]), (None, [1.0])], "a array<double>, b array<double>").select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert [None if r["c"] is None else round(r["c"], 9) for r in rows] == [1.0, 0.0, -1.0, 0.0, None]
    assert sum(x * x for x in one(spark, vectors.embedding(F.col("t")), t=("string", "a b a"))) == pytest.approx(1.0)


def test_read_unit():
    cases = {"kWh": ("kWh", 1.0), "(thousand MWh)": ("MWh", 1e3), "Unit: million cubic metres": ("m3", 1e6), "in hectares": ("ha", 1.0), "MGal (US).2012": ("million US gallon", 1.0), "tons (metric)": ("t", 1.0), "'000 t": ("t", 1e3), ".000 m 3": ("m3", 1e3), "US short tons CO2e": ("short ton CO2e", 1.0), "kt CO₂-eq": ("tCO2e", 1e3), "milliontCO2e": ("tCO2e", 1e6), "%": None, "tCO2e/MWh": None, "": None, None: None}
    assert {k: measures.read_unit(k) for k in cases} == cases


def test_co2_readers_agree(spark):
    import random

    from factloom.functions import readings, text

    rng = random.Random(8)
    parts = ["CO", "co", "2", "eq", "e", "q", " ", "\n", "t", "Mt", "kt", "26.2", "COe", "emissions", "| ", "Scope ", "\n2\n", "2eq", "\t"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(3_000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.normalize_co2(F.col("t")).alias("n")).collect()
    assert [(r["t"], r["n"]) for r in rows if r["n"] != readings.joined_co2(r["t"])] == []
