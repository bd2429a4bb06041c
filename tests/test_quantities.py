import pytest
from pyspark.sql import functions as F

from factloom.operators import quantities as q

KPIS = [("energy", "Energy used, total", ["Energy used, total"], "MWh", ["sold"]), ("waste", "Waste, total", ["Waste, total", "Waste"], "t", ["per unit"])]
FACTORS = [("MWh", "MWh", 1.0), ("GWh", "MWh", 1000.0), ("kWh", "MWh", 0.001), ("GJ", "MWh", 1 / 3.6), ("t", "t", 1.0), ("kt", "t", 1000.0), ("kg", "t", 0.001)]


@pytest.fixture(scope="module")
def known(spark):
    kpis = spark.createDataFrame(KPIS, "kpi string, query string, queries array<string>, canonical_unit string, negative_tokens array<string>")
    return q.registry(kpis, spark.createDataFrame(FACTORS, "unit string, canonical_unit string, factor double"))


def test_judge(known):
    cases = [
        ((5.0, "GWh", None), (1000.0, "stated")),
        ((5000.0, "MWh", "Energy used, total | 5.0 GWh"), (1.0, "converted")),
        ((5.0, "MWh", "Energy used, total | 5.0 GWh"), (1000.0, "printed")),
        ((5.0, None, "came to 5 GWh, up 3 per cent"), (1000.0, "printed")),
        ((5.0, "", "came to 5 MWh"), (1.0, "printed")),
        ((5000.0, None, "came to 5 GWh"), (1.0, "converted")),
        ((5.0, None, "came to 5, up"), (None, "unknown")),
        ((5.0, "%", "came to 5 GWh"), (None, "contrary")),
        ((5.0, "kt", None), (None, "contrary")),
        ((None, "GWh", None), (None, "missing")),
        ((7.0, "thousand kWh", ""), (1.0, "stated")),
        ((5.0, None, "thou-\nsand MWh | 5"), (1000.0, "printed")),
    ]
    for (value, unit, text), expected in cases:
        _, factor, basis = q.judge(value, unit, text, "energy", known)
        assert (factor if factor is None else pytest.approx(factor), basis) == expected, (value, unit, text)


def test_tables(known):
    rows = [["(GWh)", ""], ["Energy used, total / X", "5"], ["Energy used, total sold", "5"], [], ["Notes", ""], ["Energy used, total in MWh", "7"], ["Waste, total", "n/a"], ["Waste, total", "3 kt"], ["Waste [kg]", "4", "5"], None]
    found = {r[0]: (r[1], r[2], r[4], r[5]) for r in q.table_quantities(["", "2024", "2023"], rows, known)}
    assert found == {1: ("energy", [5.0], [1000.0], "stated"), 5: ("energy", [7.0], [1.0], "stated"), 7: ("waste", [3.0], [1000.0], "stated"), 8: ("waste", [4.0, 5.0], [0.001, 0.001], "stated")}
    by_header = q.table_quantities(["Data (GWh)", "2024"], [["Energy used, total", "1.5 million"]], known)
    assert by_header[0][4] == [1e9]
    by_column = q.table_quantities(["", "2024", "Units"], [["Energy used, total", "2", "%"], ["Energy used, total", "2", "kWh"]], known)
    assert [r[4] for r in by_column] == [[None], [0.001]] and by_column[0][5] == "contrary"
    assert q.table_quantities([], [], known) == []


def test_mixture_assigns_missing_units(spark, known):
    known_rows = [(i, "energy", "acme", 2020, 1000.0 + i, "MWh", None) for i in range(40)] + [(100 + i, "energy", "acme", 2020, 1.0 + i / 1000, "GWh", None) for i in range(20)]
    asked = [(500, "energy", "Acme ", 2020, 1.02, None, None), (501, "energy", "other", 2021, 1015.0, "", None), (502, "energy", "acme", 2020, None, None, None), (503, "energy", "acme", 2020, -4.0, None, None), (504, None, None, None, 3.0, None, None)]
    frame = spark.createDataFrame(known_rows + asked, "extraction_id long, kpi string, company string, report_year int, value double, unit string, source_snippet string")
    labels = frame.limit(0).select(F.col("extraction_id").alias("label_id"), "kpi", "company", "report_year", "value", "unit", F.col("source_snippet").alias("notes"))
    tables = spark.createDataFrame([], "table_id long, company string, report_year int, headers array<string>, rows array<array<string>>")
    out = {r["row_id"]: r for r in q.convert(q.quantities(frame, labels, tables, known), known).collect()}
    assert len(out) == len(known_rows) + len(asked)
    assert out[500]["basis"] == "posterior" and out[500]["canonical_value"] == pytest.approx(1020.0) and not out[500]["uncertain"]
    assert out[501]["canonical_value"] == pytest.approx(1015.0)
    assert out[502]["canonical_value"] is None and out[503]["basis"] == "unknown" and out[503]["uncertain"]
    changed = {r["row_id"] for r in q.changed(q.convert(q.quantities(frame, labels, tables, known), known)).collect()}
    assert changed == {100 + i for i in range(20)}
