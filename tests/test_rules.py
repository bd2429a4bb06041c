import pytest
from pyspark.sql import functions as F

from factloom import registry
from factloom.operators import rules

TABLES = "report_id long, company string, report_year int, table_id long, table_idx int, page_num int, headers array<string>, rows array<array<string>>"
PAGES = "report_id long, company string, report_year int, page_num int, page_pos int, text string"
# Fixed values, one layout each: report year, page, headers, rows, indicator, value or None.
LAYOUTS = [
    (2024, 5, ["KPI", "2023", "2024", "Unit"], [["Scope 1 direct greenhouse gas emissions", "48,000", "45,678", "tCO2e"], ["Scope 2 emissions", "12,000", "10,500", "tCO2e"]], "scope_1_emissions", 45678.0),
    (2024, 2, ["KPI", "2024", "Currency"], [["Scope 1 direct greenhouse gas emissions", "45,678", "USD"]], "scope_1_emissions", None),
    (2025, 6, ["Metric", "Unit", "2024", "2025"], [["Scope 1 direct greenhouse gas emissions", "MtCO 2 e", "32.8", "33.7"]], "scope_1_emissions", 33.7e6),
    (2025, 147, ["", "", "2025", "2024"], [["Total Scope 1 direct greenhouse gas emissions", "MtCO 2eq", "18.95", "20.20"]], "scope_1_emissions", 18.95e6),
    (2025, 184, ["WATER CONSUMPTION", "Unit", "2025", "2024"], [["Total water consumption", "(Mm 3 )", "42", "45"]], "water_consumption", 42e6),
    (2025, 368, ["", "unit", "2025", "2024"], [["Total energy consumption", "millionMWh", "269", "289"]], "total_energy_consumption", 269e6),
    (2025, 385, ["", "million cubic metres.2025", "million cubic metres.2024"], [["Total water consumption", "86", "90"]], "water_consumption", 86e6),
    (2025, 58, ["Metrics related", "Description", "Unit", "2025", "2024"], [["Water", "", "", "", ""], ["Metric", "Total water consumption", "m3", "45,642,187", "41,912,946"]], "water_consumption", 45642187.0),
    (2025, 166, ["GHG", "Unit", "2025", "2024"], [["Percentage of Scope 1 direct greenhouse gas emissions", "%", "61", "63"], ["Direct Scope 1 greenhouse gas emissions", "MtCO 2 e", "28.4", "26.2"]], "scope_1_emissions", 28.4e6),
    (2025, 5, ["Metric", "Unit", "2024", "2025"], [["GHG-Operational control boundary", "", "", ""], ["Scope 1 direct greenhouse gas emissions", "MtCO2e", "32", "33.7"], ["GHG-Equityshare", "", "", ""], ["Scope 1 direct greenhouse gas emissions", "MtCO2e", "32", "35.4"]], "scope_1_emissions", 33.7e6),
    (2025, 150, ["", "", "2025", "2024", "Change"], [["Total energy consumption (primary and final)", "TWh", "168.59", "170.52", "(1.93)"]], "total_energy_consumption", 168.59e6),
    (2025, 9, ["", ""], [["", "2025"], ["Total water consumption", "86 m3"]], "water_consumption", 86.0),
]


def test_layouts(spark):
    tables = spark.createDataFrame([(i, "acme", y, i, 0, p, h, r) for i, (y, p, h, r, _, _) in enumerate(LAYOUTS)], TABLES)
    pages = spark.createDataFrame([], PAGES)
    kpis = registry.kpis(spark)
    found = rules.table_choice(rules.table_candidates(tables, pages, kpis, rules.table_similarity(tables, kpis)))
    got = {(r["report_id"], r["kpi"]): r for r in found.collect()}
    for i, (_, page, _, _, kpi, value) in enumerate(LAYOUTS):
        if value is None:
            assert (i, kpi) not in got
        else:
            assert got[i, kpi]["value"] == pytest.approx(value), i
            assert got[i, kpi]["source_page"] == page and got[i, kpi]["source_snippet"].startswith("table@page")


def test_heading_and_magnitude(spark):
    rows = [["Total water consumption", "86", "90"]]
    tables = spark.createDataFrame([(1, "s", 2025, 10, 0, 385, ["", "million cubic metres.2025", "x"], rows), (1, "s", 2025, 11, 1, 424, ["", "million cubic metres.2025", "x"], [["Total water consumption", "127", "117"]]), (2, "t", 2025, 20, 0, 1, ["", "m3.2025"], [["Total water consumption", "2024"]])], TABLES)
    pages = spark.createDataFrame([(1, "s", 2025, 424, 0, "## Water consumption (financial control boundary) [A]\nx"), (1, "s", 2025, 385, 1, "See financial control")], PAGES)
    kpis = registry.kpis(spark)
    found = {r["report_id"]: r for r in rules.table_choice(rules.table_candidates(tables, pages, kpis, rules.table_similarity(tables, kpis))).collect()}
    assert found[1]["value"] == 86e6
    assert found[2]["flags"] == ["year_shaped_value"]
    both = {r["report_id"]: r for r in rules.table_choice(rules.table_candidates(tables, pages.limit(0), kpis, rules.table_similarity(tables, kpis))).collect()}
    assert both[1]["value"] == 127e6


def test_lines_and_end_to_end(spark):
    pages = spark.createDataFrame(
        [
            (1, "acme", 2024, 7, 0, "Our Scope 1 direct greenhouse gas emissions in 2024 were 12,345 tCO2e, a 5% reduction"),
            (2, "acme", 2023, 1, 0, "Our Scope 1 direct greenhouse gas emissions were 0.5 tCO2e last year."),
            (3, "acme", 2022, 1, 0, "Nothing relevant here."),
            (4, "acme", 2025, 3, 0, "2023 2024 2025\n" + "x\n" * 14 + "| Freshwater consumption | million m3 | 53.6 50.1 47.3 |"),
            (5, "acme", 2021, 1, 0, None),
        ],
        PAGES,
    )
    kpis = registry.kpis(spark)
    ranking = pages.select("report_id", "page_num", F.lit(0).alias("rank")).crossJoin(kpis.select("kpi"))
    lines = rules.line_candidates(pages, ranking, kpis)
    tables = rules.table_choice(rules.table_candidates(spark.createDataFrame([], TABLES), pages, kpis, spark.createDataFrame([], "table_id long, kpi string, sim double")))
    reports = pages.select("report_id", "company", "report_year")
    facts = {(r["report_year"], r["kpi"]): r for r in rules.extract(reports, kpis, tables, rules.line_choice(lines), lines.where("not plausible")).collect()}
    assert len(facts) == 15
    assert facts[2024, "scope_1_emissions"]["value"] == 12345.0 and facts[2024, "scope_1_emissions"]["source_snippet"].startswith("line@page 7")
    assert facts[2023, "scope_1_emissions"]["value"] is None and facts[2023, "scope_1_emissions"]["flags"] == ["out_of_range"]
    assert facts[2022, "scope_1_emissions"]["unit"] is None
    assert facts[2025, "water_consumption"]["value"] == pytest.approx(47.3e6)


def test_year_column_value(spark):
    def value(lines, at, raw):
        frame = spark.createDataFrame([(lines, at, lines[at], raw)], "l array<string>, i int, t string, r double")
        return frame.select(rules.year_column_value(F.col("l"), F.col("i"), F.col("t"), F.col("r")).alias("v")).first()["v"]

    assert value(["2021 2022", "a 10 20"], 1, 10.0) == 20.0
    assert value(["2021 2023", "a 10 20"], 1, 10.0) is None
    assert value(["2021 2022 2023", "a 10 20"], 1, 10.0) is None
    assert value(["2021 2022", "a 0 20"], 1, 10.0) is None
    assert value(["a 10 20", "2022 2021"], 0, 10.0) == 10.0
