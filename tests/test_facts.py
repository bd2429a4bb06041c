import pytest
from pyspark.sql import functions as F

from factloom import registry
from factloom.operators import comparison, evaluation, model
from factloom.sources import reports, sinks
from factloom.streaming.facts import fact_stream, latest_stream

FACT = "extractor string, company string, report_year int, kpi string, value double, unit string, reporting_year int, pos int"
GOLD = "company string, report_year int, kpi string, value double, unit string, reporting_year int"


def test_is_correct(spark):
    cases = [(1000.5, "t", 1, 1000.0, "t", 1, True), (1005.0, "t", 1, 1000.0, "t", 1, True), (1020.0, "t", 1, 1000.0, "t", 1, False), (1000.0, "kt", 1, 1000.0, "t", 1, False), (1000.0, "t", 2, 1000.0, "t", 1, False), (None, "a", 1, None, "b", 2, True), (None, "t", 1, 5.0, "t", 1, False), (0.005, None, None, 0.0, None, None, True), (0.01, "t", 1, 0.0, "t", 1, False)]
    rows = spark.createDataFrame(cases, "v double, u string, y int, gv double, gu string, gy int, ok boolean").select(evaluation.is_correct(*[F.col(c) for c in ("v", "u", "y", "gv", "gu", "gy")]).alias("r"), "ok").collect()
    assert [r["r"] for r in rows] == [r["ok"] for r in rows]


def test_metrics(spark):
    gold = spark.createDataFrame([("a", 1, "k", 10.0, "t", 1), ("b", 1, "k", None, None, None), ("c", 1, "k", 5.0, "t", 1)], GOLD)
    pred = spark.createDataFrame([("x", "a", 1, "k", 99.0, "t", 1, 1), ("x", "a", 1, "k", 10.0, "t", 1, 2), ("x", "b", 1, "k", 3.0, "t", 1, 3), ("x", "z", 1, "k", 3.0, "t", 1, 4)], FACT)
    kpis = spark.createDataFrame([("k",), ("other",)], "kpi string")
    rows = {r["kpi"]: r for r in evaluation.metrics(evaluation.judged(gold, pred, kpis, "pos"), pred, kpis).collect()}
    assert (rows["k"]["tp"], rows["k"]["fp"], rows["k"]["fn"], rows["k"]["tn"]) == (1, 1, 1, 0)
    assert rows["k"]["precision"] == 0.5 and rows["k"]["recall"] == 0.5 and rows["k"]["coverage"] == 1.0
    assert rows["other"]["f1"] == 0.0
    assert evaluation.metrics(evaluation.judged(gold, pred.limit(0), kpis, "pos"), pred.limit(0), kpis).count() == 0


def test_comparison(spark):
    facts = spark.createDataFrame([("llm", "acme", 2022, "k", 100.0, "t", 1, 1), ("llm", "acme", 2024, "k", 200.0, "t", 1, 2), ("llm", "acme", 2024, "k", 300.0, "t", 1, 3), ("llm", "b", 2023, "k", None, "t", 1, 4)], FACT)
    latest = {r["company"]: r["value"] for r in comparison.latest_per_key(facts, ["company", "kpi"], "report_year", "pos").collect()}
    assert latest == {"acme": 200.0, "b": None}
    assert comparison.grid(facts, ["k", "none"], "pos").columns == ["company", "k", "none"]
    runs = [comparison.run_columns(facts, f"v{i}", ["llm"], "pos") for i in (1, 2)]
    joined = comparison.run_comparison(runs)
    assert {"v1_llm_value", "v2_llm_value"} <= set(joined.columns) and joined.count() == 2
    assert comparison.run_comparison([]) is None


def test_model(spark):
    kpis = registry.kpis(spark)
    key = model.cache_key("m", F.col("kpi"), "s", F.col("user"))
    requests = spark.createDataFrame([("acme", 2024, k, "s", f"ask {i}", [1]) for i, k in enumerate(["scope_1_emissions", "water_consumption", "total_energy_consumption"])], "company string, report_year int, kpi string, system string, user string, retrieved_pages array<int>").withColumn("cache_key", key)
    assert requests.select("cache_key").distinct().count() == 3
    empty = spark.createDataFrame([], model.RESPONSE)
    call = model.replay({"scope_1_emissions": {"value": 45.678, "unit": "ktCO2e", "reporting_year": 2024, "confidence": 0.9}, "water_consumption": {"value": 5.0, "unit": None}})
    answers = model.answered(requests, empty, call)
    facts = {r["kpi"]: r for r in model.validated(answers, kpis).collect()}
    assert facts["scope_1_emissions"]["value"] == pytest.approx(45678.0) and facts["scope_1_emissions"]["flags"] == []
    assert facts["water_consumption"]["flags"] == ["llm_missing_unit"] and facts["total_energy_consumption"]["flags"] == ["api_error"]
    cached = answers.where("answered").select(*[c.split()[0] for c in model.RESPONSE.split(", ")])
    again = model.answered(requests, cached)
    assert again.where("from_cache").count() == 2
    assert model.prompt_log(answers, model.Provider("p", "m", 0.0)).count() == 3
    with pytest.raises(ValueError):
        model.Provider.resolve("nobody")


def test_model_retries(spark):
    requests = spark.createDataFrame([("k1", "x", "s", "u")], "cache_key string, kpi string, system string, user string")

    def failing(kpi, system, user):
        raise RuntimeError("429 slow down")

    assert model.ask(requests, failing, sleep=lambda s: None).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "Acme_2024.html").write_text("<h1>Report</h1><p>" + "word " * 40 + "</p><table><tr><th>KPI</th><th>2024</th></tr><tr><td> Water </td><td>5</td></tr></table>\fsecond", encoding="utf-8")
    (tmp_path / "unfit.html").write_text("x")
    files = reports.scan(spark, str(tmp_path), "*.html")
    parsed = reports.parse(files, reports.markup_parser, "markup")
    rows = {r["company"]: r for r in parsed.collect()}
    assert rows["acme"]["tables"][0]["rows"] == [["Water", "5"]] and [p["page_num"] for p in rows["acme"]["pages"]] == [1, 2]
    assert rows[None]["error"] is not None
    assert reports.pages_of(parsed).where("company = 'acme'").count() == 2 and reports.tables_of(parsed).count() == 1

    def broken(content):
        raise OSError("no")

    both = reports.with_fallback(reports.parse(files, broken, "heavy"), parsed)
    assert {r["parser"] for r in both.collect()} == {"markup"}
    assert reports.gold_labels(spark, str(tmp_path / "none.csv")).count() == 0 and reports.run_facts(spark, str(tmp_path / "none.csv")) is None
    assert reports.renumbered([(1, "a"), (2, "b")], [(1, [], []), (9, [], [])], 21, 40) == ([(21, "a"), (22, "b")], [(21, [], [])])
    assert reports.batched(lambda c, a, b: ([(a, "x")], []), lambda c: 45)(b"")[0] == [(1, "x"), (21, "x"), (41, "x")]


def test_sinks_and_stream(spark, tmp_path):
    facts = spark.createDataFrame([("acme", 2024, "k", 1.0, ["f"], 'a "quoted"\nline', 1)], "company string, report_year int, kpi string, value double, flags array<string>, source_snippet string, pos int")
    sinks.write_run(facts, None, str(tmp_path), "v1", "csv")
    assert spark.read.csv(str(tmp_path / "v1/extractions"), header=True, multiLine=True, escape='"').count() == 1
    sinks.write_run(facts, facts.select("kpi"), str(tmp_path), "v2")
    folder = str(tmp_path / "v2/extractions")
    stream = latest_stream(fact_stream(spark, folder, spark.read.parquet(folder).schema), ["company", "kpi"], "report_year", "pos")
    query = stream.writeStream.format("memory").queryName("latest_facts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("latest_facts").first()["value"] == 1.0


def test_pipeline(spark, tmp_path):
    from factloom import pipeline

    folder = tmp_path / "reports"
    folder.mkdir()
    table = "<table><tr><th>KPI</th><th>2024</th><th>Unit</th></tr><tr><td>Scope 1 direct greenhouse gas emissions</td><td>45,678</td><td>tCO2e</td></tr></table>"
    (folder / "acme_2024.html").write_text(f"<p>Total water consumption was 1,234 m3 in the year.</p>{table}", encoding="utf-8")
    (folder / "bad.html").write_text("x")
    (tmp_path / "gold.csv").write_text("company,report_year,kpi,value,unit,reporting_year,source_page,notes\nacme,2024,scope_1_emissions,45678,tCO2e,2024,1,\nacme,2024,water_consumption,,,,,\n")
    facts = {r["kpi"]: r for r in pipeline.run(spark, str(folder), str(tmp_path / "out"), "v1", str(tmp_path / "gold.csv")).collect()}
    assert facts["scope_1_emissions"]["value"] == 45678.0 and facts["scope_1_emissions"]["run_tag"] == "v1"
    assert facts["water_consumption"]["value"] == 1234.0 and facts["total_energy_consumption"]["value"] is None
    again = pipeline.run(spark, str(folder), str(tmp_path / "out"), "v0").count()
    assert again == len(facts) and spark.read.parquet(str(tmp_path / "out/parsed")).count() == 2
    metrics = {r["kpi"]: r for r in spark.read.parquet(str(tmp_path / "out/v1/metrics")).collect()}
    assert metrics["scope_1_emissions"]["tp"] == 1 and metrics["water_consumption"]["fp"] == 1


def test_pipeline_of_two_extractors(spark, tmp_path):
    from factloom import pipeline
    from factloom.operators.extractor import ModelExtractor, RuleExtractor

    folder = tmp_path / "reports"
    (folder / "more").mkdir(parents=True)
    table = "<table><tr><th>KPI</th><th>2023</th><th>Unit</th></tr><tr><td>Scope 1 direct greenhouse gas emissions</td><td>{}</td><td>tCO2e</td></tr></table>"
    for name, value in (("acme_2024", "45,678"), ("acme_2023", "40,000")):
        (folder / f"{name}.html").write_text(f"<p>{'Scope 1 emissions of the group. ' * 8}</p>{table.format(value)}", encoding="utf-8")
    calls = tmp_path / "calls"
    calls.mkdir()

    def client(kpi, system, user):
        (calls / f"{kpi}-{abs(hash(user))}").touch()
        return {"value": 45.678, "unit": "ktCO2e", "confidence": 0.9} if kpi == "scope_1_emissions" else {"value": None, "confidence": 0.1}

    def heavy(content):
        raise OSError("no layout")

    parsers = (reports.ParserChoice("heavy", heavy, reports.MOST_BYTES), reports.ParserChoice("markup", reports.markup_parser))
    asker = ModelExtractor(model.Provider("p", "m", 0.0), client, str(tmp_path / "responses"), lanes=2)
    run = lambda tag: pipeline.run(spark, str(folder), str(tmp_path / "out"), tag, parsers=parsers, extractors=(RuleExtractor(), asker)).collect()
    facts = run("v1")
    assert len(facts) == 12
    got = {(r["extractor"], r["report_year"]): r["value"] for r in facts if r["kpi"] == "scope_1_emissions"}
    assert got == {("baseline", 2024): 45678.0, ("baseline", 2023): 40000.0, ("llm", 2024): 45678.0, ("llm", 2023): 45678.0}
    assert len(list(calls.iterdir())) == 6
    for made in calls.iterdir():
        made.unlink()
    assert len(run("v2")) == 12 and not list(calls.iterdir())
    assert {r["parser"] for r in spark.read.csv(str(tmp_path / "out/v1/parse_timings"), header=True).collect()} == {"markup"}
    assert len(list((tmp_path / "out/v1/prompt_log").glob("path=*"))) == 6
    both = pipeline.compared(spark, str(tmp_path / "out"), ["v1", "v2", "none"])
    assert {"v1_llm_value", "v2_baseline_value"} <= set(both.columns) and both.count() == 2
    assert reports.enabled(parsers) == list(parsers)


def test_index_layer(spark, tmp_path):
    from factloom.functions import vectors
    from factloom.operators.extractor import index_layer

    pages = spark.createDataFrame([(1, 1, "One here. Two there."), (1, 2, None), (2, 1, "Three.")], "report_id long, page_num int, text string")
    tables = spark.createDataFrame([(1, 5, 1, ["", "2024"], [["Water", "5"]])], "report_id long, table_id long, page_num int, headers array<string>, rows array<array<string>>")
    first = index_layer(pages, tables, str(tmp_path)).count()
    assert first == 4 and index_layer(pages, tables, str(tmp_path)).count() == 4
    assert spark.read.parquet(str(tmp_path / "token-slots")).count() == 4
    more = pages.unionAll(spark.createDataFrame([(2, 2, "Four.")], pages.schema))
    assert index_layer(more, tables, str(tmp_path)).count() == 5
    with pytest.raises(ValueError):
        vectors.embedder("nobody")
