"""From a folder of reports to facts, grid and scores: python -m factloom.pipeline --reports DIR --out DIR --run-tag TAG [--gold CSV]."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import registry
from factloom.operators import comparison, evaluation
from factloom.operators.extractor import Extractor, RuleExtractor, run_extraction
from factloom.session import exists, written
from factloom.sources import reports, sinks


def indexed(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reports, pages and tables of a parsed layer, keyed by a hash of path, company and year, so that two files of one company and year stay apart; files with errors are left out."""
    good = parsed.where(F.col("error").isNull())
    key = F.xxhash64("path", "company", "report_year").alias("report_id")
    pages = reports.pages_of(good).select(key, "*")
    tables = reports.tables_of(good).select(key, F.xxhash64("path", "company", "report_year", "table_idx").alias("table_id"), "*")
    return good.select(key, "path", "company", "report_year").distinct(), pages, tables


def run(spark: SparkSession, folder: str, out: str, run_tag: str, gold: str | None = None, pattern: str = "*.html", parsers: Sequence[reports.ParserChoice] = (reports.ParserChoice("markup", reports.markup_parser),), extractors: Sequence[Extractor] = (), only: str | None = None) -> DataFrame:
    """Facts of a folder, written under `out`/`run_tag` with timings, prompt logs and, if there are labels, metrics.

    Files are parsed through the layer in `out`/parsed by the first parser that manages, or
    by `only` that one. Of several reports of one company and year the last path counts
    for metrics.
    """
    parsed = written(reports.dispatched(spark, folder, pattern, parsers, f"{out}/parsed", only))
    kpis = registry.kpis(spark)
    own, pages, tables = indexed(parsed)
    chosen = list(extractors or (RuleExtractor(),))
    facts = written(run_extraction(own, pages, tables, kpis, chosen, run_tag))
    scored = None
    if gold is not None:
        labels = reports.gold_labels(spark, gold)
        placed = facts.join(own.select("report_id", "path"), "report_id")
        scored = evaluation.metrics(evaluation.judged(labels, placed, kpis, "path"), facts, kpis)
    facts = facts.drop("report_id")
    sinks.write_run(facts, scored, out, run_tag)
    sinks.write_timings(reports.timings(parsed), out, run_tag)
    for extractor in chosen:
        if (log := getattr(extractor, "log", None)) is not None:
            sinks.write_prompt_log(log, out, run_tag)
    return facts


def compared(spark: SparkSession, folder: str, run_tags: Sequence[str], extractors: Sequence[str] = ("baseline", "llm")) -> DataFrame | None:
    """Values of the runs written under `folder` side by side, by company, year and indicator; runs that aren't there are left out."""
    paths = [(tag, f"{folder}/{tag}/extractions") for tag in run_tags]
    runs = [(tag, spark.read.parquet(path)) for tag, path in paths if exists(spark, path)]
    position = F.xxhash64("company", "report_year", "kpi", "extractor", "value").alias("position")
    return comparison.run_comparison([comparison.run_columns(facts.select("*", position), tag, extractors, "position") for tag, facts in runs])


def main() -> None:
    """Command line."""
    args = argparse.ArgumentParser(description=__doc__)
    for name in ("reports", "out", "run-tag"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--gold")
    args.add_argument("--pattern", default="*.html")
    given = args.parse_args()
    spark = SparkSession.builder.appName("factloom").getOrCreate()
    run(spark, given.reports, given.out, given.run_tag, given.gold, given.pattern).show(truncate=60)


if __name__ == "__main__":
    main()
