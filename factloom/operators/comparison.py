"""Comparing facts across years, indicators, extractors and runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def latest_per_key(facts: DataFrame, keys: Sequence[str], year: str, position: str) -> DataFrame:
    """The fact of the latest `year` of each key, the first by `position` on ties; one aggregation, combined on the map side.

    A NULL year comes before any other, a NULL position last.
    """
    rest = [c for c in facts.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(F.col(year).alias("y"), F.col(position).isNotNull().alias("h"), (-F.col(position)).alias("p")))
    return facts.groupBy(*keys).agg(top.alias("_t")).select(*keys, *[F.col(f"_t.{c}").alias(c) for c in rest])


def grid(facts: DataFrame, kpi_names: Sequence[str], position: str) -> DataFrame:
    """One row per company and one column per indicator with the latest value; every indicator has a column."""
    latest = latest_per_key(facts, ["company", "kpi"], "report_year", position)
    return latest.groupBy("company").pivot("kpi", list(kpi_names)).agg(F.first("value"))


def run_columns(facts: DataFrame, run: str, extractors: Sequence[str], position: str) -> DataFrame:
    """(company, report_year, kpi, {run}_{extractor}_value...): the first value of each extractor; keys without any value are left out.

    Extractors are named, so one without values keeps a NULL column.
    """
    keys = ["company", "report_year", "kpi"]
    value = lambda e: F.min_by(F.when(F.col("extractor") == e, F.col("value")), F.when(F.col("extractor") == e, F.col(position))).alias(f"{run}_{e}_value")
    return facts.where("value is not null").groupBy(*keys).agg(*[value(e) for e in extractors])


def run_comparison(runs: Sequence[DataFrame]) -> DataFrame | None:
    """Full outer join of run columns on company, report_year and kpi; None without runs."""
    keys = ["company", "report_year", "kpi"]
    return reduce(lambda a, b: a.join(b, keys, "full"), runs) if runs else None


def best_of_either(outcomes: DataFrame, extractors: Sequence[str]) -> DataFrame:
    """Per indicator: labels right in any of `extractors`, and labels judged."""
    cell = outcomes.where(F.col("extractor").isin(*extractors)).groupBy("kpi", "company", "report_year").agg(F.bool_or(F.col("outcome").isin("tp", "tn")).alias("right"))
    return cell.groupBy("kpi").agg(F.count_if("right").alias("right"), F.count(F.lit(1)).alias("labels"))


def run_values(facts: DataFrame, position: str) -> DataFrame:
    """(run_tag, extractor, company, report_year, kpi, value): the first value of each, of all runs and extractors; the long form of run_comparison, whose width grows with the runs."""
    keys = ["run_tag", "extractor", "company", "report_year", "kpi"]
    return facts.where("value is not null").groupBy(*keys).agg(F.min_by("value", position).alias("value"))

