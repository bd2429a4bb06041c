"""Queries on quantities recorded in differing units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import quantities
from factloom.session import table


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, quantities.Registry]:
    known = quantities.registry(table(spark, sf_dir, "kpis"), table(spark, sf_dir, "unit_factors"))
    return quantities.quantities(table(spark, sf_dir, "extractions"), table(spark, sf_dir, "gold_labels"), table(spark, sf_dir, "report_tables"), known), known


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities whose number changes in the canonical unit of their indicator."""
    return quantities.changed(quantities.convert(*_found(spark, sf_dir)))


def p3_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quantity in its canonical unit, with basis and probability."""
    return quantities.convert(*_found(spark, sf_dir))


def p3_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many quantities were converted on which basis."""
    return p3_converted(spark, sf_dir).groupBy("src", "basis", "uncertain").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p3_found": p3_found, "p3_converted": p3_converted, "p3_basis": p3_basis}
ORACLE: dict[str, str] = {}
