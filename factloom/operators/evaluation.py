"""Scoring facts against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom import registry
from factloom.session import bounded, small


def is_correct(value: Column, unit: Column, year: Column, gold_value: Column, gold_unit: Column, gold_year: Column, tolerance: float = registry.TOLERANCE) -> Column:
    """Whether a value agrees with its label: both missing, or equal unit and year and within the relative tolerance.

    Against a label of 0 the tolerance is absolute and exclusive. NaN counts as missing.
    """
    v, g = F.nanvl(value.cast("double"), F.lit(None).cast("double")), F.nanvl(gold_value.cast("double"), F.lit(None).cast("double"))
    near = F.when(g == 0, F.abs(v) < tolerance).otherwise(F.abs(v - g) / F.abs(F.nullif(g, F.lit(0.0))) <= tolerance)
    return F.when(v.isNull() & g.isNull(), True).when(v.isNull() | g.isNull(), False).otherwise(unit.eqNullSafe(gold_unit) & year.eqNullSafe(gold_year) & near)


def last_per_key(predictions: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """The last prediction of each key by `order`."""
    w = W.partitionBy(*keys).orderBy(F.desc(order))
    return predictions.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def judged(labels: DataFrame, predictions: DataFrame, kpis: DataFrame, order: str) -> DataFrame:
    """One row per extractor, label: outcome tp, fp, fn or tn, and whether a prediction was matched and had a value.

    Predictions meet labels by company, report_year and kpi; of several the last by `order`
    counts, and those without label are ignored. Every extractor meets every label.
    """
    keys = ["extractor", "company", "report_year", "kpi"]
    pred = last_per_key(predictions, keys, order).select(*keys, F.col("value").alias("p_value"), F.col("unit").alias("p_unit"), F.col("reporting_year").alias("p_year"), F.lit(True).alias("matched"))
    names = bounded(predictions.select("extractor").where("extractor is not null").distinct(), "the list of extractors")
    asked = labels.join(small(kpis.select("kpi").distinct()), "kpi", "left_semi").select("company", "report_year", "kpi", "value", "unit", "reporting_year").join(names)
    j = asked.join(pred, keys, "left")
    correct = is_correct(F.col("p_value"), F.col("p_unit"), F.col("p_year"), F.col("value"), F.col("unit"), F.col("reporting_year"))
    has = F.col("p_value").isNotNull()
    outcome = F.when(F.col("matched").isNull(), F.when(F.col("value").isNull(), "tn").otherwise("fn")).when(correct & has, "tp").when(correct, "tn").when(has, "fp").otherwise("fn")
    return j.select("extractor", "kpi", "company", "report_year", outcome.alias("outcome"), F.col("matched").isNotNull().alias("matched"), (has & F.col("matched").isNotNull()).alias("valued"))


def metrics(outcomes: DataFrame, extractors: DataFrame, kpis: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and coverage for every extractor and indicator, 0 where nothing was judged."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    counted = outcomes.groupBy("extractor", "kpi").agg(*[count(o) for o in ("tp", "fp", "fn", "tn")], F.count_if("matched").alias("matched"), F.count_if("valued").alias("valued"))
    every = extractors.select("extractor").distinct().join(bounded(kpis.select("kpi").distinct(), "the list of indicators"))
    full = every.join(counted, ["extractor", "kpi"], "left").fillna(0)
    ratio = lambda n, d: F.when(d > 0, n / F.nullif(d, F.lit(0))).otherwise(0.0)
    scored = full.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    total = F.col("precision") + F.col("recall")
    f1 = F.when(total > 0, 2 * F.col("precision") * F.col("recall") / F.nullif(total, F.lit(0.0))).otherwise(0.0)
    return scored.select("extractor", "kpi", "tp", "fp", "fn", "tn", "precision", "recall", f1.alias("f1"), ratio(F.col("valued"), F.col("matched")).alias("coverage"))


def macro(scored: DataFrame) -> DataFrame:
    """Per extractor: all true positives and the mean f1 over indicators."""
    return scored.groupBy("extractor").agg(F.sum("tp").alias("tp"), F.avg("f1").alias("macro_f1"))
