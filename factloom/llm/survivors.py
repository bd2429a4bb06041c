"""Best representative of each group of duplicate records, chosen field by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUST_ROWS = 10_000


def even_spelling(name: Column) -> Column:
    """`name` without regard to letter case, spaces, hyphens and underscores."""
    return F.lower(F.regexp_replace(name, r"(?U)[\s_\-‐‑­​]", ""))


def with_trust(records: DataFrame, trust: DataFrame) -> DataFrame:
    """`records` with the trust of their extractor, NULL for an unknown one.

    The trust table is broadcast only if it has at most 10,000 rows; beyond that the
    planner joins it as any other table. Of an extractor listed twice the highest counts.
    """
    best = trust.groupBy("extractor").agg(F.max("trust").alias("_trust"))
    if trust.limit(TRUST_ROWS + 1).count() <= TRUST_ROWS:
        best = F.broadcast(best)
    return records.drop("_trust").join(best, "extractor", "left")


def survivors(records: DataFrame, group: dict[str, Column], id_col: str, attributes: Sequence[str], flags: str = "flags", confidence: str = "confidence", recency: str = "extracted_at") -> DataFrame:
    """One row per group, from a single aggregation that combines on the map side.

    `records` carries `_trust` (with_trust). For each attribute the surviving value is the
    one of the greatest (non-null, trust, recency, confidence, value). Of whole records the
    best is the greatest (value present, fewest flags, confidence, recency, trust); it is
    `dominant_id` if it is at least as good as every other record in each of the five and
    no other record equals it in all, else that is NULL. `best_id` is always given; ties go
    to the least id. `n` counts the group.

    NULL flags count as none, NULL or NaN confidence, NULL time and unknown trust are the
    lowest. Groups with a NULL key part are left out: nothing says that they are one fact.
    """
    first = attributes[0]
    score = F.when(~F.isnan(confidence), F.col(confidence))
    prepared = records.select(
        *[c.alias(n) for n, c in group.items()],
        F.col(id_col).alias("_id"),
        F.col(first).isNotNull().alias("_has"),
        (-F.coalesce(F.when(F.col(flags).isNotNull(), F.size(flags)), F.lit(0))).alias("_clean"),
        score.alias("_conf"),
        F.col(recency).alias("_at"),
        F.col("_trust"),
        *[F.col(a).alias(f"_a_{a}") for a in attributes],
    )
    for name in group:
        prepared = prepared.where(F.col(name).isNotNull())
    criteria = ["_has", "_clean", "_conf", "_at", "_trust"]
    value = lambda a: F.max(F.struct(F.col(f"_a_{a}").isNotNull().alias("held"), F.col("_trust"), F.col("_at"), F.col("_conf"), F.col(f"_a_{a}").alias("v")))
    grouped = prepared.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct(*criteria, F.col("_id").alias("id"))).alias("_top"),
        F.max(F.struct(*criteria, (-F.col("_id")).alias("id"))).alias("_least"),
        *[F.max(c).alias(f"_max{c}") for c in criteria],
        *[value(a).alias(f"_best_{a}") for a in attributes],
    )
    dominates = F.col("_top.id") == -F.col("_least.id")
    for c in criteria:
        dominates &= F.col(f"_top.{c}").eqNullSafe(F.col(f"_max{c}"))
    return grouped.select(
        *group, "n", (-F.col("_least.id")).alias("best_id"), F.when(dominates, F.col("_top.id")).alias("dominant_id"), *[F.col(f"_best_{a}.v").alias(a) for a in attributes]
    )
