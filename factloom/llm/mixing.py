"""Combining sources to target shares of the total size by Poisson replication.

Each document of a source is used as often as a hash-seeded draw of the Poisson
distribution says, cut at the cap, whose mean is set so that the draws of the source sum
to the size it needs. The uses are exploded and shuffled over the whole mix.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEED = 17
BINS = 1_024
BROADCAST_ENTRIES = 1_000_000
DRAW = "struct<base: int, table: array<double>>"


def cumulative(rate: float, cap: int) -> tuple[int, np.ndarray]:
    """(base, P(at most k) for k from base, below `cap`) of a Poisson variable.

    Below base the probability is 0 and past the last entry 1, to double precision; an
    infinite rate has the base `cap`, so every draw reaches the cap.
    """
    if math.isinf(rate):
        return cap, np.empty(0)
    if rate <= 0:
        return 0, np.empty(0)
    spread = 10 * math.sqrt(rate) + 20
    base, stop = max(0, math.floor(rate - spread)), min(cap, math.ceil(rate + spread))
    if base >= stop:
        return min(base, cap), np.empty(0)
    first = base * math.log(rate) - rate - math.lgamma(base + 1)
    steps = np.log(rate) - np.log(np.arange(base + 1, stop))
    return base, np.minimum(1.0, np.cumsum(np.exp(first + np.concatenate([[0.0], np.cumsum(steps)]))))


def expected_uses(rate: float, cap: int, beyond: Callable[[np.ndarray], np.ndarray] = lambda c: 1.0 - c) -> float:
    """Mean of the uses drawn at `rate` up to `cap`; `beyond` gives the share of size whose draw is at least a number in [0, 1]."""
    base, table = cumulative(rate, cap)
    return base * float(beyond(np.zeros(1))[0]) + float(beyond(table).sum())


def capped_mean(rate: float, cap: int) -> float:
    """Mean of a Poisson variable of mean `rate` cut at `cap`."""
    return expected_uses(rate, cap)


def rate_for(mean: float, cap: int, beyond: Callable[[np.ndarray], np.ndarray] = lambda c: 1.0 - c) -> float:
    """The Poisson mean whose draws cut at `cap` have the mean `mean`; infinite if only all draws at the cap reach it."""
    if mean <= 0 or cap <= 0:
        return 0.0
    if mean >= cap:
        return math.inf
    low, high = 0.0, 1.0
    while expected_uses(high, cap, beyond) < mean:
        if high > 4.0 * cap + 1_000.0:
            return math.inf
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if expected_uses(middle, cap, beyond) < mean else (low, middle)
    return (low + high) / 2


def share_beyond(masses: Sequence[float]) -> Callable[[np.ndarray], np.ndarray]:
    """The share of size whose draw is at least a number in [0, 1], from the size in each of equal bins of the draw."""
    held = np.asarray(masses, float)
    sums = np.concatenate([[0.0], np.cumsum(held)])
    edges = np.linspace(0.0, 1.0, len(sums))
    return lambda c: 1.0 - np.interp(c, edges, sums) / sums[-1]


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on `parts` alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def plan(sized: DataFrame, targets: DataFrame, id_col: str = "doc_id", seed: int = SEED, exact_shares: bool = False) -> DataFrame:
    """One row per source of `targets`: sizes, wanted size, `reachable`, attainable share, and the draw table.

    The mix is to be as large as all documents together. A source that falls short of its
    target there even with every document used max_repeats times isn't `reachable`; it is
    used in full and the others make up for it in proportion to their targets, as far as
    their caps allow. With `exact_shares` the mix is instead only as large as lets every
    source that has documents hold its share, that is, no larger than the scarcest allows.

    The draws of a source are known beforehand, as they come from hashes, so its rate is
    the one at which they sum to the wanted size, up to a bin of 1/1024 of it or a
    document. A target without documents has size 0. A source listed twice keeps its
    highest target. NULL shares count as 0 and NULL or negative caps as 0.
    """
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_repeats", F.lit(0)).alias("m"))).alias("t"))
    wanted = wanted.select("source", F.greatest(F.col("t.s").cast("double"), F.lit(0.0)).alias("target_share"), F.greatest(F.col("t.m"), F.lit(0)).cast("int").alias("max_repeats"))
    draw_bin = F.floor(uniform(F.col(id_col), F.lit(seed)) * BINS).cast("int")
    binned = sized.groupBy("source", draw_bin.alias("bin")).agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("d"))
    sizes = binned.groupBy("source").agg(F.sum("n").alias("available_tokens"), F.sum("d").alias("documents"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_by_bin"))
    total = sizes.agg(F.coalesce(F.sum("available_tokens"), F.lit(0)).alias("total_tokens"))
    joined = wanted.join(sizes, "source", "left").fillna(0, ["available_tokens", "documents"]).join(F.broadcast(total))
    need = F.col("target_share") * F.col("total_tokens")
    most = F.col("available_tokens").cast("double") * F.col("max_repeats")
    planned = joined.withColumn("reachable", need <= most).withColumn("_most", most)
    # One row per source: of sources in the order in which they reach their caps, those before have done so.
    level = F.when(F.col("target_share") > 0, F.col("_most") / F.col("target_share"))
    every, before = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("_level"), "source")
    planned = planned.withColumn("_level", level)
    if exact_shares:
        size = F.least(F.min(F.when(F.col("documents") > 0, F.col("_level"))).over(every), F.col("total_tokens").cast("double"))
    else:
        full = F.coalesce(F.sum("_most").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        left = F.sum("target_share").over(before.rowsBetween(0, W.unboundedFollowing))
        own = (F.col("total_tokens") * F.sum("target_share").over(every) - full) / F.nullif(left, F.lit(0.0))
        planned = planned.withColumn("_own", own)
        size = F.coalesce(F.min(F.when(F.col("_own") <= F.col("_level"), F.struct("_level", "_own"))).over(every)["_own"], F.max("_level").over(every))
    tokens = F.least(F.col("target_share") * F.coalesce(size, F.lit(0.0)), F.col("_most"))
    planned = planned.withColumn("wanted_tokens", tokens).withColumn("uses", F.when(F.col("available_tokens") > 0, F.col("wanted_tokens") / F.col("available_tokens")).otherwise(0.0))
    sum_wanted = F.sum("wanted_tokens").over(every)
    planned = planned.withColumn("attainable_share", F.when(sum_wanted > 0, F.col("wanted_tokens") / sum_wanted).otherwise(0.0))

    @F.pandas_udf(DRAW)
    def draws(uses: pd.Series, caps: pd.Series, bins: pd.Series) -> pd.DataFrame:
        rows = []
        for u, cap, held in zip(uses, caps, bins, strict=True):
            masses = [0 if h is None or np.isnan(h) else h for h in held] if held is not None else []
            rows.append(cumulative(rate_for(u, cap, share_beyond(masses)) if sum(masses) else 0.0, cap))
        return pd.DataFrame({"base": [b for b, _ in rows], "table": [t.tolist() for _, t in rows]})

    by_bin = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.try_element_at("_by_bin", b), F.lit(0)).cast("double"))
    drawn = planned.withColumn("draw", draws("uses", "max_repeats", F.when(F.col("_by_bin").isNotNull(), by_bin)))
    return drawn.select("source", "target_share", "max_repeats", "available_tokens", "documents", "total_tokens", "reachable", "wanted_tokens", "attainable_share", "uses", "draw")


def mix(sized: DataFrame, planned: DataFrame, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The chosen uses in their final order: position key, id_col, source, copy_no (from 0), tokens.

    Documents of sources without target, or without source, aren't used. Rows are sorted
    by a hash of id and copy, which is the global shuffle. `id_col` and `seed` must be
    those of the plan, which is broadcast only if its draw tables have at most 1,000,000
    entries.
    """
    rates = planned.select("source", "draw")
    entries = rates.agg(F.sum(F.size("draw.table") + 1).alias("n")).first()["n"] or 0
    if entries <= BROADCAST_ENTRIES:
        rates = F.broadcast(rates)
    u = uniform(F.col(id_col), F.lit(seed))
    drawn = sized.select(id_col, "source", "tokens").join(rates, "source").withColumn("uses", F.col("draw.base") + F.size(F.filter("draw.table", lambda c: c <= u)))
    copies = drawn.where("uses > 0").select(id_col, "source", "tokens", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("copy_no"))
    return copies.select(F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col("copy_no")).alias("shuffle_key"), id_col, "source", "copy_no", "tokens").orderBy("shuffle_key", id_col, "copy_no")


def shares(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """Per source: target share, the share attainable within all caps, that of the mix, and what it is of the size of all documents; tokens, documents used, uses of the most used one, and whether the target is reachable."""
    used = mixed.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count_if(F.col("copy_no") == 0).alias("used_documents"), (F.max("copy_no") + 1).alias("most_uses"))
    total = used.agg(F.sum("mixed_tokens").alias("mix_total"))
    full = planned.join(used, "source", "left").fillna(0, ["mixed_tokens", "used_documents", "most_uses"]).join(F.broadcast(total))
    share = F.when(F.col("mix_total") > 0, F.col("mixed_tokens") / F.col("mix_total")).otherwise(0.0)
    planned_share = F.when(F.col("total_tokens") > 0, F.col("mixed_tokens") / F.col("total_tokens")).otherwise(0.0)
    return full.select("source", "target_share", "attainable_share", share.alias("actual_share"), planned_share.alias("share_of_plan"), "mixed_tokens", "documents", "used_documents", "most_uses", "max_repeats", "reachable")
