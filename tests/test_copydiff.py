import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import copydiff
from factloom.operators.copydiff import Field, diff_copies

FIELDS = [Field("value", numeric=True), Field("tag")]


def found(spark, left, right, schema=("id long, value double, tag string", "id long, value string, tag string")):
    a, b = spark.createDataFrame(left, schema[0]), spark.createDataFrame(right, schema[1])
    return {(r["id"], r["field"]) for r in diff_copies(a, b, ["id"], FIELDS).collect()}


def test_cases(spark):
    left = [(1, 1.0, "a"), (2, 2.0, "a"), (3, None, "a"), (4, 4.0, None), (5, 5.0, "x"), (7, 1e9, "a"), (8, 8.0, "a"), (None, 1.0, "a")]
    right = [(1, "1.0E0", "a"), (1, "1.0", "a"), (2, "2.1", "b"), (3, None, ""), (4, "4", None), (6, "6", "a"), (7, "1000000000.1", "a"), (8, "eight", "a"), (8, "8", "a")]
    assert found(spark, left, right) == {(2, "value"), (2, "tag"), (3, "tag"), (5, "missing_in_right"), (6, "missing_in_left"), (8, "value"), (None, "null_key_in_left")}


def test_empty_and_extra_columns(spark):
    assert found(spark, [], []) == set()
    assert found(spark, [(1, 1.0, "a")], []) == {(1, "missing_in_right")}
    a = spark.createDataFrame([(1, 1.0, "a", 5, 6)], "id long, value double, tag string, bucket int, _k int")
    assert diff_copies(a, a.withColumn("bucket", F.lit(9)), ["id"], FIELDS).count() == 0


def test_many_against_brute_force(spark):
    rng = np.random.default_rng(1)
    left = [(i, float(i), f"t{i % 7}") for i in range(3000)]
    right, expected = [], set()
    for i, v, t in left:
        kind = rng.integers(0, 12)
        if kind == 0:
            expected.add((i, "missing_in_right"))
        elif kind == 1:
            right.append((i, str(v + 1), t))
            expected.add((i, "value"))
        elif kind == 2:
            right += [(i, repr(v), t)] * 3
        else:
            right.append((i, repr(v), t))
    assert found(spark, left, right) == expected


def test_hash_is_the_engines(spark):
    rows = spark.range(50).select(F.xxhash64("id").alias("k"), F.xxhash64(F.col("id") + 1).alias("h")).select("k", "h", *[(j * 37 + F.pmod(F.xxhash64("k", "h", F.lit(j).cast("long")), F.lit(37))).alias(f"p{j}") for j in range(3)]).toPandas()
    at = copydiff.positions(rows["k"].to_numpy(), rows["h"].to_numpy(), 37)
    assert (at == rows[["p0", "p1", "p2"]].to_numpy().T).all()


def test_unpeeled_bucket_gives_all_its_keys(spark, monkeypatch):
    monkeypatch.setattr(copydiff, "estimate_differences", lambda signed: 1.0)
    left = [(i, float(i), "a") for i in range(800)]
    assert found(spark, left, [(i, str(i + 1), "a") for i in range(800)]) == {(i, "value") for i in range(800)}


@pytest.mark.parametrize("copies", [1, 2, 5])
def test_peel_finds_repeats(copies):
    width = 20
    k, h = np.array([11, -5], np.int64), np.array([3, 2**62], np.int64)
    at = copydiff.positions(k, h, width)
    table = np.zeros((60, 5), np.int64)
    for e in range(2):
        parts = [int(np.uint64(k[e].astype(np.uint64) >> np.uint64(32))), int(k[e]) & 0xFFFFFFFF, int(h[e]) >> 32, int(h[e]) & 0xFFFFFFFF]
        for j in range(3):
            table[at[j, e]] += np.array([1, *parts]) * copies
    cells = np.flatnonzero(table.any(axis=1))
    keys, clean = copydiff.peel(cells, table[cells], width)
    assert clean and set(keys) == {11, -5}
