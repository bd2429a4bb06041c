"""Differences between two copies of one dataset, found by invertible Bloom lookup tables.

Every row becomes one element: the 64-bit hash of its key and of its compared fields.
Both copies are added to one table of cells, one with sign +1, the other with -1, so that
equal rows cancel and what is left is as large as the differences, not as the data. The
cells are peeled bucket by bucket, which reveals the keys of differing rows; only those
keys are fetched from both copies and compared field by field.

The number of cells follows the number of differences, which a signed-sum sketch of fixed
size estimates first. A bucket that can't be peeled gives up all its keys instead, so the
result is exact in any case.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import any_notation
from factloom.session import written

SKETCH_SLOTS = 4096
PER_BUCKET = 200
HASHES = 3
_HALF = 0xFFFFFFFF


@dataclass(frozen=True)
class Field:
    """A compared field. `numeric` fields may be numbers or text in any notation."""

    name: str
    numeric: bool = False


def _element_columns(df: DataFrame, key: Sequence[str], fields: Sequence[Field]) -> DataFrame:
    """k: hash of the key, h: hash of key and fields; for a number also its text, if it can't be read."""
    parts: list[Column] = []
    for f in fields:
        c = F.col(f.name)
        if f.numeric:
            number = c.cast("double") if dict(df.dtypes)[f.name] != "string" else any_notation(c)
            parts += [number + F.lit(0.0), F.when(number.isNull(), c.cast("string")), c.isNull()]
        else:
            parts += [c, c.isNull()]
    k = F.xxhash64(*[F.col(c) for c in key])
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])).withColumns(
        {"_k": k, "_h": F.xxhash64(*[F.col(c) for c in key], *parts)}
    )


def estimate_differences(signed: DataFrame) -> float:
    """About how many elements of `signed` (_k, _h, _s) don't cancel; 4096 sums, whatever the size."""
    mixed = F.xxhash64("_k", "_h", F.lit(7))
    sums = (
        signed.select(mixed.bitwiseAND(F.lit(SKETCH_SLOTS - 1).cast("long")).alias("slot"), (F.col("_s") * (1 - 2 * F.pmod(F.shiftright(mixed, 20), F.lit(2)))).alias("v"))
        .groupBy("slot")
        .agg(F.sum("v").alias("v"))
    )
    return sums.agg(F.coalesce(F.sum(F.col("v").cast("double") * F.col("v")), F.lit(0.0)).alias("d")).first()["d"]


def _hash_long(value: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """xxHash64 of one 8-byte integer under a seed, as the engine's xxhash64 does it."""
    p1, p2, p3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    p4, p5 = np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5)

    def rotated(x: np.ndarray, n: int) -> np.ndarray:
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    with np.errstate(over="ignore"):
        h = np.asarray(seed).astype(np.uint64) + p5 + np.uint64(8)
        h = rotated(h ^ (rotated(value.astype(np.uint64) * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def positions(k: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """The cell of each element in each of the sub-tables, one row per sub-table."""
    base = _hash_long(h, _hash_long(k, 42))
    return np.stack([j * width + (_hash_long(np.full(len(k), j, np.int64), base).astype(np.int64) % width + width) % width for j in range(HASHES)])


def _cells(signed: DataFrame, buckets: int, width: int) -> DataFrame:
    """The summed cells that hold anything."""
    at = F.array(*[j * width + F.pmod(F.xxhash64("_k", "_h", F.lit(j).cast("long")), F.lit(width)) for j in range(HASHES)])
    half = lambda c, name: [F.sum(F.col("_s") * F.shiftrightunsigned(c, 32)).alias(f"{name}1"), F.sum(F.col("_s") * F.col(c).bitwiseAND(F.lit(_HALF).cast("long"))).alias(f"{name}0")]
    summed = (
        signed.select(F.pmod("_k", F.lit(buckets)).alias("bucket"), F.explode(at).alias("cell"), "_k", "_h", "_s")
        .groupBy("bucket", "cell")
        .agg(F.sum("_s").alias("n"), *half("_k", "k"), *half("_h", "h"))
    )
    return summed.where("n != 0 or k1 != 0 or k0 != 0 or h1 != 0 or h0 != 0")


def peel(cells: np.ndarray, sums: np.ndarray, width: int) -> tuple[np.ndarray, bool]:
    """Keys found in one bucket's cells, and whether nothing was left.

    `sums` has a row per cell: count and the two halves of key hash and row hash. A cell
    is pure if its sums are multiples of its count and its element belongs there, so an
    element held several times on one side is found as well.
    """
    table = np.zeros((HASHES * width, 5), dtype=np.int64)
    table[cells] = sums
    found: list[np.ndarray] = []
    for _ in range(4 * HASHES * width):
        live = np.flatnonzero(table[:, 0])
        n = table[live, 0]
        whole = (table[live, 1:] % n[:, None] == 0).all(axis=1)
        parts = table[live, 1:] // n[:, None]
        whole &= ((parts >= 0) & (parts <= _HALF)).all(axis=1)
        live, n, parts = live[whole], n[whole], parts[whole].astype(np.uint64)
        k = ((parts[:, 0] << np.uint64(32)) | parts[:, 1]).astype(np.int64)
        h = ((parts[:, 2] << np.uint64(32)) | parts[:, 3]).astype(np.int64)
        at = positions(k, h, width)
        pure = (at == live).any(axis=0)
        if not pure.any():
            break
        _, first = np.unique(np.stack([k[pure], h[pure]], axis=1), axis=0, return_index=True)
        take = np.flatnonzero(pure)[first]
        found.append(k[take])
        for j in range(HASHES):
            np.subtract.at(table, at[j, take], np.column_stack([n[take], parts[take].astype(np.int64) * n[take, None]]))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64), not table.any()


def _peeled(cells: DataFrame, width: int) -> DataFrame:
    """(bucket, k): the revealed keys; k is NULL for a bucket that wasn't emptied."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        keys, clean = peel(batch["cell"].to_numpy(), batch[["n", "k1", "k0", "h1", "h0"]].to_numpy(), width)
        out = pd.DataFrame({"bucket": batch["bucket"].iloc[0], "k": pd.array(keys, dtype="Int64")})
        return out if clean else pd.concat([out, pd.DataFrame({"bucket": [batch["bucket"].iloc[0]], "k": pd.array([None], dtype="Int64")})])

    return cells.groupBy("bucket").applyInPandas(run, "bucket long, k long")


def differing_keys(signed: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, k) of differing keys, peeled once and written, and the number of buckets; `signed` is (_k, _h, _s)."""
    expected = estimate_differences(signed)
    buckets = max(1, -int(-1.1 * expected // PER_BUCKET))
    width = int(1.8 * PER_BUCKET / HASHES) + 8
    return written(_peeled(_cells(signed, buckets, width), width)), buckets


def diff_copies(left: DataFrame, right: DataFrame, key: Sequence[str], fields: Sequence[Field], rel_tol: float = 1e-9) -> DataFrame:
    """One row per difference: key columns, field, left_value, right_value.

    field is `missing_in_right`, `missing_in_left` or the name of a field that differs for
    a key held by both. Numbers within `rel_tol` relative are equal, text is compared
    exactly, NULL equals only NULL; a number that can't be read is compared as NaN with
    its own text kept. Of a key held several times on a side the least and the greatest
    value and the presence of NULL are compared, so a row repeated unchanged is no
    difference. Rows with a NULL in the key can't be matched: their keys are reported as
    `null_key_in_left` or `null_key_in_right`, with how often each stands there in the
    value's place. Other columns are ignored. Empty copies give only missing rows, or none.
    """
    names = [f.name for f in fields]
    sides = [_element_columns(df.select(*key, *names), key, fields) for df in (left, right)]
    signed = sides[0].select("_k", "_h", F.lit(1).cast("long").alias("_s")).unionAll(sides[1].select("_k", "_h", F.lit(-1).cast("long").alias("_s")))
    peeled, buckets = differing_keys(signed)
    revealed = peeled.where("k is not null").select(F.col("k").alias("_k")).distinct()
    unpeeled = peeled.where("k is null").select(F.col("bucket").alias("_bucket")).distinct()

    def fetched(df: DataFrame, side: int) -> DataFrame:
        typed = df.withColumns({f.name: F.struct(_number(df, f.name).alias("v"), F.col(f.name).cast("string").alias("t")) if f.numeric else F.struct(F.col(f.name).cast("string").alias("v")) for f in fields})
        typed = typed.withColumn("_bucket", F.pmod("_k", F.lit(buckets)))
        plain = typed.join(revealed, "_k", "left_semi")
        rest = typed.join(unpeeled, "_bucket", "left_semi").join(revealed, "_k", "left_anti")
        return plain.select(*key, *names, F.lit(side).alias("_side")).unionAll(rest.select(*key, *names, F.lit(side).alias("_side")))

    rows = fetched(sides[0], 0).unionAll(fetched(sides[1], 1))
    on = lambda side, c: F.when(F.col("_side") == side, c)
    aggregates = []
    for s in (0, 1):
        aggregates.append(F.count(on(s, F.lit(1))).alias(f"_n{s}"))
        for f in fields:
            c = F.col(f.name)
            held = on(s, F.when(c["t" if f.numeric else "v"].isNotNull(), c))
            aggregates += [F.min(held).alias(f"{f.name}_lo{s}"), F.max(held).alias(f"{f.name}_hi{s}"), (F.count(on(s, F.lit(1))) > F.count(held)).alias(f"{f.name}_null{s}")]
    both = rows.groupBy(*key).agg(*aggregates)
    text = lambda f, s: F.col(f"{f.name}_hi{s}")["t" if f.numeric else "v"]
    cases = [
        F.when(F.col("_n1") == 0, _case("missing_in_right", F.lit(None), F.lit(None))),
        F.when(F.col("_n0") == 0, _case("missing_in_left", F.lit(None), F.lit(None))),
    ]
    for f in fields:
        same = F.col(f"{f.name}_null0") == F.col(f"{f.name}_null1")
        for end in ("lo", "hi"):
            a, b = F.col(f"{f.name}_{end}0"), F.col(f"{f.name}_{end}1")
            same &= _numbers_equal(a, b, rel_tol) if f.numeric else a.eqNullSafe(b)
        cases.append(F.when((F.col("_n0") > 0) & (F.col("_n1") > 0) & ~same, _case(f.name, text(f, 0), text(f, 1))))
    found = both.select(*key, F.explode(F.filter(F.array(*cases), lambda c: c.isNotNull())).alias("c")).select(*key, "c.field", "c.left_value", "c.right_value")
    for side, df in (("left", left), ("right", right)):
        unmatched = df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])).groupBy(*key).agg(F.count(F.lit(1)).cast("string").alias("n"))
        nothing = F.lit(None).cast("string")
        found = found.unionAll(unmatched.select(*key, F.lit(f"null_key_in_{side}"), F.col("n") if side == "left" else nothing, F.col("n") if side == "right" else nothing))
    return found


def _number(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    return any_notation(c) if dict(df.dtypes)[name] == "string" else c.cast("double")


def _case(field: str, left: Column, right: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), left.cast("string").alias("left_value"), right.cast("string").alias("right_value"))


def _numbers_equal(a: Column, b: Column, rel_tol: float) -> Column:
    x, y = a["v"], b["v"]
    near = (x == y) | (F.abs(x - y) <= rel_tol * F.greatest(F.abs(x), F.abs(y)))
    unread = x.isNull() & y.isNull() & a["t"].eqNullSafe(b["t"])
    return F.coalesce(near, F.lit(False)) | unread
