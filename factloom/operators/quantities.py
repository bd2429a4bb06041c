"""Quantities recorded in different units and scales, converted to the canonical unit of their indicator.

What a record states decides: its unit field, the unit printed in its text, and whether
the value is the printed number or one converted already. Where nothing is stated, the
unit is assigned by the posterior of a mixture on the log scale: one distribution per
indicator in canonical units, shifted by every known conversion factor, fitted to all
values with and without units. Within one company and year a value mostly repeats another
one; how often is estimated, and weighs the known values near each candidate against the
indicator's normal distribution. Posteriors below 0.95 are flagged as uncertain.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.measures import CELL_SCALES, PLAIN, SCALED, folded, mentions, numbers, read_unit
from factloom.session import fits_broadcast, small, written

REGISTRY_ROWS = 10_000
CLOSE = 6e-4
BIN = 0.05
SURE = 0.95
# Width in log10 of the cells in which known values of a company and year are counted.
CELL = 0.002
CACHED = 100_000
BROADCAST_GROUPS = 500_000
BROKEN = re.compile(r"(?<=\w)[-‐‑¬\xad][ \t]*\n[ \t]*(?=\w)")
BRACKETED = re.compile(r"[(\[{]([^()\[\]{}]*(?:\([^()]*\)[^()\[\]{}]*)*)[)\]}]")
RESULT = "src string, row_id long, row_no int, kpi string, company string, report_year int, values array<double>, unit string, factors array<double>, basis string"
RESULT_TYPES = {"src": pa.string(), "row_id": pa.int64(), "row_no": pa.int32(), "kpi": pa.string(), "company": pa.string(), "report_year": pa.int32(), "values": pa.list_(pa.float64()), "unit": pa.string(), "factors": pa.list_(pa.float64()), "basis": pa.string()}


@dataclass(frozen=True, eq=False)
class Registry:
    """Indicators with canonical unit and names, and unit factors."""

    canonical: dict[str, str]
    names: tuple[tuple[str, str], ...]
    negative: dict[str, tuple[str, ...]]
    factors: dict[str, tuple[str, float]]

    def factor(self, unit: str, times: float, kpi: str | None) -> float | None:
        """Factor from `times` `unit` to the canonical unit of `kpi`, or None if it can't be converted."""
        canonical, factor = self.factors.get(unit, (None, 0.0))
        return factor * times if canonical is not None and canonical == self.canonical.get(kpi or "") else None

    @lru_cache(CACHED)  # noqa: B019
    def indicator(self, label: str) -> tuple[str, int] | None:
        """The indicator whose longest name is in a folded label, and where that ends."""
        for name, kpi in self.names:
            at = label.find(name)
            if at >= 0 and not any(t in label for t in self.negative[kpi]):
                return kpi, at + len(name)
        return None


def registry(kpis: DataFrame, unit_factors: DataFrame) -> Registry:
    """The registry from its two tables, each of at most 10,000 rows."""
    if not (fits_broadcast(kpis, REGISTRY_ROWS) and fits_broadcast(unit_factors, REGISTRY_ROWS)):
        raise ValueError("the registry of indicators or units is too large to be sent to every task")
    rows, units = kpis.collect(), unit_factors.collect()
    names = {(folded(n), r["kpi"]) for r in rows for n in [r["query"], *(r["queries"] or [])] if n}
    return Registry(
        {r["kpi"]: r["canonical_unit"] for r in rows},
        tuple(sorted(names, key=lambda x: (-len(x[0]), x))),
        {r["kpi"]: tuple(t.lower() for t in r["negative_tokens"] or []) for r in rows},
        {u["unit"]: (u["canonical_unit"], u["factor"]) for u in units},
    )


def _close(a: float, b: float) -> bool:
    return abs(a - b) <= CLOSE * max(abs(a), abs(b))


def judge(value: float | None, unit: str | None, text: str | None, kpi: str | None, known: Registry) -> tuple[str | None, float | None, str]:
    """Unit, factor and basis of one recorded value.

    basis is `stated` (unit field), `printed` (the value is the number the text prints in
    another unit), `converted` (the text prints it in another unit, the value is
    canonical), `contrary` (a unit is stated that can't be converted), `unknown` (no unit
    is stated) or `missing` (no value).
    """
    if value is None or math.isnan(value):
        return None, None, "missing"
    own = read_unit(unit)
    blank = not (unit or "").strip(" .,;:")
    own_factor = known.factor(*own, kpi) if own else None
    if own_factor is None and not blank:
        return unit, None, "contrary"
    if own_factor is not None and own_factor != 1.0:
        return unit, own_factor, "stated"
    if not text:
        return (unit, own_factor, "stated") if own else (None, None, "unknown")
    t = folded(BROKEN.sub("", text))
    found = [(a, b, known.factor(u, n, kpi), t[a:b]) for a, b, u, n in mentions(t)]
    found = [m for m in found if m[2] is not None]
    values = [n for _, _, n in numbers(t)]
    values += [n for a, _, _, _ in found for _, _, n in numbers(t[:a])[-1:]]
    printed = any(_close(n, value) for n in values)
    for _, _, factor, spelled in found:
        if any(_close(n * factor, value) for n in values) and (own or not printed):
            return (unit, 1.0, "stated") if own and factor == 1.0 else (spelled, 1.0, "converted" if factor != 1.0 else "printed")
    if found and (printed or not values or not own):
        return found[0][3], found[0][2], "printed"
    return (unit, own_factor, "stated") if own else (None, None, "unknown")


def _listed(column: pa.Array) -> list:
    return column.to_pandas().tolist()


def _one_each(values: list[float | None]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(range(len(values) + 1), pa.int32()), pa.array(values, pa.float64()))


def _result(batch: pa.RecordBatch, at: pa.Array | None, **own: pa.Array) -> pa.RecordBatch:
    """A batch of RESULT: columns of the rows `at` of `batch`, or of all, and what is given."""
    columns = []
    for name, kind in RESULT_TYPES.items():
        column = own.get(name)
        if column is None:
            column = batch.column("id" if name == "row_id" else name).cast(kind)
            column = column if at is None else column.take(at)
        columns.append(column)
    return pa.RecordBatch.from_arrays(columns, list(RESULT_TYPES))


def _records(src: str, known: Registry, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [None if v != v else v for v in batch.column("value").to_numpy(zero_copy_only=False).tolist()]
        units, factors, bases = [], [], []
        for value, unit, text, kpi in zip(values, _listed(batch.column("unit")), _listed(batch.column("text")), _listed(batch.column("kpi")), strict=True):
            spelled, factor, basis = judge(value, unit, text, kpi, known)
            units.append(spelled)
            factors.append(factor)
            bases.append(basis)
        n = len(values)
        yield _result(batch, None, src=pa.array([src] * n, pa.string()), row_no=pa.array([-1] * n, pa.int32()), values=_one_each(values), unit=pa.array(units, pa.string()), factors=_one_each(factors), basis=pa.array(bases, pa.string()))


@lru_cache(CACHED)
def _folded_label(text: str) -> str:
    return folded(text)


@lru_cache(CACHED)
def _label_unit(text: str, kpi: str, known: Registry) -> tuple[str, float] | None:
    """The unit of the indicator's kind that a folded label ends with, in brackets or not."""
    for part in reversed(BRACKETED.findall(text)):
        if (own := read_unit(part)) and known.factor(*own, kpi) is not None:
            return own
    for unit, times in _trailing(text):
        if known.factor(unit, times, kpi) is not None:
            return unit, times
    return None


def _trailing(text: str) -> list[tuple[str, float]]:
    """Units at the end of a folded text, its last brackets counted in or not."""
    end = len(text.rstrip(" .,;:"))
    inner = len(text.rstrip(" .,;:)]}"))
    return [(unit, times) for _, b, unit, times in mentions(text) if b in (end, inner)]


@lru_cache(CACHED)
def _header_unit(header: str) -> tuple[str, float] | None:
    own = read_unit(header)
    if own:
        return own
    for part in BRACKETED.findall(header or ""):
        if own := read_unit(part):
            return own
    return next(iter(_trailing(folded(header or ""))), None)


def table_quantities(headers: list[str], rows: list[list[str]], known: Registry) -> list[tuple[int, str, list[float], str | None, list[float | None], str]]:
    """(row_no, kpi, values, unit, factors, basis) of each row that names an indicator and holds a number.

    The unit is sought in the value's cell, the unit column, the label, the last row that
    states nothing but a unit, the value's column and the other headers. A scale printed
    in a cell counts for that cell.
    """
    headers = [h or "" for h in headers]
    unit_cols = [i for i, h in enumerate(headers) if folded(h).strip(" .:") in ("unit", "units")]
    by_header = [_header_unit(h) for h in headers]
    section: tuple[str, float] | None = None
    found = []
    for no, row in enumerate(rows):
        cells = [c or "" for c in row or []]
        if not "".join(cells).strip():
            continue
        label = _folded_label(cells[0])
        named = known.indicator(label)
        if named is None:
            if not any(c.strip() for c in cells[1:]) and (own := read_unit(cells[0])):
                section = own
            continue
        kpi, end = named
        column_unit, stated = None, False
        for i in unit_cols or ([1] if len(cells) > 1 and read_unit(cells[1]) else []):
            if i < len(cells) and cells[i].strip():
                column_unit, stated = read_unit(cells[i]), True
        inherited = _label_unit(label[end:], kpi, known)
        if inherited is None and section and known.factor(*section, kpi) is not None:
            inherited = section
        values, factors, spelled = [], [], None
        base = column_unit or (None if stated else inherited)
        base_factor = known.factor(*base, kpi) if base else None
        for i, cell in enumerate(cells[1:], 1):
            if i in unit_cols or not unit_cols and i == 1 and stated:
                continue
            if PLAIN.fullmatch(cell):
                t, stop, value = cell, len(cell), float(cell.replace(",", ""))
                if base:
                    values.append(value)
                    factors.append(base_factor)
                    spelled = spelled or base[0]
                    continue
            elif read := numbers(t := folded(cell)):
                _, stop, value = read[0]
            else:
                continue
            scale, rest = 1.0, t[stop:].strip()
            own = read_unit(rest) if rest else None
            if own is None and rest and (m := SCALED.match(t, stop)):
                scale, rest = CELL_SCALES[m[1]], t[m.end() :].strip()
                own = read_unit(rest) if rest else None
            unit = own or base
            if unit is None and not stated:
                at = by_header[i] if i < len(by_header) else None
                unit = next((u for u in (at, *by_header) if u and known.factor(*u, kpi) is not None), None)
            factor = known.factor(*unit, kpi) if unit else None
            values.append(value)
            factors.append(None if factor is None else factor * scale)
            spelled = spelled or (unit[0] if unit else None)
        if values:
            basis = "stated" if any(f is not None for f in factors) else "contrary" if spelled or stated else "unknown"
            found.append((no, kpi, values, spelled, factors, basis))
    return found


def _tables(known: Registry, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, rows = [], []
        for i, (headers, body) in enumerate(zip(batch.column("headers").to_pandas(), batch.column("rows").to_pandas(), strict=True)):
            if body is None:
                continue
            own = table_quantities(headers.tolist() if headers is not None else [], [r.tolist() if r is not None else [] for r in body], known)
            rows += own
            at += [i] * len(own)
        no, kpi, values, unit, factors, basis = zip(*rows, strict=True) if rows else ((),) * 6
        yield _result(
            batch,
            pa.array(at, pa.int64()),
            src=pa.array(["report_tables"] * len(rows), pa.string()),
            row_no=pa.array(no, pa.int32()),
            kpi=pa.array(kpi, pa.string()),
            values=pa.array(values, pa.list_(pa.float64())),
            unit=pa.array(unit, pa.string()),
            factors=pa.array(factors, pa.list_(pa.float64())),
            basis=pa.array(basis, pa.string()),
        )


def quantities(extractions: DataFrame, gold_labels: DataFrame, report_tables: DataFrame, known: Registry) -> DataFrame:
    """One row per record, label and table row with an indicator: values, stated unit, factors and basis.

    factors has a number, or NULL, for each of values. NULL values and empty tables give
    basis `missing` or no row. row_no is -1 for records and labels.
    """
    share = extractions.sparkSession.sparkContext.broadcast(known)
    part = lambda df, key, text: df.select(F.col(key).alias("id"), "kpi", "company", "report_year", F.col("value").cast("double").alias("value"), "unit", F.col(text).alias("text"))
    a = part(extractions, "extraction_id", "source_snippet").mapInArrow(lambda it: _records("extractions", share.value, it), RESULT)
    b = part(gold_labels, "label_id", "notes").mapInArrow(lambda it: _records("gold_labels", share.value, it), RESULT)
    c = report_tables.select(F.col("table_id").alias("id"), "company", "report_year", "headers", "rows").mapInArrow(lambda it: _tables(share.value, it), RESULT)
    return a.unionAll(b).unionAll(c)


def changed(converted: DataFrame) -> DataFrame:
    """(src, row_id, row_no) of the quantities of `convert` with a stated or printed unit whose number changes in the canonical unit."""
    return converted.where(F.col("basis").isin("stated", "printed") & (F.abs(F.col("factor") - 1.0) > 1e-9)).select("src", "row_id", "row_no").distinct()


@dataclass(frozen=True)
class Mixture:
    """Of one indicator: mean and deviation of log10 canonical values, and the weight of each log10 factor."""

    mean: float
    deviation: float
    offsets: tuple[float, ...]
    weights: tuple[float, ...]


def fit_mixture(known: list[tuple[float, float, float]], unknown: list[tuple[float, float]], offsets: list[float], rounds: int = 40) -> Mixture:
    """Expectation maximisation on binned values.

    `known` holds (log10 value, log10 factor, count), `unknown` (log10 value, count). All
    components share mean and deviation, shifted by minus their log10 factor.
    """
    shifts = np.array(sorted(set(offsets) | {0.0}))
    x = np.array([v for v, _ in unknown])
    n = np.array([c for _, c in unknown], float)
    canonical = np.array([v + f for v, f, _ in known])
    m = np.array([c for _, _, c in known], float)
    base = np.array([sum(c for _, f, c in known if abs(f - s) < 1e-6) + 1.0 for s in shifts])
    mean = float((canonical * m).sum() / m.sum()) if m.sum() else float((x * n).sum() / max(n.sum(), 1.0))
    deviation = max(0.3, float(np.sqrt(((canonical - mean) ** 2 * m).sum() / m.sum()))) if m.sum() else 1.5
    weights = base / base.sum()
    for _ in range(rounds if len(x) else 0):
        z = x[:, None] + shifts[None, :]
        log = np.log(weights) - (z - mean) ** 2 / (2 * deviation**2)
        post = np.exp(log - log.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        mass = post * n[:, None]
        weights = (base + mass.sum(axis=0)) / (base.sum() + n.sum())
        total = m.sum() + n.sum()
        mean = float(((canonical * m).sum() + (z * mass).sum()) / total)
        deviation = max(0.3, float(np.sqrt((((canonical - mean) ** 2 * m).sum() + ((z - mean) ** 2 * mass).sum()) / total)))
    return Mixture(mean, deviation, tuple(shifts.tolist()), tuple(weights.tolist()))


def densities(log_value: float, mixture: Mixture) -> list[tuple[float, float, float]]:
    """(log10 factor, its weight, density of the indicator's values there) of each unit a value may have."""
    deviation = mixture.deviation
    return [(s, w, math.exp(-((log_value + s - mixture.mean) ** 2) / (2 * deviation**2)) / (deviation * math.sqrt(2 * math.pi))) for s, w in zip(mixture.offsets, mixture.weights, strict=True)]


def even_company(name: Column) -> Column:
    """A company's name without regard to case, blanks, hyphens and underscores."""
    return F.lower(F.regexp_replace(name, r"(?U)[\s_\-]", ""))


def log_cell(c: Column) -> Column:
    """The cell of a canonical value."""
    return F.floor(F.log10(c) / CELL).cast("long")


def repeating_share(cells: DataFrame, group: list[str]) -> float:
    """How often a known value lies in or next to the cell of another one of its group, of those that have another one; `cells` is (group, cell, n)."""
    own = W.partitionBy(*group)
    order = own.orderBy("cell")
    beside = F.coalesce(F.col("cell") - F.lag("cell").over(order) == 1, F.lit(False)) | F.coalesce(F.lead("cell").over(order) - F.col("cell") == 1, F.lit(False))
    judged = cells.withColumn("total", F.sum("n").over(own)).withColumn("near", F.when((F.col("n") > 1) | beside, F.col("n")).otherwise(0)).where("total > 1")
    found = judged.agg(F.sum("near").alias("near"), F.sum("n").alias("n")).first()
    return (found["near"] or 0) / found["n"] if found["n"] else 0.0


def convert(found: DataFrame, known: Registry) -> DataFrame:
    """One row per value: src, row_id, row_no, value_no, kpi, value, unit, factor, canonical_value, basis, probability, uncertain.

    Values without a stated unit get basis `posterior`, the likeliest factor and its
    probability; they are `uncertain` below 0.95, and so is everything contrary, which
    keeps its value and gets no canonical one. Values that are NULL, zero or negative have
    no logarithm; without unit they, and values of unlisted indicators, stay `unknown`.
    Known values of the same company, year and indicator are counted in cells of 0.002 in
    log10, so a group of any size is a table of cells and is never brought together.
    """
    read = written(found.withColumn("company", even_company(F.col("company"))))
    each = read.select("*", F.posexplode(F.arrays_zip("values", "factors")).alias("value_no", "v")).select(
        "src", "row_id", "row_no", "value_no", "kpi", "company", "report_year", F.col("v.values").alias("value"), "unit", F.col("v.factors").alias("factor"), "basis"
    )
    positive = each.where("value > 0")
    log_value = F.log10("value")
    stated = positive.where("factor is not null")
    guessable = F.coalesce((F.col("basis") == "unknown") & (F.col("value") > 0) & F.col("kpi").isin(*known.canonical), F.lit(False))
    # At most one row per indicator, factor and bin of 0.05 in log10: bounded by the registry, not by the data.
    bins = (
        positive.where(F.col("factor").isNotNull() | (F.col("basis") == "unknown"))
        .groupBy("kpi", F.round(F.log10("factor"), 6).alias("f"), F.floor(log_value / BIN).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .toPandas()
    )
    mixtures = {}
    for kpi, own in bins.groupby("kpi"):
        at = (own["bin"].to_numpy(float) + 0.5) * BIN
        is_known = own["f"].notna().to_numpy()
        f, n = own["f"].to_numpy(float), own["n"].to_numpy(float)
        offsets = [round(math.log10(x), 6) for c, x in known.factors.values() if c == known.canonical.get(kpi)]
        mixtures[kpi] = fit_mixture(list(zip(at[is_known], f[is_known], n[is_known], strict=True)), list(zip(at[~is_known], n[~is_known], strict=True)), offsets)
    columns = ["src", "row_id", "row_no", "value_no", "kpi", "value", "unit"]
    guessed = written(_assigned(written(each.where(guessable)), stated, mixtures).select(*columns, "factor", F.lit("posterior").alias("basis"), "probability"))
    rest = each.where(~guessable).select(*columns, "factor", "basis", F.when(F.col("factor").isNotNull(), F.lit(1.0)).alias("probability"))
    return rest.unionByName(guessed).select(*columns, "factor", (F.col("value") * F.col("factor")).alias("canonical_value"), "basis", "probability", (F.coalesce("probability", F.lit(0.0)) < SURE).alias("uncertain"))


def _assigned(asked: DataFrame, stated: DataFrame, mixtures: dict[str, Mixture]) -> DataFrame:
    """`asked` with the likeliest factor and its probability, from `mixtures` and the `stated` values of the same company, year and indicator.

    How often values repeat is estimated from all groups with a value to judge. Equal values of a group are judged once. Values without company or year are judged by
    the mixture of their indicator alone.
    """
    group = ["company", "report_year", "kpi"]
    groups = small(asked.select(*group).distinct(), BROADCAST_GROUPS)
    cells = written(stated.join(groups, group, "left_semi").groupBy(*group, log_cell(F.col("value") * F.col("factor")).alias("cell")).agg(F.count(F.lit(1)).alias("n")))
    repeats = repeating_share(cells, group)
    totals = cells.groupBy(*group).agg(F.sum("n").alias("total"))
    share = asked.sparkSession.sparkContext.broadcast(mixtures)

    @F.pandas_udf("array<struct<offset: double, weight: double, density: double>>")
    def candidates(kpi: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([densities(math.log10(v), share.value[k]) for k, v in zip(kpi, value, strict=True)])

    keyed = asked.withColumns({"_company": F.coalesce("company", F.lit("")), "_year": F.coalesce("report_year", F.lit(-1)), "_held": F.col("company").isNotNull() & F.col("report_year").isNotNull()})
    key = ["_held", "_company", "_year", "kpi", "value"]
    # Without a company the group is NULL, which meets no known values.
    different = keyed.groupBy(*key).agg(F.first("company").alias("company"), F.first("report_year").alias("report_year")).withColumn("report_year", F.when(F.col("_held"), F.col("report_year")))
    each = different.join(totals, group, "left").withColumn("c", F.explode(candidates("kpi", "value"))).select(*key, *group[:2], "total", "c.*")
    beside = each.where("total is not null").withColumn("cell", F.explode(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.floor((F.log10("value") + F.col("offset")) / CELL).cast("long") + d)))
    near = beside.join(cells, [*group, "cell"]).groupBy(*key, "offset").agg(F.sum("n").alias("near"))
    density = F.when(F.col("total").isNull(), F.col("density")).otherwise(repeats * F.coalesce("near", F.lit(0)) / F.col("total") / (3 * CELL) + (1 - repeats) * F.col("density"))
    # Far from everything known no density is left; there the weights alone decide.
    weighed = each.join(near, [*key, "offset"], "left").withColumn("score", F.col("weight") * (density + 1e-300))
    best = weighed.groupBy(*key).agg(F.max_by("offset", F.struct("score", (-F.abs("offset")).alias("o"), "offset")).alias("offset"), (F.max("score") / F.sum("score")).alias("probability"))
    return keyed.join(best, key).withColumn("factor", F.pow(F.lit(10.0), F.col("offset")))
