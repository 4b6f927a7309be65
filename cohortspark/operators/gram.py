"""Sums of products of many columns in one scan.

A task adds up its rows in blocks of matrix products: for every pair of columns the rows that have both,
and over them the sums of each, of its square and of the product.  Everything is taken from a shift
near the columns' means, which changes no result and keeps the differences exact.  What is
shuffled is a line of the matrix per group, column and task, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.clean import column

ROWS_AT_ONCE = 4_096
MOST_GROUPS = 64  # a task holds the sums of so many groups before it hands them on
SAMPLE = 1_000


def shifts(df: DataFrame, columns: list[str]) -> list[float]:
    """Means over a few rows; a column without values among them is not shifted."""
    few = df.select(*[column(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).limit(SAMPLE)
    means = few.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))) for c in few.columns]).first()
    return [m if m is not None and np.isfinite(m) else 0.0 for m in means]


def pair_sums(df: DataFrame, columns: list[str], by: list[str] | None = None, shift: list[float] | None = None) -> DataFrame:
    """A row per group and column ``i``: arrays over all columns ``n``, ``own``, ``square`` and ``product``.

    Place j holds, over the rows in which both columns have a value, their number and the sums of i, of its
    square and of i times j.  Null and NaN are no values.  ``shift`` is taken off every column.
    """
    by, k = by or [], len(columns)
    off = np.array(shift if shift is not None else shifts(df, columns))
    arrays = [pa.list_(pa.float64())] * 4

    def summed(x: np.ndarray) -> np.ndarray:
        there = ~np.isnan(x)
        x = np.where(there, x - off, 0.0)
        there = there.astype(np.float64)
        return np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])

    def handed(sums: dict[tuple, np.ndarray], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
        keys = [key for key in sums for _ in range(k)]
        made = [pa.array([key[b] for key in keys], kind) for b, kind in enumerate(kinds)]
        lines = np.concatenate([s.transpose(1, 0, 2) for s in sums.values()]) if sums else np.zeros((0, 4, k))
        offsets = pa.array((np.arange(len(lines) + 1) * k).astype(np.int32))
        parts = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(lines[:, a]).ravel())) for a in range(4)]
        return pa.RecordBatch.from_arrays([*made, pa.array(np.tile(np.arange(k, dtype=np.int32), len(sums))), *parts], [*names, "i", "n", "own", "square", "product"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        names, kinds = [], []
        for batch in batches:
            names, kinds = batch.schema.names[: len(by)], [f.type for f in batch.schema][: len(by)]
            for at in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in part.columns[len(by) :]], axis=1)
                keys = list(zip(*[c.to_pylist() for c in part.columns[: len(by)]])) if by else [()] * len(x)
                index: dict[tuple, list[int]] = {}
                for row, key in enumerate(keys):
                    index.setdefault(key, []).append(row)
                for key, rows in index.items():
                    sums[key] = sums.get(key, 0.0) + summed(x[rows])
                if len(sums) > MOST_GROUPS:
                    yield handed(sums, names, kinds)
                    sums = {}
        if sums:
            yield handed(sums, names, kinds)

    groups = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for b in by for f in [df.schema[b]])
    lists = "i int, n array<double>, own array<double>, square array<double>, product array<double>"
    schema = f"{groups}, {lists}" if by else lists
    values = df.select(*by, *[column(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])

    def total(table: pa.Table) -> pa.Table:
        made = []
        for a, name in enumerate(["n", "own", "square", "product"]):
            flat = table[name].combine_chunks().flatten().to_numpy().reshape(len(table), k).sum(axis=0)
            made.append(pa.array([flat], arrays[a]))
        return pa.table([*[table[c].slice(0, 1) for c in table.column_names[: len(by) + 1]], *made], table.column_names)

    return values.mapInArrow(run, schema).groupBy(*by, "i").applyInArrow(total, schema)


def correlations(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair over the rows that have both, ``x`` after ``y`` in ``columns``.

    Null for fewer than two such rows and for a column that does not vary in them.
    """
    by = by or []
    lines = pair_sums(df, columns, by)
    each = F.arrays_zip(F.array(*[F.lit(c) for c in columns]).alias("y"), "n", "own", "square", "product")
    long = lines.select(*by, "i", F.posexplode(each).alias("j", "s")).select(*by, "i", "j", "s.*")
    # The line of the other column has its sums over the same rows.
    a = long.where("i > j").select(*by, "i", "j", "n", "own", "square", "product")
    b = long.where("i < j").select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("j").alias("_i"), F.col("i").alias("_j"), F.col("own").alias("_own"), F.col("square").alias("_square"))
    same = (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j"))
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    joined = a.join(b, same)
    varies = lambda own, square: F.col("n") * F.col(square) - F.col(own) * F.col(own)
    spread = varies("own", "square") * varies("_own", "_square")
    flat = (varies("own", "square") <= 1e-13 * F.col("n") * F.col("square")) | (varies("_own", "_square") <= 1e-13 * F.col("n") * F.col("_square"))
    r = (F.col("n") * F.col("product") - F.col("own") * F.col("_own")) / F.sqrt(spread)
    names = F.array(*[F.lit(c) for c in columns])
    held = F.when((F.col("n") > 1) & ~flat, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    return joined.select(*by, names[F.col("i")].alias("x"), names[F.col("j")].alias("y"), held.alias("r"))


def least_squares(sums: dict[int, np.ndarray], columns: list[int], target: int, shift: list[float]) -> tuple[float, np.ndarray]:
    """Intercept and coefficients from pair sums (4, k, k) added over some groups, rows complete in all columns."""
    n, own, _, product = sum(sums.values())
    size = n[target, target]
    mean = own[:, target] / size
    cov = product / size - np.outer(mean, mean)
    scale = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1.0))
    inner = (cov / np.outer(scale, scale))[np.ix_(columns, columns)]
    beta, *_ = np.linalg.lstsq(inner, (cov[columns, target] / scale[columns] / scale[target]), rcond=None)
    beta = beta * scale[target] / scale[columns]
    real = mean + np.array(shift)
    return float(real[target] - beta @ real[columns]), beta
