"""Exact quantiles of groups of any size, and two-sample quantile pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.numeric import log_if_positive
from cohortspark.operators.joins import lookup_join
from cohortspark.operators.ordered import OrderedGroups, Running, Total, ordered_groups
from cohortspark.session import materialise


def value_counts(df: DataFrame, keys: list[str], value: str, max_group_rows: int | None = None) -> OrderedGroups:
    """Distinct values ``v`` with count ``n``, running count ``c`` and group size ``t``."""
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    layout = ordered_groups(rows, keys, ["v"], {"n": F.count(F.lit(1))}, max_group_rows)
    return layout.compute(c=Running(F.col("n")), t=Total(F.col("n")))


def quantile_aggregate(q: float) -> Column:
    """Aggregate over :func:`value_counts` rows: the linearly interpolated quantile."""
    position = (F.col("t") - 1) * F.lit(float(q))

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("c") - F.col("n") <= index) & (index < F.col("c")), F.col("v")))

    share = F.max(position - F.floor(position))
    low = at(F.floor(position))
    return low + (at(F.ceil(position)) - low) * share


def with_quantiles(layout: OrderedGroups, quantiles: dict[str, float]) -> OrderedGroups:
    """Put a group's quantiles on each of its rows, in the same pass over the layout.

    Expects ``v``, ``n``, ``c`` and ``t`` as :func:`value_counts` makes them.
    """
    parts, made = {}, {}
    for name, q in quantiles.items():
        position = (F.col("t") - 1) * F.lit(float(q))
        for side, index in (("low", F.floor(position)), ("high", F.ceil(position))):
            here = (F.col("c") - F.col("n") <= index) & (index < F.col("c"))
            parts[f"{name}_{side}"] = Total(F.when(here, F.col("v")), "max")
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        made[name] = low + (high - low) * (position - F.floor(position))
    placed = layout.compute(**parts).with_columns(made)
    return placed.replace(placed.rows.drop(*parts))


def group_quantiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], max_group_rows: int | None = None
) -> DataFrame:
    """One row per group with its size and the named quantiles."""
    rows = value_counts(df, keys, value, max_group_rows).frame()
    return rows.groupBy(*keys).agg(F.max("t").alias("n"), *[quantile_aggregate(q).alias(name) for name, q in quantiles.items()])


def boxplot_summary(df: DataFrame, keys: list[str], value: str, max_group_rows: int | None = None) -> DataFrame:
    """Quartiles, whiskers, number of outliers and notch half-width per group.

    Whiskers are the most extreme values within 1.5 interquartile ranges of the box.
    """
    levels = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    placed = with_quantiles(value_counts(df, keys, value, max_group_rows), levels).frame()
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)
    return placed.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[F.max(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_outliers"),
        (1.57 * F.max(F.col("q3") - F.col("q1")) / F.sqrt(F.sum("n"))).alias("notch"),
    )


def log_histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int, cutoff: float | None = None) -> DataFrame:
    """Histogram of ln(value) over a fixed range, with the side of the cut-off marked."""
    rows = df.select(*keys, log_if_positive(F.col(value)).alias("x")).where("x IS NOT NULL")
    table = histogram(rows, keys, "x", low, high, bins)
    if cutoff is None:
        return table
    return table.withColumn("above_cutoff", F.col("bin_low") >= F.log(F.lit(float(cutoff))))


def histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal-width bins numbered from 1; the last bin is closed.

    Values below the range fall in bin 0, values above it in bin ``bins + 1``.
    """
    width = (high - low) / bins
    x = F.col(value)
    inner = F.floor((x - low) / F.lit(width)).cast("int") + 1
    bucket = F.when(x < low, 0).when(x > high, bins + 1).otherwise(F.least(inner, F.lit(bins)))
    counted = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys, bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("bin_low", F.lit(low) + (F.col("bin") - 1) * F.lit(width))


def density(df: DataFrame, keys: list[str], value: str, points: int = 200, reach: float = 3.0) -> DataFrame:
    """Gaussian kernel density per group at evenly spaced ``x``, with ``n`` and ``bandwidth``.

    The bandwidth is Scott's, sd / n^(1/5); the grid ends ``reach`` bandwidths beyond the extremes.  Every value is
    shared between the two grid points beside it and the grid is convolved with the kernel, so the work after one
    pass over the rows depends on the grid alone.  Null and NaN are left out; a group of fewer than two different values has no density.
    """
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(*keys, x.alias("_v"))
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("_v").alias("_sd"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    found = found.where("_sd > 0").withColumn("bandwidth", F.col("_sd") / F.pow(F.col("n").cast("double"), F.lit(0.2)))
    found = found.withColumn("_low", F.col("_least") - reach * F.col("bandwidth"))
    found = materialise(found.withColumn("_step", (F.col("_most") + reach * F.col("bandwidth") - F.col("_low")) / (points - 1)).drop("_least", "_most", "_sd"))
    place = (F.col("_v") - F.col("_low")) / F.col("_step")
    part = place - F.floor(place)
    at = F.least(F.floor(place), F.lit(points - 2)).cast("int")
    part = F.when(F.floor(place) > points - 2, F.lit(1.0)).otherwise(part)
    shared = F.inline(F.array(F.struct(at.alias("_i"), (1 - part).alias("_m")), F.struct((at + 1).alias("_i"), part.alias("_m"))))
    met = lookup_join(rows, found, keys, "inner", null_safe=True, kept=True) if keys else rows.join(F.broadcast(found))
    masses = met.select(*keys, shared).groupBy(*keys, "_i").agg(F.sum("_m").alias("_m")).where("_m > 0")
    held = masses.groupBy(*keys).agg(F.collect_list(F.struct("_i", "_m")).alias("_held"))  # as many as there are points
    both = lookup_join(found, held, keys, "inner", null_safe=True) if keys else found.join(F.broadcast(held))
    grid = both.select(*keys, "n", "bandwidth", "_low", "_step", "_held", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    wide = F.col("_step") / F.col("bandwidth")
    kernel = F.aggregate("_held", F.lit(0.0), lambda total, m: total + m["_m"] * F.exp(-0.5 * F.pow((F.col("point") - m["_i"]) * wide, F.lit(2))))
    height = kernel / (F.col("n") * F.col("bandwidth") * F.lit((2 * math.pi) ** 0.5))
    return grid.select(*keys, "point", (F.col("_low") + F.col("point") * F.col("_step")).alias("x"), height.alias("density"), "n", "bandwidth")


def quantile_pairs(df: DataFrame, value: str, first: Column, max_group_rows: int | None = None) -> DataFrame:
    """Quantiles of two samples at the same evenly spaced levels.

    There are as many levels as the smaller sample has values.  The levels are laid
    among the values by position: since values grow with position, the value at a
    position is the running maximum there, so neither sample is ever gathered.
    """
    rows = df.select(first.alias("s"), F.col(value).cast("double").alias("v")).where("s IS NOT NULL AND v IS NOT NULL")
    sizes = {r["s"]: r["n"] for r in rows.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_x, n_y = sizes.get(True, 0), sizes.get(False, 0)
    levels = min(n_x, n_y)
    spark = df.sparkSession
    if levels == 0:
        return spark.createDataFrame([], "level bigint, x double, y double")

    counts = value_counts(rows, ["s"], "v", max_group_rows).frame()
    starts = counts.select("s", (F.col("c") - F.col("n")).alias("pos"), "v", F.lit(None).cast("bigint").alias("level"), F.lit(None).cast("double").alias("w"))
    grids = []
    for member, n in ((True, n_x), (False, n_y)):
        at = F.col("id") * F.lit(n - 1) / F.lit(float(max(levels - 1, 1)))
        grid = spark.range(levels).select(F.lit(member).alias("s"), F.col("id").alias("level"), at.alias("at"))
        low = F.floor("at")
        part = F.col("at") - low
        for index, weight in ((low, 1 - part), (F.ceil("at"), part)):
            grids.append(grid.select("s", index.cast("bigint").alias("pos"), F.lit(None).cast("double").alias("v"), "level", weight.alias("w")))
    union = starts
    for grid in grids:
        union = union.unionByName(grid)
    # Values sort before the levels that ask for them.
    union = union.withColumn("asks", F.coalesce(F.col("level") + 1, F.lit(0)))
    # An integral position is asked for twice; the weights 1 and 0 are added up here.
    counted = {"v": F.max("v"), "w": F.sum("w")}
    layout = ordered_groups(union, ["s"], ["pos", "asks"], counted, max_group_rows).compute(here=Running(F.col("v"), "max"))
    asked = layout.frame().where("asks > 0")
    return asked.groupBy((F.col("asks") - 1).alias("level")).agg(
        F.sum(F.when(F.col("s"), F.col("here") * F.col("w"))).alias("x"),
        F.sum(F.when(~F.col("s"), F.col("here") * F.col("w"))).alias("y"),
    )
