"""Two-group tests per key: rank-sum, Welch, Kolmogorov-Smirnov, effect size.

All rank-based tests read one table with a row per (key, distinct value) that
carries how many negatives and positives have that value.  Because counts are
cumulated instead of rows being ranked, ties need no special handling and a value
shared by a third of the data is a single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import numeric, pvalues
from cohortspark.functions.numeric import ratio
from cohortspark.functions.tails import EXACT_RANK_SUM
from cohortspark.operators.joins import HEAVY_ROWS, fits_broadcast, lookup_join
from cohortspark.operators.ordered import OrderedGroups, Running, Total, ordered_groups
from cohortspark.session import materialise

GROUPS = ("neg", "pos")


def labelled_values(df: DataFrame, keys: list[str], value: str, positive: Column) -> DataFrame:
    """``v`` and ``_pos``; rows with a null or NaN value or an undecided group are left out."""
    rows = df.select(*keys, F.col(value).cast("double").alias("v"), positive.cast("boolean").alias("_pos"))
    return rows.where(F.col("v").isNotNull() & ~F.isnan("v") & F.col("_pos").isNotNull())


def group_moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Size, mean and squared deviations of both groups: one row per key, kept.

    Partial aggregation makes this cheap, and it doubles as the measurement that
    decides how the rows are laid out.
    """
    aggregates = []
    for g, member in (("neg", ~F.col("_pos")), ("pos", F.col("_pos"))):
        inside = F.when(member, F.col("v"))
        aggregates += [
            F.count(inside).alias(f"t_{g}"),
            F.sum(inside).alias(f"s_{g}"),
            F.avg(inside).alias(f"mean_{g}"),
            (F.var_pop(inside) * F.count(inside)).alias(f"m2_{g}"),
        ]
    return materialise(rows.groupBy(*keys).agg(*aggregates))


def counted_layout(
    rows: DataFrame, keys: list[str], moments: DataFrame | None = None, max_group_rows: int | None = None
) -> OrderedGroups:
    """Counts ``n_*`` of both groups at each distinct value and running counts ``c_*``."""
    sizes = None
    if moments is not None:
        per_key = F.col("t_neg") + F.col("t_pos")
        sizes = tuple(moments.agg(F.max(per_key), F.sum(per_key)).first())
    counts = {"n_neg": F.count_if(~F.col("_pos")), "n_pos": F.count_if(F.col("_pos"))}
    layout = ordered_groups(rows, keys, ["v"], counts, max_group_rows, sizes)
    return layout.compute(**{f"c_{g}": Running(F.col(f"n_{g}")) for g in GROUPS})


def attach_moments(
    counts: DataFrame, moments: DataFrame, keys: list[str], columns: list[str], fits: bool | None = None, largest: int | None = None
) -> DataFrame:
    """Put a key's moments on each of its rows; ``fits`` when they were measured.

    ``largest`` is the size of the largest key where it is known, which spares the count of keys.
    """
    if not keys:
        row = moments.first()
        return counts.withColumns({c: F.lit(row[c]) for c in columns})
    heavy = None if largest is not None and largest < HEAVY_ROWS else HEAVY_ROWS
    return lookup_join(counts, moments.select(*keys, *columns), keys, "inner", null_safe=True, kept=True, fits=fits, heavy_rows=heavy)


def group_counts(
    df: DataFrame, keys: list[str], value: str, positive: Column, max_group_rows: int | None = None
) -> DataFrame:
    """Counts of negatives and positives at each distinct value ``v``, cumulated.

    Columns: ``n_*`` at the value, ``c_*`` up to and including it, ``t_*`` in the
    whole key.
    """
    rows = labelled_values(df, keys, value, positive)
    layout = counted_layout(rows, keys, None, max_group_rows)
    return layout.compute(**{f"t_{g}": Total(F.col(f"n_{g}")) for g in GROUPS}).frame()


def rank_sum_aggregates() -> dict[str, Column]:
    """U of the negatives and the tie term, as aggregates over one key."""
    here = F.col("n_neg") + F.col("n_pos")
    before = (F.col("c_neg") + F.col("c_pos") - here).cast("double")
    return {
        "_rank_sum": F.sum(F.col("n_neg") * (before + (here + 1) / 2)),
        "_ties": F.sum(here.cast("double") ** 3 - here),
    }


def with_rank_sum(table: DataFrame, exact: bool) -> DataFrame:
    """U statistic and two-sided p-value from the aggregates.

    The p-value is the normal approximation with tie and continuity corrections;
    with ``exact`` it is counted where a group is small and no value is shared.
    """
    n1, n2 = F.col("n_neg").cast("double"), F.col("n_pos").cast("double")
    n = n1 + n2
    table = table.withColumn("u_stat", F.when((n1 > 0) & (n2 > 0), F.col("_rank_sum") - n1 * (n1 + 1) / 2))
    u = F.col("u_stat")
    variance = n1 * n2 / 12 * (n + 1 - F.coalesce(ratio(F.col("_ties"), n * (n - 1)), F.lit(0.0)))
    table = table.withColumn("_sd", F.sqrt(F.greatest(variance, F.lit(0.0))))
    # All values equal (sd 0): no evidence either way.
    z = F.coalesce(ratio(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, F.col("_sd")), F.lit(0.0))
    table = table.withColumn("_z", z)
    table = numeric.with_normal_two_sided(table, "_z", "u_p").withColumn("u_p", F.when(u.isNotNull(), F.col("u_p")))
    if exact:
        small = (F.col("_ties") == 0) & (F.least("n_neg", "n_pos") <= EXACT_RANK_SUM)
        counted = pvalues.rank_sum_exact(F.when(small, u), F.col("n_neg"), F.col("n_pos"))
        table = table.withColumn("u_p", F.coalesce(counted, F.col("u_p")))
    return table.drop("_rank_sum", "_ties", "_sd", "_z")


def welch_columns() -> dict[str, Column]:
    """Welch statistic and Satterthwaite degrees of freedom from group moments."""
    a = ratio(F.col("sd_neg") ** 2, F.col("n_neg"))
    b = ratio(F.col("sd_pos") ** 2, F.col("n_pos"))
    spread = F.sqrt(a + b)
    return {
        "t_stat": ratio(F.col("mean_neg") - F.col("mean_pos"), spread),
        "t_df": ratio((a + b) ** 2, a**2 / (F.col("n_neg") - 1) + b**2 / (F.col("n_pos") - 1)),
    }


def two_group_tests(
    df: DataFrame,
    keys: list[str],
    value: str,
    positive: Column,
    tests: tuple[str, ...] = ("u", "t", "ks1", "ks2"),
    exact_rank_sum: bool = True,
    max_group_rows: int | None = None,
    complete: int | None = None,
) -> DataFrame:
    """Summaries and tests of ``value`` between two groups, one row per key.

    With ``complete`` only keys with exactly that many usable values are tested; this is known from
    the moments, so the data is read once for them and once for the layout.

    Columns per group: n, sum, mean, sd (n-1), med.  Tests: ``u`` Mann-Whitney,
    ``t`` Welch, ``ks1`` each group against a normal with that group's own mean and
    population sd, ``ks2`` between the groups.  One layout of the data serves all.
    """
    rows = labelled_values(df, keys, value, positive)
    moments = group_moments(rows, keys)
    if complete is not None:
        moments = moments.where(F.col("t_neg") + F.col("t_pos") == complete)
    largest = moments.agg(F.max(F.col("t_neg") + F.col("t_pos"))).first()[0] or 0
    fits = fits_broadcast(moments) if keys else True
    if complete is not None and keys:
        rows = lookup_join(rows, moments.select(*keys), keys, "left_semi", null_safe=True, kept=True, fits=fits, heavy_rows=None if largest < HEAVY_ROWS else HEAVY_ROWS)
    ordered = counted_layout(rows, keys, moments, max_group_rows).frame()

    placed = ["t_neg", "t_pos"] + (["mean_neg", "m2_neg", "mean_pos", "m2_pos"] if "ks1" in tests else [])
    counts = attach_moments(ordered, moments, keys, placed, fits, largest)
    derived, aggregates = {}, {}
    for g in GROUPS:
        derived[f"mid_{g}"] = _middle(g)
        aggregates[f"med_{g}"] = (F.min(f"mid_{g}") + F.max(f"mid_{g}")) / 2
    if "u" in tests:
        aggregates |= rank_sum_aggregates()
    if "ks2" in tests:
        derived["gap"] = _between_groups()
        aggregates["ks_d"] = F.max("gap")
    counts = counts.withColumns(derived)
    if "ks1" in tests:
        counts = _with_fitted_normal(counts)
        aggregates |= {f"ks_d_{g}": F.max(f"gap_{g}") for g in GROUPS}
    ranked = counts.groupBy(*keys).agg(*[c.alias(name) for name, c in aggregates.items()])

    table = attach_moments(ranked, moments, keys, [c for c in moments.columns if c not in keys], fits, largest)
    renames = {}
    for g in GROUPS:
        table = table.withColumn(f"sd_{g}", F.sqrt(ratio(F.col(f"m2_{g}"), F.col(f"t_{g}") - 1))).drop(f"m2_{g}")
        renames |= {f"t_{g}": f"n_{g}", f"s_{g}": f"sum_{g}"}
    table = table.withColumnsRenamed(renames)
    if "u" in tests:
        table = with_rank_sum(table, exact_rank_sum)
    if "t" in tests:
        table = table.withColumns(welch_columns())
        table = table.withColumn("t_p", pvalues.student_two_sided("t_stat", "t_df"))
    if "ks2" in tests:
        table = table.withColumn("ks_p", pvalues.ks_two_sample("ks_d", "n_neg", "n_pos"))
    if "ks1" in tests:
        table = table.withColumns({f"ks_p_{g}": pvalues.ks_one_sample(f"ks_d_{g}", f"n_{g}") for g in GROUPS})
    return table


def _middle(group: str) -> Column:
    """The value where a row holds one of the group's middle positions."""
    total, after, n = F.col(f"t_{group}"), F.col(f"c_{group}"), F.col(f"n_{group}")
    return F.when((n > 0) & (2 * after >= total) & (2 * (after - n) <= total), F.col("v"))


def _between_groups() -> Column:
    """Distance of the two distribution functions at a value."""
    return F.abs(ratio(F.col("c_neg"), F.col("t_neg")) - ratio(F.col("c_pos"), F.col("t_pos")))


def _with_fitted_normal(counts: DataFrame) -> DataFrame:
    """Distance of each group's distribution function from its fitted normal, per value.

    Built in steps so that each long expression reads plain columns, and null where
    the group has no such value, which skips the work.
    """
    z, gap = {}, {}
    for g in GROUPS:
        n, total, after, fitted = (F.col(f"{part}_{g}") for part in ("n", "t", "c", "cdf"))
        sd = F.sqrt(ratio(F.col(f"m2_{g}"), total))
        z[f"z_{g}"] = F.when(n > 0, ratio(F.col("v") - F.col(f"mean_{g}"), sd))
        gap[f"gap_{g}"] = F.greatest(after / total - fitted, fitted - (after - n) / total)
    gap = {name: F.when(F.col(f"cdf_{name[4:]}").isNotNull(), c) for name, c in gap.items()}
    fitted = {f"cdf_{g}": numeric.normal_cdf(f"z_{g}") for g in GROUPS}
    return counts.withColumns(z).withColumns(fitted).withColumns(gap)


def _sizes_from_counts() -> dict[str, Column]:
    return {f"n_{g}": F.sum(f"n_{g}") for g in GROUPS}


def mann_whitney(df: DataFrame, keys: list[str], value: str, positive: Column, **options) -> DataFrame:
    """Rank-sum test only: n per group, U of the negatives, two-sided p."""
    exact = options.pop("exact_rank_sum", True)
    rows = labelled_values(df, keys, value, positive)
    counts = counted_layout(rows, keys, None, options.pop("max_group_rows", None)).frame()
    aggregates = _sizes_from_counts() | rank_sum_aggregates()
    return with_rank_sum(counts.groupBy(*keys).agg(*[c.alias(k) for k, c in aggregates.items()]), exact)


def welch(df: DataFrame, keys: list[str], value: str, positive: Column) -> DataFrame:
    """Welch's t-test only; moments need no ordering, so one partial aggregation."""
    x = F.col(value).cast("double")
    x = F.when(~F.isnan(x), x)
    aggregates = []
    for g, member in (("neg", ~positive), ("pos", positive)):
        inside = F.when(member, x)
        aggregates += [
            F.count(inside).alias(f"n_{g}"),
            F.avg(inside).alias(f"mean_{g}"),
            F.stddev_samp(inside).alias(f"sd_{g}"),
        ]
    table = df.groupBy(*keys).agg(*aggregates).withColumns(welch_columns())
    return table.withColumn("t_p", pvalues.student_two_sided("t_stat", "t_df"))


def ks_two_sample(df: DataFrame, keys: list[str], value: str, positive: Column, max_group_rows: int | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance and p-value."""
    counts = group_counts(df, keys, value, positive, max_group_rows)
    table = counts.groupBy(*keys).agg(*[F.max(f"t_{g}").alias(f"n_{g}") for g in GROUPS], F.max(_between_groups()).alias("ks_d"))
    return table.withColumn("ks_p", pvalues.ks_two_sample("ks_d", "n_neg", "n_pos"))


def cohens_d(df: DataFrame, keys: list[str], value: str, first: Column) -> DataFrame:
    """Standardised mean difference with the pooled sample variance.

    Positive when the rows where ``first`` holds have the larger mean.
    """
    x = F.col(value).cast("double")
    aggregates = []
    for g, member in (("x", first), ("y", ~first)):
        inside = F.when(member, x)
        aggregates += [F.count(inside).alias(f"n_{g}"), F.avg(inside).alias(f"mean_{g}"), F.var_samp(inside).alias(f"_var_{g}")]
    pooled = ratio(
        (F.col("n_x") - 1) * F.col("_var_x") + (F.col("n_y") - 1) * F.col("_var_y"), F.col("n_x") + F.col("n_y") - 2
    )
    table = df.groupBy(*keys).agg(*aggregates)
    return table.withColumn("cohens_d", ratio(F.col("mean_x") - F.col("mean_y"), F.sqrt(pooled))).drop("_var_x", "_var_y")
