"""Multiple-testing correction without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.joins import fits_broadcast, lookup_join
from cohortspark.operators.ordered import Running, Total, ordered_groups
from cohortspark.session import materialise

METHODS = ("fdr_bh", "fdr_by", "bonferroni", "holm")

EULER_GAMMA = 0.5772156649015329


def adjust_pvalues(
    table: DataFrame,
    columns: list[str],
    by: list[str] | None = None,
    method: str = "fdr_bh",
    prefix: str = "adj_",
    max_group_rows: int | None = None,
) -> DataFrame:
    """Append ``prefix + column`` with the corrected p-value of each column.

    The family of tests is all rows, or all rows with the same ``by`` values.  Null
    and NaN p-values stay null and do not count as tests.  All columns are handled
    together: the p-values are stacked, collapsed to distinct values, cumulated, and
    the corrected value of each distinct p is looked up again.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {METHODS}")
    by = by or []
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    stacked = table.select(*by, F.posexplode(values).alias("test", "p")).where(F.col("p").isNotNull() & ~F.isnan("p"))

    layout = ordered_groups(stacked, by + ["test"], ["p"], {"n": F.count(F.lit(1))}, max_group_rows)
    layout = layout.compute(rank=Running(F.col("n")), m=Total(F.col("n")))
    m, rank, p = F.col("m").cast("double"), F.col("rank"), F.col("p")
    if method == "bonferroni":
        layout = layout.with_columns({"q": p * m})
    elif method == "holm":
        # The smallest of tied p-values has the largest multiplier.
        scaled = p * (m - (rank - F.col("n")))
        layout = layout.compute(q=Running(scaled, "max"))
    else:
        scaled = p * m / rank
        if method == "fdr_by":
            scaled = scaled * _harmonic(m)
        layout = layout.compute(q=Running(scaled, "min", backward=True))
    # Read once per corrected column.
    corrected = materialise(layout.frame().select(*by, "test", "p", F.least(F.lit(1.0), F.col("q")).alias("q")))

    fits = fits_broadcast(corrected)
    for number, column in enumerate(columns):
        name = f"{prefix}{column}"
        one = corrected.where(F.col("test") == number).select(
            *[F.col(b).alias(f"_b_{b}") for b in by], F.col("p").alias("_p"), F.col("q").alias(name)
        )
        on = [(b, f"_b_{b}") for b in by] + [(column, "_p")]
        # A join by shuffle also counts the keys of what it is given: not of a chain that is computed again.
        table = table if fits or not number else materialise(table)
        table = lookup_join(table, one, on, "left", null_safe=True, kept=True, fits=fits)
    return table


def _harmonic(m):
    """Sum of 1/i for i up to m."""
    exact = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(200.0)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / i)
    series = F.log(m) + EULER_GAMMA + 1 / (2 * m) - 1 / (12 * m * m)
    return F.when(m <= 200, exact).otherwise(series)
