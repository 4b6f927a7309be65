"""Descriptive tables by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.numeric import ratio
from cohortspark.functions.text import count_share, mean_sd, reported_p
from cohortspark.operators.clean import column
from cohortspark.operators.gram import correlations
from cohortspark.operators.hypothesis import two_group_tests
from cohortspark.session import materialise


def variable_moments(df: DataFrame, variables: list[str], label: str | None = None) -> DataFrame:
    """Mean and sample sd of each variable, overall and by label, in one aggregation.

    The wide one-row result is turned into one row per variable afterwards, so the
    data itself is never unpivoted.
    """
    groups = {"all": None} if label is None else {"all": None, "neg": ~F.col(label), "pos": F.col(label)}
    aggregates, cells = [], []
    for i, name in enumerate(variables):
        fields = [F.lit(name).alias("variable")]
        for g, member in groups.items():
            x = column(name).cast("double")
            x = x if member is None else F.when(member, x)
            aggregates += [F.avg(x).alias(f"m_{i}_{g}"), F.stddev_samp(x).alias(f"s_{i}_{g}")]
            fields += [F.col(f"m_{i}_{g}").alias(f"mean_{g}"), F.col(f"s_{i}_{g}").alias(f"sd_{g}")]
        cells.append(F.struct(*fields))
    return df.agg(*aggregates).select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def long_values(df: DataFrame, variables: list[str], carried: list[str]) -> DataFrame:
    """One row per variable and value; the variable is its number in the list.

    A number rather than the name is what the many rows carry through a shuffle.
    """
    values = F.array(*[column(v).cast("double") for v in variables])
    return df.select(*carried, F.posexplode(values).alias("variable_no", "value"))


def named_variables(df: DataFrame, variables: list[str]) -> DataFrame:
    """Replace the variable number by its name."""
    name = F.array(*[F.lit(v) for v in variables])[F.col("variable_no")]
    return df.withColumn("variable", name).drop("variable_no")


def descriptive_statistics(
    df: DataFrame,
    variables: list[str],
    label: str | None = None,
    alpha: float | None = 0.01,
    tests: tuple[str, ...] = ("u", "t", "ks1"),
    max_group_rows: int | None = None,
) -> DataFrame:
    """One row per variable: moments, ``mean±sd`` cells, p-values and their report.

    Numbers stay numeric; the text cells sit beside them.
    """
    table = variable_moments(df, variables, label)
    cells = {"cell_all": mean_sd(F.col("mean_all"), F.col("sd_all"))}
    if label is not None:
        cells |= {f"cell_{g}": mean_sd(F.col(f"mean_{g}"), F.col(f"sd_{g}")) for g in ("neg", "pos")}
        long = long_values(df, variables, [label])
        tested = two_group_tests(long, ["variable_no"], "value", F.col(label), tests, max_group_rows=max_group_rows)
        tested = named_variables(tested, variables)
        p_columns = [c for c in ("ks_p_neg", "ks_p_pos", "t_p", "u_p") if c in tested.columns]
        table = table.join(F.broadcast(tested.select("variable", *p_columns)), "variable", "left")
        cells |= {f"{c}_text": reported_p(F.col(c), alpha) for c in p_columns}
    return table.withColumns(cells)


def count_block(df: DataFrame, by: str, label: str) -> DataFrame:
    """Counts of ``by`` within label groups with their share of the column total.

    Grouping sets give cells, margins and the grand total in one pass.  ``level`` is
    ``total`` or the code; shares are of the label's total.
    """
    cells = (
        df.where(F.col(by).isNotNull() & F.col(label).isNotNull())
        .groupingSets([[F.col(by), F.col(label)], [F.col(by)], [F.col(label)], []], F.col(by), F.col(label))
        .agg(F.count(F.lit(1)).alias("n"), F.grouping(by).alias("_g"), F.grouping(label).alias("_l"))
    )
    level = F.when(F.col("_g") == 1, F.lit("total")).otherwise(F.col(by).cast("string"))
    side = F.when(F.col("_l") == 1, F.lit("all")).when(F.col(label), F.lit("pos")).otherwise(F.lit("neg"))
    # A few rows per code, read as cells and as totals: computed once.
    cells = materialise(cells.select(level.alias("level"), side.alias("side"), "n"))
    totals = cells.where("level = 'total'").select("side", F.col("n").alias("total"))
    shared = cells.join(F.broadcast(totals), "side").withColumn("share", ratio(F.col("n"), F.col("total")))
    sides = ["all", "neg", "pos"]
    wide = shared.groupBy("level").pivot("side", sides).agg(F.sum("n").alias("n"), F.sum("share").alias("share"))
    names = [F.coalesce(F.col(f"{s}_{part}"), F.lit(0)).alias(f"{part}_{s}") for part in ("n", "share") for s in sides]
    return wide.select("level", *names)


def count_cells(block: DataFrame) -> DataFrame:
    """Text cells of :func:`count_block`: the total as a count, levels with a share."""
    cell = lambda s: F.when(F.col("level") == "total", F.format_string("%,d", f"n_{s}")).otherwise(
        count_share(F.col(f"n_{s}"), F.col(f"share_{s}"))
    )
    return block.select("level", *[cell(s).alias(f"cell_{s}") for s in ("all", "neg", "pos")])


def descriptive_sheet(df: DataFrame, variables: list[str], by: str, label: str) -> DataFrame:
    """The sheet that is reported: counts of ``by`` on top, the total first, then the variables in order of their names."""
    counts = count_cells(count_block(df, by, label)).select(
        F.when(F.col("level") == "total", 0).otherwise(1).alias("block"), F.col("level").alias("variable"), "cell_all", "cell_neg", "cell_pos"
    )
    table = variable_moments(df, variables, label)
    cells = [mean_sd(F.col(f"mean_{s}"), F.col(f"sd_{s}")).alias(f"cell_{s}") for s in ("all", "neg", "pos")]
    sheet = counts.unionByName(table.select(F.lit(2).alias("block"), "variable", *cells))
    return sheet.withColumn("row", F.row_number().over(Window.orderBy("block", "variable"))).drop("block")  # a few rows


def correlation_long(df: DataFrame, variables: list[str], by: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair, strict lower triangle (``x`` after ``y``).

    Correlation is pairwise complete: rows count where both values are present.  One scan for any number of variables.
    """
    return correlations(df, sorted(variables), by)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Counts, prevalence and the three customary forms of the imbalance weight."""
    positive = F.col(label).cast("boolean")
    counted = df.agg(F.count_if(~positive).alias("n_neg"), F.count_if(positive).alias("n_pos"))
    neg, pos = F.col("n_neg"), F.col("n_pos")
    return counted.select(
        "n_neg",
        "n_pos",
        ratio(pos, neg + pos).alias("prevalence"),
        ratio(neg, pos).alias("positive_weight"),
        ratio(neg + pos, 2 * neg).alias("balanced_neg"),
        ratio(neg + pos, 2 * pos).alias("balanced_pos"),
    )
