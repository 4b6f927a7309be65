"""Where probes lie within gene structures, and the genes they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.joins import lookup_join

COMPLETE = "cmpl"


def classify_region(
    annotation: DataFrame, key: str = "TargetID", position: str = "Position", zero_based_start: bool = False,
    outside_label: str | None = None,
) -> DataFrame:
    """One label per probe from its overlapping transcripts, in a single aggregation.

    ``coding``: some transcript with both boundaries complete contains the position;
    else ``non_coding``: some transcript with both boundaries known, neither complete;
    else ``no_annotate``: some row without boundaries; else ``outside_label``.
    """
    first, last = F.col("cdsStartStat"), F.col("cdsEndStat")
    start = F.col("cdsStart") + (1 if zero_based_start else 0)
    coding = (first == COMPLETE) & (last == COMPLETE) & F.col(position).between(start, F.col("cdsEnd"))
    non_coding = (first != COMPLETE) & (last != COMPLETE)
    unannotated = first.isNull() & last.isNull()

    def some(rule):
        return F.bool_or(F.coalesce(rule, F.lit(False)))

    label = F.when(some(coding), "coding").when(some(non_coding), "non_coding").when(some(unannotated), "no_annotate")
    return annotation.groupBy(key).agg(label.otherwise(F.lit(outside_label)).alias("coding"))


def region_tally(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.coalesce("coding", F.lit("unlabelled")).alias("coding")).agg(F.count(F.lit(1)).alias("n"))


def gene_list(df: DataFrame, genes: str, separator: str = ";", aliases: DataFrame | None = None) -> DataFrame:
    """Distinct non-empty symbols of a separated list, aliases resolved."""
    symbols = df.select(F.explode(F.split(F.col(genes), separator)).alias("gene")).where("gene <> ''").distinct()
    if aliases is None:
        return symbols
    resolved = lookup_join(symbols, aliases.select("alias", "official"), [("gene", "alias")], "left")
    return resolved.select(F.coalesce("official", "gene").alias("gene")).distinct()
