"""The probe-by-sample matrix in long form: eligibility, statistics, volcano."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.numeric import INFINITY, ratio
from cohortspark.functions.text import first_item
from cohortspark.operators.clean import column, select_matching
from cohortspark.operators.hypothesis import two_group_tests
from cohortspark.operators.joins import complete_keys, keep_keys, lookup_join
from cohortspark.operators.multiple import adjust_pvalues
from cohortspark.session import materialise

# Filters and thresholds of the probe analysis.
EXCLUDED_CHROMOSOMES = ["X", "Y"]
PROBE_PREFIX = "cg"
DETECTION_P = 0.001
Q_THRESHOLD = 0.05
LOG2FC_THRESHOLD = 0.2


def eligible_probes(manifest: DataFrame, probe: str = "Probe_ID", chrom: str = "CHR", prefix: str = PROBE_PREFIX) -> DataFrame:
    """Probes on an autosome with the wanted prefix; an unknown chromosome drops."""
    kept = ~F.col(chrom).isin(EXCLUDED_CHROMOSOMES) & F.col(probe).startswith(prefix)
    return manifest.where(kept).select(F.col(probe).alias("TargetID"))


def usable_readings(readings: DataFrame, value: str = "AVG_Beta", detection: str = "det_p", limit: float = DETECTION_P) -> DataFrame:
    """Numeric readings with a detection p-value strictly below the limit."""
    cast = readings.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in (value, detection)})
    return cast.where(column(detection) < limit)


def complete_readings(readings: DataFrame, probes: DataFrame | None, n_samples: int, unique: bool = False) -> DataFrame:
    """Readings of eligible probes that every one of ``n_samples`` samples has.

    ``unique`` states that a sample has at most one reading of a probe.
    """
    if n_samples <= 0:
        raise FileNotFoundError("no samples given")
    if probes is not None:
        readings = keep_keys(readings, probes, "TargetID")
    complete = complete_keys(readings, "TargetID", "MET_ID", "AVG_Beta", n_samples, unique)
    return keep_keys(readings, complete, "TargetID").where(F.col("AVG_Beta").isNotNull())


def wide_matrix(readings: DataFrame, samples: list[str]) -> DataFrame:
    """Probe rows by sample columns, for export only."""
    return readings.groupBy("TargetID").pivot("MET_ID", samples).agg(F.first("AVG_Beta"))


def probe_statistics(
    readings: DataFrame,
    positive: Column,
    key: str = "TargetID",
    value: str = "AVG_Beta",
    tests: tuple[str, ...] = ("u", "t", "ks1"),
    max_group_rows: int | None = None,
    n_samples: int | None = None,
) -> DataFrame:
    """Per probe and group: sum, sd, n, median; and the raw p-values.

    ``n_samples`` keeps the probes that every sample has, when a sample has at most one reading of a
    probe and belongs to a group; it spares a pass before the tests.
    """
    return two_group_tests(readings, [key], value, positive, tests, max_group_rows=max_group_rows, complete=n_samples)


def volcano(
    stats: DataFrame, q: str = "adj_u_p", q_threshold: float = Q_THRESHOLD, log2fc_threshold: float = LOG2FC_THRESHOLD
) -> DataFrame:
    """Group means, -log10 q, log2 ratio of medians and the significance flag.

    A q of zero is infinitely significant, and a zero median gives an infinite ratio
    (none if both are zero), rather than the null or error of plain SQL.
    """
    neg, pos = F.col("med_neg"), F.col("med_pos")
    fold = (
        F.when((pos > 0) & (neg > 0), F.log2(pos / F.when(neg != 0, neg)))
        .when((pos > 0) & (neg == 0), F.lit(INFINITY))
        .when((pos == 0) & (neg > 0), F.lit(-INFINITY))
    )
    strength = F.when(F.col(q) == 0, F.lit(INFINITY)).otherwise(-F.log10(q))
    flagged = stats.withColumns(
        {
            "mean_neg": ratio(F.col("sum_neg"), F.col("n_neg")),
            "mean_pos": ratio(F.col("sum_pos"), F.col("n_pos")),
            "neg_log10_p": strength,
            "log2_fc": fold,
        }
    )
    passed = (F.col("neg_log10_p") > -F.log10(F.lit(q_threshold))) & (F.abs("log2_fc") > log2fc_threshold)
    return flagged.withColumn("significant", F.coalesce(passed, F.lit(False)))


def differential_table(
    readings: DataFrame, positive: Column, log2fc_threshold: float = LOG2FC_THRESHOLD, q_threshold: float = Q_THRESHOLD, **options
) -> DataFrame:
    """Statistics, corrected p-values and volcano columns in one go."""
    stats = probe_statistics(readings, positive, **options)
    p_columns = [c for c in ("ks_p_neg", "ks_p_pos", "u_p", "t_p") if c in stats.columns]
    # One row per probe, read by each corrected column: computed once.
    corrected = adjust_pvalues(materialise(stats), p_columns)
    return volcano(corrected, "adj_u_p", q_threshold, log2fc_threshold)


def significant_points(table: DataFrame, manifest: DataFrame, probe: str = "Probe_ID", regions: DataFrame | None = None) -> DataFrame:
    """Significant probes with their annotation, first list entries and region label."""
    hits = table.where("significant").select("TargetID", "neg_log10_p", "log2_fc")
    # The manifest is the large side: hits are few and measured before broadcast.
    joined = lookup_join(manifest, hits, [(probe, "TargetID")], "inner").withColumnRenamed(probe, "TargetID")
    joined = joined.withColumns(
        {
            "UCSC_REFGENE_NAME": first_item(F.col("UCSC_REFGENE_NAME")),
            "UCSC_REFGENE_GROUP": first_item(F.col("UCSC_REFGENE_GROUP")),
            "RELATION_TO_UCSC_CPG_ISLAND": F.coalesce("RELATION_TO_UCSC_CPG_ISLAND", F.lit("")),
            "neg_log10_p": F.round("neg_log10_p", 3),
            "log2_fc": F.round("log2_fc", 3),
        }
    )
    return joined if regions is None else joined.join(regions, "TargetID", "left")


def ranked_points(points: DataFrame, n: int | None = None) -> DataFrame:
    """Strongest first, ties by probe; with ``n`` the top of the list."""
    ordered = points.orderBy(F.desc("neg_log10_p"), "TargetID")
    return ordered if n is None else ordered.limit(n)


def candidate_table(points: DataFrame, manifest: DataFrame, probe: str = "Probe_ID", pattern: str = r"^.*UCSC.*$") -> DataFrame:
    """The reported probes with every manifest column that matches ``pattern``."""
    kept = select_matching(manifest, include=rf"{probe}|CHR|MAPINFO|{pattern}")
    return lookup_join(kept, points.select("TargetID"), [(probe, "TargetID")], "left_semi")


def score_ties(points: DataFrame, score: str = "neg_log10_p") -> DataFrame:
    """Rows whose score is shared with another row, where a sort order is arbitrary."""
    return points.agg((F.count(F.lit(1)) - F.count_distinct(score)).alias("ties"))
