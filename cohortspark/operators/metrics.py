"""Classification metrics, curves, bootstrap intervals and calibration."""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.numeric import ratio
from cohortspark.operators.hypothesis import group_counts
from cohortspark.operators.ordered import Running, Total, ordered_groups
from cohortspark.operators.quantiles import with_quantiles
from cohortspark.session import materialise

METRICS = ("roc_auc", "accuracy", "sensitivity", "specificity", "ppv", "npv", "f1", "youden", "pr_auc")


def _score_counts(df: DataFrame, keys: list[str], label: str, score: str, weight: str | None, max_group_rows: int | None):
    """Positives and negatives per distinct score, cumulated from the lowest score."""
    if weight is None:
        return group_counts(df, keys, score, F.col(label).cast("boolean"), max_group_rows)
    rows = df.select(*keys, F.col(score).alias("v"), F.col(label).cast("boolean").alias("_pos"), F.col(weight).alias("_w"))
    layout = ordered_groups(
        rows,
        keys,
        ["v"],
        {"n_neg": F.sum(F.when(F.col("_pos"), 0).otherwise(F.col("_w"))), "n_pos": F.sum(F.when(F.col("_pos"), F.col("_w")).otherwise(0))},
        max_group_rows,
    )
    wanted = {}
    for g in ("neg", "pos"):
        wanted |= {f"c_{g}": Running(F.col(f"n_{g}")), f"t_{g}": Total(F.col(f"n_{g}"))}
    return layout.compute(**wanted).frame()


def _curve_columns(counts: DataFrame) -> DataFrame:
    """Counts at or above each score (``tp``, ``fp``) and strictly above it."""
    return counts.withColumns(
        {
            "tp": F.col("t_pos") - F.col("c_pos") + F.col("n_pos"),
            "fp": F.col("t_neg") - F.col("c_neg") + F.col("n_neg"),
            "tp_above": F.col("t_pos") - F.col("c_pos"),
            "fp_above": F.col("t_neg") - F.col("c_neg"),
        }
    )


def _precision(tp: Column, fp: Column) -> Column:
    """Precision; 1 where nothing is predicted positive, the start of the curve."""
    return F.coalesce(ratio(tp, tp + fp), F.lit(1.0))


def roc_curve(df: DataFrame, label: str, score: str, keys: list[str] | None = None, max_group_rows: int | None = None) -> DataFrame:
    """One ROC and precision-recall point per distinct score."""
    keys = keys or []
    points = _curve_columns(_score_counts(df, keys, label, score, None, max_group_rows))
    return points.select(
        *keys,
        F.col("v").alias("threshold"),
        "tp",
        "fp",
        ratio(F.col("fp"), F.col("t_neg")).alias("fpr"),
        ratio(F.col("tp"), F.col("t_pos")).alias("tpr"),
        _precision(F.col("tp"), F.col("fp")).alias("precision"),
    )


def classification_metrics(
    df: DataFrame,
    label: str,
    score: str,
    keys: list[str] | None = None,
    threshold: float = 0.5,
    digits: int | None = 3,
    weight: str | None = None,
    max_group_rows: int | None = None,
) -> DataFrame:
    """Confusion counts and nine metrics, one row per ``keys``.

    A row is predicted positive when its score is strictly above ``threshold``.  The
    precision-recall area is the trapezoid over distinct scores, starting at recall 0
    and precision 1.  Metrics with an empty denominator are null.
    """
    keys = keys or []
    points = _curve_columns(_score_counts(df, keys, label, score, weight, max_group_rows))
    tp, fp, tp_above, fp_above = (F.col(c) for c in ("tp", "fp", "tp_above", "fp_above"))
    n_pos, n_neg, t_pos, t_neg = (F.col(c) for c in ("n_pos", "n_neg", "t_pos", "t_neg"))
    # Each positive beats the negatives below it and half of those it ties with.
    beaten = n_pos * (F.col("c_neg") - n_neg / 2)
    strip = n_pos * (_precision(tp, fp) + _precision(tp_above, fp_above)) / 2
    predicted = F.col("v") > threshold
    table = points.groupBy(*keys).agg(
        *[
            F.sum(F.when(rule, n).otherwise(0)).alias(name)
            for name, rule, n in (("TP", predicted, n_pos), ("TN", ~predicted, n_neg), ("FP", predicted, n_neg), ("FN", ~predicted, n_pos))
        ],
        ratio(F.sum(beaten), F.max(t_pos).cast("double") * F.max(t_neg)).alias("roc_auc"),
        F.when(F.max(t_pos) > 0, F.sum(F.when(n_pos > 0, strip)) / F.max(t_pos)).alias("pr_auc"),
    )
    return _with_metrics(table, keys, digits)


def _with_metrics(table: DataFrame, keys: list[str], digits: int | None) -> DataFrame:
    """Add what follows from the confusion counts."""
    TP, TN, FP, FN = (F.col(c) for c in ("TP", "TN", "FP", "FN"))
    table = table.withColumns(
        {
            "accuracy": ratio(TP + TN, TP + TN + FP + FN),
            "sensitivity": ratio(TP, TP + FN),
            "specificity": ratio(TN, TN + FP),
            "ppv": ratio(TP, TP + FP),
            "npv": ratio(TN, TN + FN),
            "f1": ratio(2 * TP, 2 * TP + FP + FN),
            "youden": ratio(TP, TP + FN) + ratio(TN, TN + FP) - 1,
        }
    )
    metrics = [F.col(m) if digits is None else F.round(m, digits).alias(m) for m in METRICS]
    return table.select(*keys, "TP", "TN", "FP", "FN", *metrics)


SLICE_ROWS = 200_000
BAND_SLICES = 1_000  # slices that one task draws for
REPLICATES_AT_ONCE = 50


def _generator(seed: int, *place: object) -> np.random.Generator:
    """A generator that depends on the seed and the place alone, not on the task."""
    return np.random.default_rng([seed, zlib.crc32(repr(place).encode())])


def _draw_slices(keys: list[str], resamples: int, seed: int):
    """How many positives and negatives every replicate draws from each slice of a key."""

    def run(sizes: pd.DataFrame) -> pd.DataFrame:
        sizes = sizes.sort_values("_slice", ascending=False)  # from the highest scores down
        cells = sizes[["n_pos", "n_neg"]].to_numpy(float)
        n = int(cells.sum())
        drawn = _generator(seed, *sizes[keys].iloc[0].tolist()).multinomial(n, (cells / n).ravel(), resamples).reshape(resamples, -1, 2)
        above = np.cumsum(drawn, axis=1) - drawn
        lists = {"pos": drawn[:, :, 0], "neg": drawn[:, :, 1], "pos_above": above[:, :, 0], "neg_above": above[:, :, 1]}
        out = sizes[[*keys, "_slice"]].copy()
        for name, table in lists.items():
            out[f"_{name}"] = list(table.T)
        out["_neg_total"] = [drawn[:, :, 1].sum(axis=1)] * len(out)
        return out

    return run


def _draw_within(keys: list[str], seed: int):
    """The slices' part of what every replicate draws from their band."""

    def run(sizes: pd.DataFrame, bands: pd.DataFrame) -> pd.DataFrame:
        sizes, band = sizes.sort_values("_slice", ascending=False), bands.iloc[0]
        draw = _generator(seed, *band[[*keys, "_band"]].tolist(), "band")
        out = sizes[[*keys, "_slice"]].copy()
        for g in ("pos", "neg"):
            own, wanted = sizes[f"n_{g}"].to_numpy(float), np.asarray(band[f"_{g}"])
            got = draw.multinomial(wanted, own / own.sum()) if own.sum() else np.zeros((len(wanted), len(own)), int)
            above = np.cumsum(got, axis=1) - got + np.asarray(band[f"_{g}_above"])[:, None]
            out[f"_{g}"], out[f"_{g}_above"] = list(got.T), list(above.T)
        out["_neg_total"] = [band["_neg_total"]] * len(out)
        return out[[*keys, "_slice", "_pos", "_neg", "_pos_above", "_neg_above", "_neg_total"]]

    return run


def _slice_draws(sizes: DataFrame, keys: list[str], resamples: int, seed: int, head: str) -> DataFrame:
    """What every replicate draws from each slice (n_pos, n_neg) of a key.

    A key with more than ``BAND_SLICES`` slices is drawn in two steps, first bands of slices and then the slices of
    a band, each band in a task of its own; the law is the same.
    """
    lists = ", ".join(f"_{x} array<bigint>" for x in ("pos", "neg", "pos_above", "neg_above", "neg_total"))
    sizes = materialise(sizes)
    most = sizes.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= BAND_SLICES:
        return sizes.groupBy(*keys).applyInPandas(_draw_slices(keys, resamples, seed), f"{head}_slice bigint, {lists}")
    banded = sizes.withColumn("_band", F.expr(f"_slice div {BAND_SLICES}"))
    whole = banded.groupBy(*keys, F.col("_band").alias("_slice")).agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
    bands = _slice_draws(whole, keys, resamples, seed, head).withColumnRenamed("_slice", "_band")
    group = [*keys, "_band"]
    return banded.groupBy(*group).cogroup(bands.groupBy(*group)).applyInPandas(_draw_within(keys, seed), f"{head}_slice bigint, {lists}")


def _replicate_sums(keys: list[str], threshold: float, seed: int):
    """What a slice adds to the curve areas and confusion counts of every replicate."""

    def areas(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, p / np.maximum(n, 1), 1.0)

    def run(counts: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        counts = counts.sort_values("v", ascending=False)
        plan = draws.iloc[0]
        chance = {g: counts[f"n_{g}"].to_numpy(float) for g in ("pos", "neg")}
        predicted = counts["v"].to_numpy() > threshold
        parts = []
        for at in range(0, len(plan["_pos"]), REPLICATES_AT_ONCE):
            some = slice(at, at + REPLICATES_AT_ONCE)
            draw = _generator(seed, *plan[[*keys, "_slice"]].tolist(), at)
            got = {}
            for g, share in chance.items():
                wanted = np.asarray(plan[f"_{g}"])[some]
                got[g] = draw.multinomial(wanted, share / share.sum()) if share.sum() else np.zeros((len(wanted), len(share)), int)
            a, b = got["pos"], got["neg"]
            tp = np.cumsum(a, axis=1) + np.asarray(plan["_pos_above"])[some, None]
            fp = np.cumsum(b, axis=1) + np.asarray(plan["_neg_above"])[some, None]
            below = np.asarray(plan["_neg_total"])[some, None] - fp
            strip = (areas(tp, tp + fp) + areas(tp - a, tp - a + fp - b)) / 2
            parts.append(pd.DataFrame({
                "replicate": np.arange(at, at + len(a)), "_beaten": (a * (below + b / 2)).sum(axis=1), "_strip": (a * strip).sum(axis=1),
                "TP": a[:, predicted].sum(axis=1), "FP": b[:, predicted].sum(axis=1), "TN": b[:, ~predicted].sum(axis=1), "FN": a[:, ~predicted].sum(axis=1),
            }))
        out = pd.concat(parts)
        for k in keys:
            out[k] = plan[k]
        return out

    return run


def bootstrap_metrics(
    df: DataFrame,
    label: str,
    score: str,
    resamples: int = 1000,
    seed: int = 30,
    threshold: float = 0.5,
    digits: int | None = 3,
    keys: list[str] | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Percentile intervals of every metric by resampling rows with replacement, per ``keys``.

    Rows with equal score and label are exchangeable, so a replicate is a multinomial draw of
    counts.  Scores are cut into slices of about ``slice_rows`` rows.  First every replicate draws how
    many positives and negatives come from each slice; then each slice draws its own
    scores and adds up what it contributes, given what lies above it.  So no draw is
    ever shuffled: a slice gives one row per replicate.  Draws depend on the seed, the key and
    the slice alone.  Rows without a label or a score are left out, as in the estimate.
    """
    keys = keys or []
    counts = _score_counts(df, keys, label, score, None, None)
    place = F.floor((F.col("c_pos") + F.col("c_neg") - 1) / slice_rows).alias("_slice")
    counts = materialise(counts.select(*keys, "v", place, F.col("n_pos").cast("bigint"), F.col("n_neg").cast("bigint")))
    sizes = counts.groupBy(*keys, "_slice").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
    kinds = {f.name: f.dataType.simpleString() for f in counts.schema.fields}
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    head = f"{named}, " if keys else ""
    draws = _slice_draws(sizes, keys, resamples, seed, head)
    schema = f"replicate bigint, _beaten double, _strip double, TP bigint, FP bigint, TN bigint, FN bigint{', ' + named if keys else ''}"
    group = [*keys, "_slice"]
    summed = counts.groupBy(*group).cogroup(draws.groupBy(*group)).applyInPandas(_replicate_sums(keys, threshold, seed), schema)
    each = summed.groupBy(*keys, "replicate").agg(*[F.sum(c).alias(c) for c in ("_beaten", "_strip", "TP", "FP", "TN", "FN")])
    n_pos, n_neg = F.col("TP") + F.col("FN"), F.col("TN") + F.col("FP")
    each = each.withColumns({"roc_auc": ratio(F.col("_beaten"), n_pos.cast("double") * n_neg), "pr_auc": ratio(F.col("_strip"), n_pos)})
    long = _with_metrics(each, [*keys, "replicate"], digits).unpivot([*keys, "replicate"], list(METRICS), "metric", "value")
    # ``resamples`` values per metric: a parameter, not the data, bounds this.
    intervals = long.groupBy(*keys, "metric").agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("_ci"))
    point = classification_metrics(df, label, score, keys, threshold, digits).unpivot(keys, list(METRICS), "metric", "estimate")
    renamed = intervals.withColumnsRenamed({c: f"_of_{c}" for c in [*keys, "metric"]})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*keys, "metric"]])
    low, high = F.col("_ci")[0], F.col("_ci")[1]
    if digits is not None:
        low, high = F.round(low, digits), F.round(high, digits)
    return point.join(renamed, same).select(
        *keys, "metric", "estimate", low.alias("ci_lower"), high.alias("ci_upper"), F.lit(resamples).alias("n_resamples"), F.lit(seed).alias("seed"),
    )


def calibration_table(
    df: DataFrame, label: str, score: str, bins: int = 10, keys: list[str] | None = None, max_group_rows: int | None = None
) -> DataFrame:
    """Mean prediction, observed rate and size of quantile bins numbered from 1.

    A prediction's bin is one more than the number of inner edges at or below it.
    """
    keys = keys or []
    rows = df.select(*keys, F.col(score).cast("double").alias("v"), F.col(label).cast("boolean").alias("_pos")).where("v IS NOT NULL")
    counts = {"n": F.count(F.lit(1)), "n_pos": F.count_if("_pos")}
    layout = ordered_groups(rows, keys, ["v"], counts, max_group_rows).compute(c=Running(F.col("n")), t=Total(F.col("n")))
    edges = {f"_edge_{i}": i / bins for i in range(1, bins)}
    placed = with_quantiles(layout, edges).frame()
    bin_number = reduce(lambda a, e: a + (F.col("v") >= F.col(e)).cast("int"), edges, F.lit(1))
    return placed.groupBy(*keys, bin_number.alias("bin")).agg(
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean_predicted"),
        (F.sum("n_pos") / F.sum("n")).alias("observed"),
        F.sum("n").alias("n"),
    )


def brier_score(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    clipped = F.least(F.greatest(F.col(score), F.lit(1e-12)), F.lit(1 - 1e-12))
    error = clipped - F.col(label).cast("double")
    return df.groupBy(*(keys or [])).agg(F.avg(error * error).alias("brier_score"))


def calibration_summary(df: DataFrame, label: str, score: str, digits: int | None = 3) -> DataFrame:
    """Brier score with intercept and slope of the outcome on the predicted logit."""
    clipped = F.least(F.greatest(F.col(score), F.lit(1e-12)), F.lit(1 - 1e-12))
    rows = df.select(F.col(label).cast("double").alias("label"), F.log(clipped / (1 - clipped)).alias("logit"))
    assembled = VectorAssembler(inputCols=["logit"], outputCol="features").transform(rows)
    fit = LogisticRegression(regParam=0.0, standardization=False, tol=1e-10, maxIter=200).fit(assembled)
    intercept, slope = float(fit.intercept), float(fit.coefficients[0])
    table = brier_score(df, label, score).withColumns({"calibration_intercept": F.lit(intercept), "calibration_slope": F.lit(slope)})
    return table if digits is None else table.select(*[F.round(c, digits).alias(c) for c in table.columns])
