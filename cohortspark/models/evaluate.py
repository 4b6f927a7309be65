"""Experiments: cross-validation, ablation, transfer, feature use."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.numeric import ratio
from cohortspark.models import boosting
from cohortspark.models.boosting import Booster, Settings
from cohortspark.models.build import (
    PRESETS, Run, VotingModel, build_regressors, fit_classifier, run_on_split, scored, scored_by_all, split_once,
)
from cohortspark.operators import gram
from cohortspark.operators.clean import column
from cohortspark.operators.metrics import METRICS, classification_metrics
from cohortspark.operators.splits import SEED, assign_folds


# The nine and seventeen variables of the two regression feature sets, in the order
# in which trees break ties.
CORE = ["AGE", "BMI", "FASTING_GLUCOSE", "HBA1C", "HDL_C", "SEX", "TG", "T_CHO"]
ADDITIONAL = ["BUN", "CREATININE", "URIC_ACID", "LDL_C", "SGOT", "SGPT", "MAP", "BODY_WAISTLINE"]
REGRESSION_SETS = {"nine": [*CORE, "RACE"], "seventeen": [*CORE, *ADDITIONAL, "RACE"]}


def regression_scores(predictions: DataFrame, by: list[str], y: str = "y", fitted: str = "prediction") -> DataFrame:
    """R2, MAE and RMSE per group, two passes over centred values."""
    error = F.col(y) - F.col(fitted)
    table = predictions.groupBy(*by).agg(
        F.sum(error * error).alias("_sse"), F.avg(F.abs(error)).alias("mae"), F.count(F.lit(1)).alias("n"), F.var_pop(y).alias("_var")
    )
    return table.select(
        *by, "n", (1 - ratio(F.col("_sse"), F.col("_var") * F.col("n"))).alias("r2"), "mae", F.sqrt(F.col("_sse") / F.col("n")).alias("rmse")
    )


def linear_scores(rows: DataFrame, feature_sets: dict[str, list[str]], folds: int) -> dict[str, list[float]]:
    """Mean R2, MAE and RMSE over folds of least squares on every feature set.

    One scan sums products by fold, so the fit without a fold is the total less that fold; a second one scores all folds
    and sets.  What reaches the driver is a square of the columns per fold.
    """
    used = list(dict.fromkeys(c for columns in feature_sets.values() for c in columns))
    every = [*used, "label"]
    shift = gram.shifts(rows, every)
    sums: dict[int, np.ndarray] = {f: np.zeros((4, len(every), len(every))) for f in range(folds)}
    for r in gram.pair_sums(rows, every, ["fold"], shift).collect():
        sums[r["fold"]][:, r["i"]] = r["n"], r["own"], r["square"], r["product"]
    scores = []
    for k, columns in enumerate(feature_sets.values()):
        places = [every.index(c) for c in columns]
        fits = [gram.least_squares({g: s for g, s in sums.items() if g != f}, places, len(used), shift) for f in range(folds)]
        of_fold = lambda values: F.array(*[F.lit(float(v)) for v in values])[F.col("fold")]
        fitted = of_fold([intercept for intercept, _ in fits])
        for at, c in enumerate(columns):
            fitted = fitted + of_fold([beta[at] for _, beta in fits]) * column(c)
        error = F.col("label") - fitted
        scores += [F.sum(error * error).alias(f"s{k}"), F.avg(F.abs(error)).alias(f"a{k}")]
    held = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.var_pop("label").alias("var"), *scores).collect()
    out = {}
    for k, name in enumerate(feature_sets):
        each = [(1 - r[f"s{k}"] / (r["var"] * r["n"]) if r["var"] else float("nan"), r[f"a{k}"], math.sqrt(r[f"s{k}"] / r["n"])) for r in held]
        out[name] = [float(sum(e[m] for e in each) / len(each)) for m in range(3)]
    return out


def evaluate_feature_sets(
    df: DataFrame, key: str, target: str, feature_sets: dict[str, list[str]] | None = None, models: dict | None = None, folds: int = 5,
    seed: int = SEED, log_target: bool = True,
) -> DataFrame:
    """Cross-validate every regressor on every feature set (default: the nine and the seventeen variables); same folds throughout.

    Returns ``model, feature_set, n_features, r2, mae, rmse`` (means over folds).
    """
    models = models or build_regressors(seed)
    feature_sets = REGRESSION_SETS if feature_sets is None else feature_sets
    y = F.log(column(target)) if log_target else column(target).cast("double")
    used = list(dict.fromkeys(c for columns in feature_sets.values() for c in columns))
    rows = assign_folds(df.select(key, y.alias("label"), *[column(c) for c in used if c != key]), key, folds, seed).persist()
    try:
        results = []
        plain = {m for m, (stages, regressor) in models.items() if not stages and isinstance(regressor, LinearRegression) and not regressor.getRegParam()}
        linear = linear_scores(rows, feature_sets, folds) if plain else {}
        for set_name, columns in feature_sets.items():
            assembled = VectorAssembler(inputCols=columns, outputCol="features").transform(rows).select("fold", "label", "features").persist()
            for model_name, (stages, regressor) in models.items():
                if model_name in plain:
                    results.append((model_name, set_name, len(columns), *linear[set_name]))
                    continue
                scores = []
                for fold in range(folds):
                    if isinstance(regressor, Settings):
                        fitted = boosting.fit(rows.where(F.col("fold") != fold), columns, "label", regressor)
                        held_out = fitted.transform(rows.where(F.col("fold") == fold))
                    else:
                        fitted = Pipeline(stages=[*stages, regressor]).fit(assembled.where(F.col("fold") != fold))
                        held_out = fitted.transform(assembled.where(F.col("fold") == fold))
                    scores.append(regression_scores(held_out, [], "label").first())
                means = [float(sum(s[m] for s in scores) / folds) for m in ("r2", "mae", "rmse")]
                results.append((model_name, set_name, len(columns), *means))
            assembled.unpersist()
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(results, "model string, feature_set string, n_features int, r2 double, mae double, rmse double")


def contributing_features(model: Booster, df: DataFrame | None = None, digits: int = 3) -> dict:
    """Share of the input features with importance above zero.

    Columns constant in ``df`` (a null counts as a value) leave both counts.
    """
    names = model.features
    importance = model.importance
    constant: list[str] = []
    if df is not None:
        # One pass; constant means equal extremes without nulls, or nulls only.
        checks = [
            (((F.min(column(n)) == F.max(column(n))) & (F.count(column(n)) == F.count(F.lit(1)))) | (F.count(column(n)) == 0)).alias(f"c{i}")
            for i, n in enumerate(names)
        ]
        flags = df.agg(*checks).first()
        constant = [n for n, flag in zip(names, flags) if flag]
    considered = [n for n in names if n not in constant]
    contributing = sum(1 for n in considered if importance[n] > 0)
    share = round(contributing / len(considered), digits) if considered else None
    return {"ratio": share, "contributing": contributing, "total": len(considered), "constant_features": constant}


def _metric_row(predictions: DataFrame) -> dict:
    return classification_metrics(predictions, "y", "p").first().asDict()


_METRIC_SCHEMA = "TP bigint, TN bigint, FP bigint, FN bigint, " + ", ".join(f"{m} double" for m in METRICS)


def _metric_values(metrics: dict) -> list:
    return [metrics[c] for c in ("TP", "TN", "FP", "FN")] + [metrics[m] for m in METRICS]


def feature_ablation(
    df: DataFrame, key: str, label: str, feature_sets: dict[str, list[str]], algorithm: str = "XGBoost", params: dict | None = None, **options
) -> DataFrame:
    """One classifier per feature set on a common split, with feature use."""
    rows, split = [], split_once(df, key, label)
    for name, features in feature_sets.items():
        run = run_on_split(split, features, label, algorithm, params, **options)
        use = contributing_features(run.model, run.train)
        rows.append((name, len(features), *_metric_values(_metric_row(run.predictions(key, label))), use["ratio"], use["contributing"], use["total"]))
    schema = f"feature_set string, n_features int, {_METRIC_SCHEMA}, cfr double, contributing_features int, features_considered int"
    return df.sparkSession.createDataFrame(rows, schema)


def score_external(model: Booster | PipelineModel | VotingModel, df: DataFrame, key: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Metrics of a fitted model on a whole other cohort."""
    predictions = scored(model, df).select(key, F.col(label).cast("int").alias("y"), "p")
    table = classification_metrics(predictions, "y", "p", threshold=threshold)
    return table.withColumn("n_samples", F.col("TP") + F.col("TN") + F.col("FP") + F.col("FN"))


def cross_cohort_transfer(
    cohorts: dict[str, DataFrame], features: list[str], key: str, label: str, params: dict[str, dict[str, dict]] | None = None, **options
) -> DataFrame:
    """Each cohort's models on their own hold-out and on every other whole cohort.

    Per cohort: all presets plus their soft vote.  ``params`` is cohort -> preset.
    """
    scored_parts = []
    for name, frame in cohorts.items():
        split = split_once(frame, key, label)
        models = fit_all(split.where(~F.col("is_test")), features, label, (params or {}).get(name), **options)
        targets = [("within-cohort hold-out", f"{name} (hold-out)", split.where("is_test"))]
        targets += [("cross-cohort", f"{other} (all)", f) for other, f in cohorts.items() if other != name]
        for evaluation, target, data in targets:
            named = {"evaluation": F.lit(evaluation), "trained_on": F.lit(name), "evaluated_on": F.lit(target)}
            scored_parts.append(scored_by_all(models, data, key, label).withColumns(named))
    predictions = reduce(lambda a, b: a.unionByName(b), scored_parts)
    table = classification_metrics(predictions, "y", "p", ["evaluation", "trained_on", "evaluated_on", "model"])
    return table.withColumn("n_samples", F.col("TP") + F.col("TN") + F.col("FP") + F.col("FN"))


def fit_all(train: DataFrame, features: list[str], label: str, params: dict[str, dict] | None = None, **options) -> dict:
    """Every preset and their soft vote.

    Fits are deterministic given rows and seed, so the vote takes the fitted presets.
    """
    models: dict = {a: fit_classifier(train, features, label, a, (params or {}).get(a, {}), **options) for a in PRESETS}
    return models | {"Voting": VotingModel(list(models.values()))}


def pooled_performance(
    df: DataFrame, features: list[str], key: str, label: str, params: dict[str, dict] | None = None, **options
) -> tuple[DataFrame, dict[str, Run]]:
    """All presets and their soft vote on one split of a pooled cohort."""
    split = split_once(df, key, label)
    train, test = split.where(~F.col("is_test")).drop("is_test"), split.where("is_test").drop("is_test")
    models = fit_all(train, features, label, params, **options)
    runs = {name: Run(model, train, scored(model, test), features) for name, model in models.items()}
    table = classification_metrics(scored_by_all(models, test, key, label), "y", "p", ["model"])
    return table.withColumn("n_features", F.lit(len(features))), runs
