"""Attribution of predictions to features, and the ranking built on it."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.models.boosting import Booster
from cohortspark.models.build import fit_classifier, scored
from cohortspark.operators.clean import column


MOST_TABULATED = 8  # features on the way to a leaf; every set of them has a row in the leaf's table


def leaf_rules(model: Booster) -> tuple[list[tuple], float]:
    """Every leaf of an ensemble as (value, features, lows, highs, shares, misses).

    A leaf is reached when each of its features lies in (low, high], or is missing where ``misses`` says so; ``shares`` are
    the shares of the training weight that follow the feature's splits.  The size is that of the
    model, not the data.  The second result is the expected margin.
    """
    leaves, expected = [], model.base
    for tree in model.trees:
        stack: list[tuple[int, dict]] = [(0, {})]
        while stack:
            node, way = stack.pop()
            if tree.left[node] < 0:
                value = model.settings.rate * tree.value[node]
                names = list(way)
                lows, highs, shares, misses = ([way[f][k] for f in names] for k in range(4))
                leaves.append((value, names, lows, highs, shares, misses))
                expected += value * math.prod(shares)
                continue
            feature, threshold = tree.feature[node], tree.threshold[node]
            low, high, share, missing = way.get(feature, (-math.inf, math.inf, 1.0, True))
            for child, bounds, to in ((tree.left[node], (low, min(high, threshold)), tree.missing_left[node]), (tree.right[node], (max(low, threshold), high), not tree.missing_left[node])):
                part = share * tree.weight[child] / tree.weight[node] if tree.weight[node] else 0.0
                stack.append((child, {**way, feature: (*bounds, part, missing and to)}))
    return leaves, expected


def leaf_tables(leaves: list[tuple]) -> list[tuple]:
    """Leaves with the attributions of every set of features that a row may follow, computed once for a model.

    Leaves with equally many features are tabulated together; one with more than ``MOST_TABULATED`` keeps None and is worked out
    for the sets that occur.
    """
    tables: list = [None] * len(leaves)
    by_size: dict[int, list[int]] = {}
    for i, leaf in enumerate(leaves):
        by_size.setdefault(len(leaf[1]), []).append(i)
    for d, members in by_size.items():
        if not 0 < d <= MOST_TABULATED:
            continue
        follows = ((np.arange(1 << d)[:, None] >> np.arange(d)) & 1).astype(float)
        values, shares = np.array([leaves[i][0] for i in members]), np.array([leaves[i][4] for i in members])
        weight = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
        for f in range(d):
            coefficients = np.zeros((len(members), 1 << d, d))
            coefficients[..., 0] = 1.0
            for g in range(d):
                if g != f:
                    shifted = np.zeros_like(coefficients)
                    shifted[..., 1:] = coefficients[..., :-1] * follows[None, :, g : g + 1]
                    coefficients = coefficients * shares[:, g, None, None] + shifted
            part = values[:, None] * (follows[None, :, f] - shares[:, f, None]) * (coefficients @ weight)
            for i, row in zip(members, part):
                tables[i] = np.empty((1 << d, d)) if tables[i] is None else tables[i]
                tables[i][:, f] = row
    return [(*leaf, table) for leaf, table in zip(leaves, tables)]


def _pattern_attributions(value: float, shares: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Shapley values of one leaf for each pattern of followed features.

    A feature outside a coalition contributes its training share, one inside whether
    the row follows it.  The products over all coalitions of a size are the
    coefficients of prod(share + follow * t).
    """
    patterns, d = follows.shape
    out = np.empty((patterns, d))
    size_weight = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
    for f in range(d):
        coefficients = np.zeros((patterns, d))
        coefficients[:, 0] = 1.0
        for g in range(d):
            if g != f:
                shifted = np.zeros_like(coefficients)
                shifted[:, 1:] = coefficients[:, :-1] * follows[:, g : g + 1]
                coefficients = coefficients * shares[g] + shifted
        out[:, f] = value * (follows[:, f] - shares[f]) * (coefficients @ size_weight)
    return out


def attribute_batch(x: np.ndarray, leaves: list[tuple]) -> np.ndarray:
    """Attributions of a batch of rows, from leaves or from their tables; NaN is a missing value.

    Without ``misses`` a missing value goes right.
    """
    missing = np.isnan(x)
    out = np.zeros_like(x)
    for value, features, lows, highs, shares, *rest in leaves:
        if not features:
            continue
        part, high = x[:, features], np.asarray(highs)
        misses = np.asarray(rest[0]) if rest else high == math.inf
        follows = np.where(missing[:, features], misses, (part > np.asarray(lows)) & ((part <= high) | (high == math.inf)))
        codes = follows @ (1 << np.arange(len(features), dtype=np.int64))
        if len(rest) > 1 and rest[1] is not None:
            out[:, features] += rest[1][codes]
            continue
        _, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
        table = _pattern_attributions(value, np.asarray(shares), follows[first].astype(float))
        out[:, features] += table[inverse]
    return out


def tree_attributions(model: Booster, df: DataFrame, name: str = "attribution") -> tuple[DataFrame, float]:
    """Add an array of path-dependent Shapley values on the margin, in feature order.

    The leaves' tables are made once and broadcast; a row then costs a lookup per leaf, in Arrow batches where
    it is.  Returns the frame and the expected margin: it plus the attributions of
    a row is the row's margin.
    """
    leaves, expected = leaf_rules(model)
    shared = df.sparkSession.sparkContext.broadcast(leaf_tables(leaves))  # the size of the model

    def attribute(*columns: pa.Array) -> pa.Array:
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns], axis=1)
        got = attribute_batch(x, shared.value)
        return pa.ListArray.from_arrays(pa.array((np.arange(len(got) + 1) * got.shape[1]).astype(np.int32)), pa.array(got.ravel()))

    return df.withColumn(name, F.arrow_udf(attribute, "array<double>")(*[column(f).cast("double") for f in model.features])), expected


def linear_attributions(model: PipelineModel, df: DataFrame, background: DataFrame, name: str = "attribution") -> DataFrame:
    """Attributions of a linear model: coefficient times distance from the mean."""
    names = model.stages[0].getInputCols()
    coefficients = model.stages[-1].coefficients.toArray()
    means = background.agg(*[F.avg(column(n)).alias(f"m{i}") for i, n in enumerate(names)]).first()
    parts = [F.lit(float(c)) * (column(n) - F.lit(m)) for n, c, m in zip(names, coefficients, means)]
    return df.withColumn(name, F.array(*parts))


def attributions_long(df: DataFrame, key: str, features: list[str], name: str = "attribution") -> DataFrame:
    """One row per key and feature."""
    named = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col(name).alias("value"))
    return df.select(key, F.explode(named).alias("a")).select(key, F.col("a.feature").alias("feature"), F.col("a.value").alias("attribution"))


def rank_features(df: DataFrame, features: list[str], top: int | None = None, name: str = "attribution") -> DataFrame:
    """Features by mean absolute attribution, ties by name.

    Summed as vectors, so the rows are not multiplied by the number of features.
    """
    vectors = df.select(Summarizer.metrics("normL1", "count").summary(array_to_vector(name)).alias("s"))
    pairs = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), vector_to_array("s.normL1").alias("total"))
    ranked = vectors.select(F.col("s.count").alias("n"), F.explode(pairs).alias("p")).select(
        F.col("p.feature").alias("feature"), (F.col("p.total") / F.col("n")).alias("mean_abs")
    )
    ordered = ranked.orderBy(F.desc("mean_abs"), "feature")
    return ordered if top is None else ordered.limit(top)


def top_features_retrain(
    model: Booster, train: DataFrame, test: DataFrame, label: str, algorithm: str, params: dict | None = None, top: int = 20, **options
) -> tuple[list[str], Booster, DataFrame]:
    """Refit on the ``top`` features of the explained model, same rows and parameters."""
    explained, _ = tree_attributions(model, test)
    chosen = [r["feature"] for r in rank_features(explained, model.features, top).collect()]
    refitted = fit_classifier(train, chosen, label, algorithm, params, **options)
    return chosen, refitted, scored(refitted, test)


def margin(model: Booster, df: DataFrame, name: str = "margin") -> DataFrame:
    """The boosted margin; the probability is its logistic function."""
    return model.with_margin(df, name)
