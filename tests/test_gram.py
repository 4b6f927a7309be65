"""Sums of products, correlations, least squares and densities against numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import gram, quantiles


@pytest.fixture(scope="module")
def table():
    draw = np.random.default_rng(8)
    frame = pd.DataFrame(draw.normal(size=(600, 6)) * [1, 5, 0.01, 1e3, 2, 0] + [1e6, 0, 3, -1e5, 0, 7], columns=list("abcdef"))
    frame["b"] += frame["d"] / 100
    holes = draw.random(frame.shape) < 0.15
    frame = frame.mask(holes)
    frame["g"] = [None if i % 11 == 0 else ["x", "y", "lone"][i % 2 if i > 2 else 2 * (i == 1)] for i in range(600)]
    return frame


def nulls(frame, half=True):
    rows = [[None if isinstance(v, float) and math.isnan(v) and (i % 2 or not half) else v for v in r] for i, r in enumerate(frame.itertuples(index=False))]
    return rows, ", ".join(f"{c} {'string' if c == 'g' else 'double'}" for c in frame.columns)


@pytest.mark.parametrize("rows_at_once", [4_096, 37])
def test_correlations_are_pairwise_complete(spark, table, monkeypatch, rows_at_once):
    monkeypatch.setattr(gram, "ROWS_AT_ONCE", rows_at_once)
    df = spark.createDataFrame(*nulls(table)).repartition(3)
    got = {(r["x"], r["y"]): r["r"] for r in gram.correlations(df, list("abcdef")).collect()}
    assert len(got) == 15
    for (x, y), r in got.items():
        both = table[[x, y]].dropna()
        assert r is None if "f" in (x, y) else r == pytest.approx(np.corrcoef(both[x], both[y])[0, 1], abs=1e-9)


def test_groups_and_few_rows(spark, table, monkeypatch):
    monkeypatch.setattr(gram, "MOST_GROUPS", 1)
    df = spark.createDataFrame(*nulls(table)).repartition(3)
    got = {(r["g"], r["x"], r["y"]): r["r"] for r in gram.correlations(df, ["a", "b", "c"], ["g"]).collect()}
    for g in (None, "x", "y"):
        own = table[table["g"].isna() if g is None else table["g"] == g]
        both = own[["a", "b"]].dropna()
        assert got[g, "b", "a"] == pytest.approx(np.corrcoef(both["a"], both["b"])[0, 1], abs=1e-9)
    assert got["lone", "b", "a"] is None
    assert gram.correlations(df.limit(0), ["a", "b"]).count() == 0


def test_very_many_columns(spark):
    draw = np.random.default_rng(9)
    x = draw.normal(size=(50, 300))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").select(*[F.col("v")[i].alias(f"v{i:03}") for i in range(300)])
    got = gram.correlations(df, df.columns).toPandas()
    assert len(got) == 300 * 299 // 2
    i, j = got["x"].str[1:].astype(int), got["y"].str[1:].astype(int)
    assert got["r"].to_numpy() == pytest.approx(np.corrcoef(x.T)[i, j], abs=1e-9)


def test_least_squares_from_sums(spark, table):
    whole = table[["a", "b", "d", "e"]].dropna()
    df = spark.createDataFrame(*nulls(whole))
    shift = gram.shifts(df, ["a", "b", "d", "e"])
    sums = np.zeros((4, 4, 4))
    for r in gram.pair_sums(df, ["a", "b", "d", "e"], shift=shift).collect():
        sums[:, r["i"]] = r["n"], r["own"], r["square"], r["product"]
    intercept, beta = gram.least_squares({0: sums}, [0, 2, 3], 1, shift)
    design = np.column_stack([np.ones(len(whole)), whole[["a", "d", "e"]] - whole[["a", "d", "e"]].mean()])
    wanted, *_ = np.linalg.lstsq(design, whole["b"], rcond=None)
    assert beta == pytest.approx(wanted[1:], rel=1e-6)
    assert intercept + beta @ whole[["a", "d", "e"]].mean() == pytest.approx(wanted[0], rel=1e-6)


def test_density_by_direct_summation(spark):
    draw = np.random.default_rng(4)
    values = {"x": np.r_[draw.normal(size=300), draw.normal(4, 0.5, 100)], None: draw.exponential(size=50)}
    rows = [(g, float(v)) for g, every in values.items() for v in every] + [("flat", 1.0)] * 3 + [("one", 2.0), ("x", None), ("x", math.nan)]
    got = quantiles.density(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", points=400).toPandas()
    assert set(got["g"].map(lambda g: g if isinstance(g, str) else None)) == {"x", None}
    for g, every in values.items():
        own = got[got["g"].isna() if g is None else got["g"] == g].sort_values("point")
        width = every.std(ddof=1) * len(every) ** -0.2
        x = own["x"].to_numpy()
        direct = np.exp(-0.5 * ((x[:, None] - every) / width) ** 2).sum(axis=1) / (len(every) * width * math.sqrt(2 * math.pi))
        assert len(own) == 400 and own["density"].to_numpy() == pytest.approx(direct, abs=2e-3 * direct.max())
        assert (own["density"] * (x[1] - x[0])).sum() == pytest.approx(1, abs=0.01)
    alone = quantiles.density(spark.createDataFrame(rows, "g string, v double").where("g = 'x'"), [], "v", points=10)
    assert alone.count() == 10 and alone.first()["n"] == 400
