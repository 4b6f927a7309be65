"""Two-group tests, corrections, quantiles and metrics against direct computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.functions import tails
from cohortspark.operators import hypothesis, metrics, multiple, quantiles, splits

LIMITS = [None, 25]


def sample(seed=3, ties=True):
    draw = random.Random(seed)
    rows = []
    for key, n in (("hot", 120), ("a", 40), ("b", 30)):
        for _ in range(n):
            positive = draw.random() < 0.4
            value = draw.gauss(1 if positive else 0.7, 0.5)
            rows.append((key, round(value, 1) if ties else value, positive))
    return rows


def split(rows, key):
    neg = np.array([v for k, v, g in rows if k == key and not g])
    pos = np.array([v for k, v, g in rows if k == key and g])
    return neg, pos


def average_ranks(values):
    values = np.asarray(values)
    return np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])


def direct_tests(neg, pos):
    n1, n2, both = len(neg), len(pos), np.concatenate([neg, pos])
    u = average_ranks(both)[:n1].sum() - n1 * (n1 + 1) / 2
    n = n1 + n2
    _, t = np.unique(both, return_counts=True)
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - ((t**3 - t).sum()) / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd
    a, b = neg.var(ddof=1) / n1, pos.var(ddof=1) / n2
    ks = max(abs((neg <= v).mean() - (pos <= v).mean()) for v in both)

    def against_normal(x):
        x = np.sort(x)
        cdf = np.array([0.5 * math.erfc(-(v - x.mean()) / x.std() / math.sqrt(2)) for v in x])
        i = np.arange(1, len(x) + 1)
        return max((i / len(x) - cdf).max(), (cdf - (i - 1) / len(x)).max())

    return {
        "u_stat": u, "u_p": min(1, math.erfc(z / math.sqrt(2))), "t_stat": (neg.mean() - pos.mean()) / math.sqrt(a + b),
        "t_df": (a + b) ** 2 / (a**2 / (n1 - 1) + b**2 / (n2 - 1)), "ks_d": ks, "ks_d_neg": against_normal(neg),
        "ks_d_pos": against_normal(pos), "med_neg": np.median(neg), "med_pos": np.median(pos), "sum_neg": neg.sum(),
        "sd_pos": pos.std(ddof=1), "n_neg": n1,
    }


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("ties", [True, False])
def test_two_group_tests(spark, limit, ties):
    rows = sample(ties=ties)
    df = spark.createDataFrame([*rows, ("a", None, True), ("a", float("nan"), False)], "k string, v double, g boolean")
    got = hypothesis.two_group_tests(df, ["k"], "v", F.col("g"), max_group_rows=limit).collect()
    assert len(got) == 3
    for r in got:
        neg, pos = split(rows, r["k"])
        for name, value in direct_tests(neg, pos).items():
            assert r[name] == pytest.approx(value, rel=1e-9), (r["k"], name)
        assert r["t_p"] == pytest.approx(tails.student_two_sided(np.array([r["t_stat"]]), np.array([r["t_df"]]))[0])
        assert r["ks_p"] == pytest.approx(tails.ks_two_sample_tail(r["ks_d"], len(neg), len(pos)))
        assert r["ks_p_neg"] == pytest.approx(tails.ks_one_sample_tail(r["ks_d_neg"], len(neg)))


def test_small_groups_are_counted_exactly(spark):
    df = spark.createDataFrame([("k", float(i), i > 3) for i in range(1, 7)], "k string, v double, g boolean")
    assert hypothesis.mann_whitney(df, ["k"], "v", F.col("g")).first()["u_p"] == pytest.approx(0.1)
    same = spark.createDataFrame([("k", 1.0, i > 3) for i in range(1, 7)], "k string, v double, g boolean")
    assert hypothesis.mann_whitney(same, ["k"], "v", F.col("g")).first()["u_p"] == 1
    lone = spark.createDataFrame([("k", 1.0, True)], "k string, v double, g boolean")
    row = hypothesis.two_group_tests(lone, ["k"], "v", F.col("g")).first()
    assert row["u_p"] is None and row["t_p"] is None and row["ks_p"] is None


def test_cohens_d(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "k string, v double, g boolean")
    for r in hypothesis.cohens_d(df, ["k"], "v", F.col("g")).collect():
        neg, pos = split(rows, r["k"])
        pooled = ((len(pos) - 1) * pos.var(ddof=1) + (len(neg) - 1) * neg.var(ddof=1)) / (len(pos) + len(neg) - 2)
        assert r["cohens_d"] == pytest.approx((pos.mean() - neg.mean()) / math.sqrt(pooled))


# Hand-computed vector.
RAW = [0.001, 0.008, 0.039, 0.041, 0.042]


@pytest.mark.parametrize("limit", [None, 2])
@pytest.mark.parametrize(
    "method,wanted",
    [
        ("fdr_bh", [0.005, 0.02, 0.042, 0.042, 0.042]),
        ("bonferroni", [0.005, 0.04, 0.195, 0.205, 0.21]),
        ("holm", [0.005, 0.032, 0.117, 0.117, 0.117]),
        ("fdr_by", [q * (1 + 1 / 2 + 1 / 3 + 1 / 4 + 1 / 5) for q in (0.005, 0.02, 0.042, 0.042, 0.042)]),
    ],
)
def test_corrections(spark, method, wanted, limit):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([*RAW, None, float("nan")])], "i int, p double")
    got = [r["adj_p"] for r in multiple.adjust_pvalues(df, ["p"], method=method, max_group_rows=limit).orderBy("i").collect()]
    assert got[:5] == pytest.approx(wanted) and got[5:] == [None, None]
    assert all(q >= p for q, p in zip(got, RAW))


def test_rows_without_a_family_are_a_family(spark):
    df = spark.createDataFrame([(i, None, p) for i, p in enumerate(RAW)] + [(9, "f", 0.5)], "i int, fam string, p double")
    got = {r["i"]: r["adj_p"] for r in multiple.adjust_pvalues(df, ["p"], by=["fam"]).collect()}
    assert got[0] == pytest.approx(0.005) and got[4] == pytest.approx(0.042) and got[9] == 0.5


def test_correction_is_monotone_with_ties_and_families(spark):
    draw = random.Random(5)
    rows = [(i, "f" if i % 3 else "g", round(draw.random() ** 2, 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, fam string, p double")
    got = multiple.adjust_pvalues(df, ["p"], by=["fam"], max_group_rows=40).collect()
    for family in "fg":
        part = sorted((r["p"], r["adj_p"]) for r in got if r["fam"] == family)
        p = np.array([x for x, _ in part])
        m = len(p)
        direct = np.minimum(1, np.minimum.accumulate((p * m / np.arange(1, m + 1))[::-1])[::-1])
        assert [q for _, q in part] == pytest.approx(list(direct))


@pytest.mark.parametrize("limit", LIMITS)
def test_quantiles_and_boxes(spark, limit):
    rows = sample()
    df = spark.createDataFrame(rows, "k string, v double, g boolean")
    levels = {"lo": 0.025, "q1": 0.25, "med": 0.5, "hi": 0.975}
    for r in quantiles.group_quantiles(df, ["k"], "v", levels, limit).collect():
        values = [v for k, v, _ in rows if k == r["k"]]
        assert [r[n] for n in levels] == pytest.approx(list(np.quantile(values, list(levels.values()))))
    for r in quantiles.boxplot_summary(df, ["k"], "v", limit).collect():
        values = np.array([v for k, v, _ in rows if k == r["k"]])
        q1, q3 = np.quantile(values, [0.25, 0.75])
        inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
        assert (r["whisker_low"], r["whisker_high"]) == pytest.approx((inside.min(), inside.max()))
        assert r["n_outliers"] == len(values) - len(inside) and r["n"] == len(values)


@pytest.mark.parametrize("limit", LIMITS)
def test_quantile_pairs(spark, limit):
    rows = [(v, g) for _, v, g in sample()]
    df = spark.createDataFrame(rows, "v double, g boolean")
    got = quantiles.quantile_pairs(df, "v", F.col("g"), limit).orderBy("level").collect()
    x, y = [v for v, g in rows if g], [v for v, g in rows if not g]
    levels = np.linspace(0, 1, min(len(x), len(y)))
    assert [r["x"] for r in got] == pytest.approx(list(np.quantile(x, levels)))
    assert [r["y"] for r in got] == pytest.approx(list(np.quantile(y, levels)))


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in (-0.1, 0.0, 0.49, 0.5, 1.0, 1.1)], "x double")
    got = {r["bin"]: r["n"] for r in quantiles.histogram(df, [], "x", 0.0, 1.0, 2).collect()}
    assert got == {0: 1, 1: 2, 2: 2, 3: 1}


def direct_metrics(y, p, threshold=0.5):
    y, p = np.array(y), np.array(p)
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    points = [(0.0, 1.0)]
    for t in sorted(set(p), reverse=True):
        tp, fp = ((p >= t) & (y == 1)).sum(), ((p >= t) & (y == 0)).sum()
        points.append((tp / (y == 1).sum(), tp / (tp + fp)))
    area = sum((r1 - r0) * (p1 + p0) / 2 for (r0, p0), (r1, p1) in zip(points, points[1:]))
    TP, FP = ((p > threshold) & (y == 1)).sum(), ((p > threshold) & (y == 0)).sum()
    return auc, area, TP, FP


@pytest.mark.parametrize("limit", LIMITS)
def test_metrics(spark, limit):
    draw = random.Random(8)
    rows = [(int(draw.random() < 0.4), round(draw.random(), 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "y int, p double")
    r = metrics.classification_metrics(df, "y", "p", digits=None, max_group_rows=limit).first()
    auc, area, tp, fp = direct_metrics(*zip(*rows))
    assert (r["roc_auc"], r["pr_auc"], r["TP"], r["FP"]) == pytest.approx((auc, area, tp, fp))
    assert r["TP"] + r["TN"] + r["FP"] + r["FN"] == 200


def test_top_score_tied_across_classes(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.1)], "y int, p double")
    assert metrics.classification_metrics(df, "y", "p", digits=None).first()["pr_auc"] == pytest.approx(0.6666667, abs=1e-6)
    single = spark.createDataFrame([(1, 0.9), (1, 0.1)], "y int, p double")
    r = metrics.classification_metrics(single, "y", "p").first()
    assert r["roc_auc"] is None and r["specificity"] is None and r["sensitivity"] == 0.5


def test_bootstrap_and_calibration(spark):
    draw = random.Random(9)
    rows = []
    for i in range(400):
        p = draw.random()
        rows.append((i, int(draw.random() < p), p))
    df = spark.createDataFrame(rows, "id int, y int, p double")
    intervals = metrics.bootstrap_metrics(df, "y", "p", resamples=100).collect()
    assert len(intervals) == 9
    again = metrics.bootstrap_metrics(df.repartition(3), "y", "p", resamples=100).collect()
    assert sorted(intervals) == sorted(again)
    unlabelled = df.withColumn("y", F.lit(None).cast("int"))
    assert sorted(metrics.bootstrap_metrics(df.unionByName(unlabelled), "y", "p", resamples=100).collect()) == sorted(intervals)
    both = df.withColumn("model", F.lit("a")).unionByName(df.withColumns({"model": F.lit("b"), "p": 1 - F.col("p")}))
    keyed = metrics.bootstrap_metrics(both, "y", "p", resamples=200, keys=["model"], slice_rows=37, digits=None).collect()
    assert len(keyed) == 18 and all(r["ci_lower"] <= r["estimate"] <= r["ci_upper"] for r in keyed)
    wide = {(r["model"], r["metric"]): r for r in keyed}
    n, share = len(rows), wide["a", "accuracy"]["estimate"]
    normal = 2 * 1.96 * math.sqrt(share * (1 - share) / n)
    assert wide["a", "accuracy"]["ci_upper"] - wide["a", "accuracy"]["ci_lower"] == pytest.approx(normal, rel=0.25)
    assert wide["a", "roc_auc"]["estimate"] == pytest.approx(1 - wide["b", "roc_auc"]["estimate"])
    assert all(r["ci_lower"] <= r["estimate"] <= r["ci_upper"] for r in intervals)
    bins = metrics.calibration_table(df, "y", "p").orderBy("bin").collect()
    assert [r["bin"] for r in bins] == list(range(1, 11)) and sum(r["n"] for r in bins) == 400
    assert {r["n"] for r in bins} == {40}
    summary = metrics.calibration_summary(df, "y", "p", digits=None).first()
    assert summary["calibration_slope"] == pytest.approx(1, abs=0.3)
    assert summary["brier_score"] == pytest.approx(np.mean([(p - y) ** 2 for _, y, p in rows]))


def test_split_sizes(spark):
    df = spark.range(26_798).select("id", (F.col("id") < 9_409).alias("label"))
    got = splits.stratified_split(df, "id", "label").groupBy("label", "is_test").count().collect()
    sizes = {(r["label"], r["is_test"]): r["count"] for r in got}
    assert sizes[True, True] + sizes[False, True] == 8_040
    assert sizes[True, False] + sizes[False, False] == 18_758
    assert sizes[True, True] == round(8_040 * 9_409 / 26_798)


def test_a_continuous_column_is_no_label(spark):
    with pytest.raises(ValueError):
        splits.stratified_split(spark.range(2_000).withColumn("label", F.col("id")), "id", "label")


def test_folds(spark):
    df = spark.range(103).select("id", (F.col("id") % 3 == 0).alias("label"))
    sizes = [r["count"] for r in splits.assign_folds(df, "id", 5).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [21, 21, 21, 20, 20]
    dealt = splits.assign_folds(df, "id", 5, by="label").groupBy("label", "fold").count().collect()
    for label, n in ((True, 35), (False, 68)):
        counts = [r["count"] for r in dealt if r["label"] == label]
        assert sum(counts) == n and max(counts) - min(counts) <= 1


def test_folds_of_a_small_class(spark):
    # Three rows in five folds: one each in the first three.
    df = spark.createDataFrame([(i, "x") for i in range(3)] + [(i, None) for i in range(10, 17)], "id int, c string")
    got = splits.assign_folds(df, "id", 5, by="c").collect()
    assert sorted(r["fold"] for r in got if r["c"] == "x") == [0, 1, 2]
    assert sorted(r["fold"] for r in got if r["c"] is None) == [0, 0, 1, 1, 2, 3, 4]


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_draws_in_bands_follow_the_law(spark, monkeypatch, keys):
    # Forty slices in bands of three: four steps.
    rows = [(g, k, 5 + k, 0 if k == 7 else 80 - k) for g in (["a", None] if keys else ["a"]) for k in range(40)]
    sizes = spark.createDataFrame(rows, "g string, _slice bigint, n_pos bigint, n_neg bigint")
    monkeypatch.setattr(metrics, "BAND_SLICES", 3)
    draws = metrics._slice_draws(sizes, keys, 600, 5, "g string, " if keys else "").collect()
    again = metrics._slice_draws(sizes.repartition(5), keys, 600, 5, "g string, " if keys else "").collect()
    assert sorted(map(str, draws)) == sorted(map(str, again)) and len(draws) == len(rows)
    for g in {r["g"] if keys else "a" for r in draws}:
        own = {r["_slice"]: r for r in draws if not keys or r["g"] == g}
        size = {k: (p, n) for h, k, p, n in rows if h == g}
        pos, neg = (np.array([own[k][c] for k in range(40)]) for c in ("_pos", "_neg"))
        n = sum(p + m for p, m in size.values())
        assert (pos.sum(axis=0) + neg.sum(axis=0) == n).all() and (np.array(own[0]["_neg_total"]) == neg.sum(axis=0)).all()
        for k in range(40):
            assert (np.array(own[k]["_pos_above"]) == pos[k + 1 :].sum(axis=0)).all() and (np.array(own[k]["_neg_above"]) == neg[k + 1 :].sum(axis=0)).all()
            for drawn, wanted in zip((pos[k], neg[k]), size[k]):
                assert drawn.mean() == pytest.approx(wanted, abs=0.35 * math.sqrt(wanted) + 1e-9)
                assert drawn.var() == pytest.approx(wanted * (1 - wanted / n), rel=0.3) if wanted else not drawn.any()
