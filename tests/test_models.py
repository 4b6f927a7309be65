"""Models: attribution against enumeration, votes, persistence, search."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.models import build, evaluate, explain, search
from cohortspark.sources import writers

FEATURES = ["a", "b", "c"]
SMALL = {"n_estimators": 3, "max_depth": 3}


@pytest.fixture(scope="module")
def cohort(spark):
    draw = random.Random(6)
    rows = []
    for i in range(400):
        a, b = draw.random(), draw.random()
        rows.append((i, a, b, 1.0, a * b + 0.1 * draw.random() > 0.3))
    return spark.createDataFrame(rows, "id int, a double, b double, c double, label boolean").cache()


def enumerated(leaves, x, d):
    """Shapley values by all coalitions, from the definition."""

    def value(coalition):
        total = 0.0
        for v, feats, lows, highs, shares, _ in leaves:
            weight = v
            for f, lo, hi, share in zip(feats, lows, highs, shares):
                weight *= (lo < x[f] <= hi) if f in coalition else share
            total += weight
        return total

    out = []
    for f in range(d):
        others = [g for g in range(d) if g != f]
        phi = 0.0
        for k in range(d):
            for s in itertools.combinations(others, k):
                phi += math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) * (value({*s, f}) - value(set(s)))
        out.append(phi)
    return out


def test_tree_attributions(spark, cohort):
    model = build.fit_classifier(cohort, FEATURES, "label", "XGBoost", SMALL)
    leaves, expected = explain.leaf_rules(model)
    rows, base = explain.tree_attributions(model, explain.margin(model, cohort))
    assert base == expected
    for r in rows.limit(25).collect():
        x = [r["a"], r["b"], r["c"]]
        assert r["attribution"] == pytest.approx(enumerated(leaves, x, 3), abs=1e-12)
        assert expected + sum(r["attribution"]) == pytest.approx(r["margin"], abs=1e-9)
    p = {r["id"]: r["p"] for r in build.scored(model, cohort).collect()}
    some = rows.first()
    assert p[some["id"]] == pytest.approx(1 / (1 + math.exp(-some["margin"])))
    ranked = explain.rank_features(rows, FEATURES).collect()
    assert ranked[-1]["feature"] == "c" and ranked[-1]["mean_abs"] == 0
    long = explain.attributions_long(rows, "id", FEATURES)
    means = {r["feature"]: r["m"] for r in long.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("m")).collect()}
    assert {r["feature"]: r["mean_abs"] for r in ranked} == pytest.approx(means)


def test_missing_values_go_right():
    leaves = [(1.0, [0], [-math.inf], [0.5], [0.25]), (3.0, [0], [0.5], [math.inf], [0.75])]
    got = explain.attribute_batch(np.array([[0.1], [0.9], [np.nan], [np.inf]]), leaves)
    assert got[:, 0] == pytest.approx([-1.5, 0.5, 0.5, 0.5])


def test_tables_of_leaves_equal_working_them_out():
    draw = np.random.default_rng(5)
    leaves = []
    for d in (0, 1, 3, 6, 9):
        for _ in range(4):
            low = draw.normal(size=d) - 1
            leaves.append((float(draw.normal()), list(map(int, draw.permutation(10)[:d])), list(low), list(low + draw.random(d) * 3), list(draw.random(d)), list(draw.random(d) < 0.5)))
    x = draw.normal(size=(300, 10))
    x[draw.random(x.shape) < 0.1] = np.nan
    assert explain.attribute_batch(x, explain.leaf_tables(leaves)) == pytest.approx(explain.attribute_batch(x, leaves), abs=1e-12)


def test_attributions_of_rows_with_missing_values_add_up(spark, cohort):
    rows = cohort.withColumn("a", F.when(F.col("id") % 7 > 0, F.col("a"))).withColumn("b", F.when(F.col("id") % 5 > 0, F.col("b")).otherwise(float("nan")))
    model = build.fit_classifier(rows, FEATURES, "label", "lightGBM", {"n_estimators": 4, "num_leaves": 6})
    assert any(any(t.missing_left) for t in model.trees)
    got, base = explain.tree_attributions(model, explain.margin(model, rows))
    assert all(base + sum(r["attribution"]) == pytest.approx(r["margin"], abs=1e-9) for r in got.collect())


def test_contributing_features(cohort):
    model = build.fit_classifier(cohort, FEATURES, "label", "CatBoost", SMALL)
    use = evaluate.contributing_features(model, cohort)
    assert use["constant_features"] == ["c"] and use["total"] == 2 and use["ratio"] == 1.0
    assert evaluate.contributing_features(model)["total"] == 3


def test_vote_predict_and_reload(cohort, tmp_path):
    vote = build.soft_voting(cohort, FEATURES, "label", {a: SMALL for a in build.PRESETS})
    members = [{r["id"]: r["p"] for r in build.scored(m, cohort).collect()} for m in vote.members]
    voted = {r["id"]: r["p"] for r in build.scored(vote, cohort).collect()}
    assert all(voted[i] == pytest.approx(sum(m[i] for m in members) / 3) for i in voted)
    loaded = writers.load_model(writers.save_model(vote.members[0], str(tmp_path / "m")))
    # Columns in another order, with extras, no label.
    other = cohort.select("c", "b", F.lit("x").alias("extra"), "a", "id")
    labelled = build.predict_labels(loaded, other).collect()
    assert all((r["IR"] == 1) == (members[0][r["id"]] > 0.5) for r in labelled)
    assert build.model_features(loaded) == FEATURES


def test_weights_and_parameter_mapping(cohort):
    weighted = build.with_class_weight(cohort, "label", "CatBoost").groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert weighted[0]["w"] == pytest.approx(weighted[1]["w"]) == pytest.approx(200)
    with pytest.raises(ValueError):
        build.with_class_weight(cohort, "label", "other")
    mapped = build.booster_settings("CatBoost", {"n_estimators": 9.7, "learning_rate": 0.1, "max_depth": 4.9, "min_child_weight": 2.1, "colsample_bylevel": 0.5, "reg_lambda": 3})
    assert (mapped.trees, mapped.rate, mapped.depth, mapped.min_child_weight, mapped.colsample_bylevel, mapped.reg_lambda) == (9, 0.1, 4, 2.1, 0.5, 3)
    assert mapped.growth == "symmetric" and mapped.ordered and build.booster_settings("lightGBM").leaves == 31
    for wrong in (lambda: build.booster_settings("other"), lambda: build.booster_settings("XGBoost", {"depth": 3})):
        with pytest.raises(ValueError):
            wrong()


def test_regression_by_least_squares(spark):
    draw = random.Random(7)
    rows = [(i, *(x := (draw.random(), draw.random())), math.exp(1 + 2 * x[0] - x[1] + draw.gauss(0, 0.1))) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double")
    linear = {"LinearRegression": build.build_regressors()["LinearRegression"]}
    got = evaluate.evaluate_feature_sets(df, "id", "y", {"s": ["a", "b"]}, linear, folds=4).first()
    from cohortspark.operators.splits import assign_folds

    fold = {r["id"]: r["fold"] for r in assign_folds(df.select("id"), "id", 4).collect()}
    scores = []
    for k in range(4):
        train, test = ([r for r in rows if (fold[r[0]] == k) == held] for held in (False, True))
        design = lambda part: np.array([[1, r[1], r[2]] for r in part])
        beta, *_ = np.linalg.lstsq(design(train), np.log([r[3] for r in train]), rcond=None)
        y = np.log([r[3] for r in test])
        e = y - design(test) @ beta
        scores.append((1 - (e**2).sum() / ((y - y.mean()) ** 2).sum(), np.abs(e).mean(), math.sqrt((e**2).mean())))
    assert (got["r2"], got["mae"], got["rmse"]) == pytest.approx(tuple(np.mean(scores, axis=0)), rel=1e-6)


def test_search_is_reproducible(cohort):
    assert search.candidates("XGBoost", 3) == search.candidates("XGBoost", 3)
    assert set(search.candidates("CatBoost", 1)[0]) == set(build.SEARCH_SPACE["CatBoost"])
    best, table = search.search_parameters(cohort, FEATURES, "id", "label", "CatBoost", n_random=2, n_guided=1, folds=2, max_trees=3)
    assert table.count() == 3 and 1 <= best["n_estimators"] <= 3


def test_posterior_in_closed_form():
    known, values = np.array([[0.1, 0.2], [0.7, 0.4], [0.5, 0.9]]), np.array([1.0, -0.5, 0.3])
    at = np.array([[0.3, 0.3], [0.7, 0.4], [0.0, 1.0]])
    mean, variance = search.posterior(known, values, at, 0.5)

    def cov(a, b):
        r = math.sqrt(5) * math.dist(a, b) / 0.5
        return (1 + r + r * r / 3) * math.exp(-r)

    k = np.array([[cov(a, b) for b in known] for a in known]) + search.JITTER * np.eye(3)
    for i, p in enumerate(at):
        across = np.array([cov(p, a) for a in known])
        assert mean[i] == pytest.approx(across @ np.linalg.inv(k) @ values, abs=1e-9)
        assert variance[i] == pytest.approx(1 + search.JITTER - across @ np.linalg.inv(k) @ across, abs=1e-9)
    density = -0.5 * values @ np.linalg.inv(k) @ values - 0.5 * math.log(np.linalg.det(k)) - 1.5 * math.log(2 * math.pi)
    assert search.likelihood(known, values, 0.5) == pytest.approx(density)
    # At a known point the surrogate is sure.
    assert mean[1] == pytest.approx(-0.5, abs=1e-4) and variance[1] < 1e-4


def test_the_surrogate_finds_a_peak_that_draws_miss():
    names = list(build.SEARCH_SPACE["CatBoost"])
    goal = np.array([0.3, 0.8, 0.6, 0.45])

    def evaluate(points):
        units = [search._unit("CatBoost", p) for p in points]
        return [-float(((np.array(u) - goal)[1:] ** 2).sum()) for u in units]  # depth is whole

    got = search.guided_search(evaluate, "CatBoost", 6, 12, seed=3)
    assert len(got) == 18 and len(names) == 4 and got == search.guided_search(evaluate, "CatBoost", 6, 12, seed=3)
    drawn = max(evaluate(search.candidates("CatBoost", 18, seed=3)))
    assert max(v for _, v in got) > drawn  # as many draws without the surrogate
    assert search.next_point([[0.1] * 4, [0.9] * 4], [0.0, 0.0], 1) == search.next_point([[0.1] * 4, [0.9] * 4], [0.0, 0.0], 1)


def test_transfer_scores_every_model_both_ways(cohort):
    cohorts = {"even": cohort.where("id % 2 = 0"), "odd": cohort.where("id % 2 = 1")}
    got = evaluate.cross_cohort_transfer(cohorts, FEATURES, "id", "label", {c: {a: SMALL for a in build.PRESETS} for c in cohorts}).collect()
    assert len(got) == 2 * 2 * 4
    cross = [r for r in got if r["evaluation"] == "cross-cohort"]
    assert {(r["trained_on"], r["evaluated_on"], r["n_samples"]) for r in cross} == {("even", "odd (all)", 200), ("odd", "even (all)", 200)}
    assert {r["n_samples"] for r in got if r not in cross} == {60}


def test_long_predictions_equal_single_ones(cohort):
    model = build.fit_classifier(cohort, FEATURES, "label", "XGBoost", SMALL)
    other = build.fit_classifier(cohort, ["a"], "label", "CatBoost", SMALL)
    vote = build.VotingModel([model, other])
    long = build.scored_by_all({"m": model, "v": vote}, cohort, "id", "label")
    got = {(r["model"], r["id"]): r["p"] for r in long.collect()}
    for name, m in (("m", model), ("v", vote)):
        assert all(got[name, r["id"]] == pytest.approx(r["p"]) for r in build.scored(m, cohort).collect())
    assert len(got) == 800


def test_normality_distance_agrees_with_spark(spark, cohort):
    from pyspark.ml.stat import KolmogorovSmirnovTest

    from cohortspark.operators.hypothesis import two_group_tests

    moments = cohort.agg(F.avg("a"), F.stddev_pop("a")).first()
    built_in = KolmogorovSmirnovTest.test(cohort, "a", "norm", *moments).first()["statistic"]
    ours = two_group_tests(cohort, [], "a", F.lit(True), tests=("ks1",)).first()
    assert ours["ks_d_pos"] == pytest.approx(built_in, abs=1e-9) and ours["ks_d_neg"] is None


def test_rows_without_a_label_have_no_weight(spark):
    rows = spark.createDataFrame([(True,), (False,), (False,), (None,), (None,), (None,)], "label boolean")
    weighted = build.with_class_weight(rows, "label", "CatBoost").groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert {r["label"]: r["w"] for r in weighted} == {True: 1.5, False: 1.5}


def test_a_search_computes_its_table_once_and_packs_every_fold_once(spark, cohort, monkeypatch):
    from cohortspark.models import boosting

    seen, packed, prepare = spark.sparkContext.accumulator(0), [], boosting.prepare
    rows = cohort.select("id", "label", *FEATURES)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(boosting, "prepare", lambda *a, **k: packed.append(1) or prepare(*a, **k))
    table = rows.mapInArrow(counted, rows.schema)
    scores = search.search_parameters(table, FEATURES, "id", "label", "CatBoost", n_random=2, n_guided=1, folds=2, max_trees=2)[1]
    assert scores.count() == 3 and seen.value == rows.count() and len(packed) == 2
