"""Metrics, splits, models, attribution, search."""

from __future__ import annotations

import json

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from cohortspark.models import build, evaluate, explain, search
from cohortspark.operators import metrics, quantiles, splits
from cohortspark.operators.metrics import METRICS
from cohortspark.plans.booster_queries import CUTS, scores_sql
from cohortspark.plans.registry import query
from cohortspark.plans.stand_ins import complete_subject, predictions, sql_hash, subject, with_tables
from cohortspark.session import scratch_path
from cohortspark.sources import writers

FEATURES = ["qty", "price", "disc", "tax"]
SMALL = {"n_estimators": 5, "max_depth": 3}
SMALL_PRESETS = {name: SMALL for name in build.PRESETS}


def _metrics_sql(source: str, key: str, weight: str = "1") -> str:
    """Metrics of columns y, p per ``key``; rows count ``weight`` times."""
    return f"""s AS (SELECT {key} AS k, p, sum({weight}) FILTER (y = 1) AS a0, sum({weight}) FILTER (y = 0) AS b0 FROM {source} GROUP BY ALL),
    s1 AS (SELECT k, p, coalesce(a0, 0)::DOUBLE AS a, coalesce(b0, 0)::DOUBLE AS b FROM s),
    c AS (SELECT *, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(a) OVER (PARTITION BY k) AS ta, sum(b) OVER (PARTITION BY k) AS tb
          FROM s1 WINDOW w AS (PARTITION BY k ORDER BY p DESC)),
    e AS (SELECT *, tp / (tp + fp) AS pr, CASE WHEN tp - a + fp - b = 0 THEN 1.0 ELSE (tp - a) / (tp - a + fp - b) END AS pr0 FROM c),
    m AS (SELECT k, sum(a) FILTER (p > 0.5) AS TP, sum(b) FILTER (p <= 0.5) AS TN, sum(b) FILTER (p > 0.5) AS FP, sum(a) FILTER (p <= 0.5) AS FN,
          sum(a * (tb - fp + b / 2)) / (max(ta) * max(tb)) AS roc_auc, sum(a * (pr + pr0) / 2) / max(ta) AS pr_auc FROM e GROUP BY k),
    f AS (SELECT k, TP::BIGINT AS TP, TN::BIGINT AS TN, FP::BIGINT AS FP, FN::BIGINT AS FN, roc_auc, (TP + TN) / (TP + TN + FP + FN) AS accuracy,
          TP / (TP + FN) AS sensitivity, TN / (TN + FP) AS specificity, TP / (TP + FP) AS ppv, TN / (TN + FN) AS npv,
          2 * TP / (2 * TP + FP + FN) AS f1, TP / (TP + FN) + TN / (TN + FP) - 1 AS youden, pr_auc FROM m)"""


_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)


@query(with_tables("predictions", f"WITH {_metrics_sql('predictions', 'cohort')} SELECT k AS cohort, TP, TN, FP, FN, {_ROUNDED} FROM f"))
def confusion_metrics(spark, sf_dir):
    return metrics.classification_metrics(predictions(spark, sf_dir), "y", "p", ["cohort"], digits=6)


@query(with_tables("predictions", f"WITH {_metrics_sql('predictions', '0')} SELECT TP, TN, FP, FN, {_ROUNDED} FROM f"))
def overall_metrics(spark, sf_dir):
    return metrics.classification_metrics(predictions(spark, sf_dir), "y", "p", digits=6)


@query(with_tables("predictions", f"""WITH {_metrics_sql('predictions', '0')} SELECT p AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp,
    round(fp / tb, 6) AS fpr, round(tp / ta, 6) AS tpr, round(pr, 6) AS "precision" FROM e"""))
def roc_curve(spark, sf_dir):
    points = metrics.roc_curve(predictions(spark, sf_dir), "y", "p")
    return points.select("threshold", "tp", "fp", *[F.round(c, 6).alias(c) for c in ("fpr", "tpr", "precision")])


@query(with_tables("predictions", f"""WITH {_metrics_sql('predictions', 'cohort')} SELECT k AS cohort, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM f"""))
def pr_auc(spark, sf_dir):
    table_ = metrics.classification_metrics(predictions(spark, sf_dir), "y", "p", ["cohort"], digits=6)
    return table_.select("cohort", "roc_auc", "pr_auc")


RESAMPLES = 1000


@query(with_tables("predictions", f"""WITH {_metrics_sql('predictions', 'cohort')},
    l AS (UNPIVOT (SELECT k, {', '.join(METRICS)} FROM f) ON {', '.join(METRICS)} INTO NAME metric VALUE value)
    SELECT k AS cohort, metric, round(value, 6) AS estimate, TRUE AS inside, TRUE AS near_normal, {RESAMPLES} AS n_resamples FROM l"""))
def bootstrap_ci(spark, sf_dir):
    """Intervals per cohort: each holds its estimate, and those of plain shares are as wide as the normal approximation says."""
    rows = predictions(spark, sf_dir)
    # A tenth of the rows again without a label, which must not count.
    unlabelled = rows.where("id % 10 = 0").withColumn("y", F.lit(None).cast("int"))
    intervals = metrics.bootstrap_metrics(rows.unionByName(unlabelled), "y", "p", RESAMPLES, digits=None, keys=["cohort"])
    over = F.col("p") > 0.5
    sizes = rows.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("accuracy"), F.sum("y").alias("sensitivity"), F.sum(1 - F.col("y")).alias("specificity"), F.count_if(over).alias("ppv"), F.count_if(~over).alias("npv"),
    ).unpivot(["cohort"], ["accuracy", "sensitivity", "specificity", "ppv", "npv"], "metric", "n")
    e, width = F.col("estimate"), F.col("ci_upper") - F.col("ci_lower")
    normal = 2 * 1.959964 * F.sqrt(e * (1 - e) / F.col("n"))
    near = F.coalesce(F.abs(width - normal) <= 0.25 * normal + 2 / F.col("n"), F.lit(True))
    return intervals.join(sizes, ["cohort", "metric"], "left").select(
        "cohort", "metric", F.round("estimate", 6).alias("estimate"), e.between(F.col("ci_lower"), F.col("ci_upper")).alias("inside"), near.alias("near_normal"), "n_resamples",
    )


_BINS_SQL = """WITH e AS (SELECT {key} AS k, quantile_cont(p, [{levels}]) AS edges FROM predictions GROUP BY ALL),
    b AS (SELECT {key} AS k, y, p, 1 + len(list_filter(edges, lambda x: x <= p)) AS bin FROM predictions JOIN e ON e.k = {key})
    SELECT {out} bin::INT AS bin, round(sum(p), 3) AS sum_predicted, round(avg(y), 6) AS observed, count(*) AS n FROM b GROUP BY k, bin"""
_LEVELS = ", ".join(str(i / 10) for i in range(1, 10))


def _sum_predicted():
    """Mean times size: the predictions have three decimals, so their sum has no rounding ties."""
    return F.round(F.col("mean_predicted") * F.col("n"), 3).alias("sum_predicted")


@query(with_tables("predictions", _BINS_SQL.format(key="0", out="", levels=_LEVELS)))
def calibration_bins(spark, sf_dir):
    bins = metrics.calibration_table(predictions(spark, sf_dir), "y", "p")
    return bins.select("bin", _sum_predicted(), F.round("observed", 6).alias("observed"), "n")


@query(with_tables("predictions", _BINS_SQL.format(key="cohort", out="k AS cohort,", levels=_LEVELS)))
def calibration_bins_by_cohort(spark, sf_dir):
    bins = metrics.calibration_table(predictions(spark, sf_dir), "y", "p", keys=["cohort"])
    return bins.select("cohort", "bin", _sum_predicted(), F.round("observed", 6).alias("observed"), "n")


@query(with_tables("predictions", "SELECT cohort, round(avg((p - y) * (p - y)), 6) AS brier_score FROM predictions GROUP BY cohort"))
def brier(spark, sf_dir):
    return metrics.brier_score(predictions(spark, sf_dir), "y", "p", ["cohort"]).withColumn("brier_score", F.round("brier_score", 6))


@query(with_tables("predictions", """SELECT round(avg((p - y) * (p - y)), 6) AS brier_score, 0.0::DOUBLE AS score_intercept, 0.0::DOUBLE AS score_slope FROM predictions"""))
def calibration_fit(spark, sf_dir):
    """The fit by its score equations: residuals sum to zero, alone and times the logit."""
    rows = predictions(spark, sf_dir)
    fit = metrics.calibration_summary(rows, "y", "p", digits=None).first()
    clipped = F.least(F.greatest(F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    logit = F.log(clipped / (1 - clipped))
    rest = F.col("y") - 1 / (1 + F.exp(-(F.lit(fit["calibration_intercept"]) + F.lit(fit["calibration_slope"]) * logit)))
    near_zero = lambda c: (F.round(F.abs(c), 3) + 0.0)
    return rows.agg(F.lit(round(fit["brier_score"], 6)).alias("brier_score"), near_zero(F.avg(rest)).alias("score_intercept"), near_zero(F.avg(rest * logit)).alias("score_slope"))


@query(with_tables("predictions", """SELECT cohort, CASE WHEN p < 0 THEN 0 WHEN p > 1 THEN 51 ELSE least(floor(p / 0.02)::INT + 1, 50) END AS bin, count(*) AS n
    FROM predictions GROUP BY ALL"""))
def prediction_histogram(spark, sf_dir):
    return quantiles.histogram(predictions(spark, sf_dir), ["cohort"], "p", 0.0, 1.0, 50).select("cohort", "bin", "n")


@query(with_tables("subject", """WITH a AS (SELECT total AS v, row_number() OVER (ORDER BY total) - 1 AS i, count(*) OVER () AS n FROM subject WHERE sex = 'F'),
    b AS (SELECT total AS v, row_number() OVER (ORDER BY total) - 1 AS i, count(*) OVER () AS n FROM subject WHERE sex <> 'F'),
    k AS (SELECT least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS k),
    g AS (SELECT level, level * ((SELECT count(*) FROM a) - 1) / (k - 1)::DOUBLE AS ha, level * ((SELECT count(*) FROM b) - 1) / (k - 1)::DOUBLE AS hb
          FROM k, LATERAL (SELECT unnest(range(k)) AS level))
    SELECT level, round(a0.v + (a1.v - a0.v) * (ha - floor(ha)), 5) AS x, round(b0.v + (b1.v - b0.v) * (hb - floor(hb)), 5) AS y
    FROM g JOIN a a0 ON a0.i = floor(ha) JOIN a a1 ON a1.i = ceil(ha) JOIN b b0 ON b0.i = floor(hb) JOIN b b1 ON b1.i = ceil(hb)"""))
def qq_quantiles(spark, sf_dir):
    pairs = quantiles.quantile_pairs(subject(spark, sf_dir), "total", F.col("sex") == "F")
    return pairs.select("level", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


_SPLIT_SQL = f"""WITH c AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM complete_subject GROUP BY label),
    x AS (SELECT *, ceil(0.3 * total) * n / total AS e FROM c),
    q AS (SELECT label, floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, label) <= ceil(0.3 * max(total) OVER ()) - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS quota FROM x),
    r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {sql_hash('id')}, id) AS rn FROM complete_subject)"""


@query(with_tables("complete_subject", _SPLIT_SQL + " SELECT id, label, rn <= quota AS is_test FROM r JOIN q USING (label)"))
def stratified_split(spark, sf_dir):
    return splits.stratified_split(complete_subject(spark, sf_dir).select("id", "label"), "id", "label")


@query(with_tables("complete_subject", f"SELECT id, (ntile(5) OVER (ORDER BY {sql_hash('id')}, id) - 1)::INT AS fold FROM complete_subject"))
def kfold(spark, sf_dir):
    return splits.assign_folds(complete_subject(spark, sf_dir).select("id"), "id")


@query(with_tables("complete_subject", f"SELECT id, label, (ntile(5) OVER (PARTITION BY label ORDER BY {sql_hash('id')}, id) - 1)::INT AS fold FROM complete_subject"))
def stratified_kfold(spark, sf_dir):
    return splits.assign_folds(complete_subject(spark, sf_dir).select("id", "label"), "id", by="label")


@query(with_tables("predictions", "SELECT id, y, round((p + p * p + sqrt(p)) / 3, 6) AS p, 3::BIGINT AS n_members FROM predictions"))
def soft_vote(spark, sf_dir):
    first = predictions(spark, sf_dir).select("id", "y", "p")
    others = [first.withColumn("p", F.col("p") * F.col("p")), first.withColumn("p", F.sqrt("p"))]
    return build.average_predictions([first, *others], "id", "y").withColumn("p", F.round("p", 6))


_CV_SQL = f"""WITH f AS (SELECT id, ln(idx) AS y, price AS x1, total AS x2, ntile(5) OVER (ORDER BY {sql_hash('id')}, id) - 1 AS fold FROM complete_subject),
    k AS (SELECT unnest(range(5)) AS held),
    s AS (SELECT held, regr_slope(y, x1) AS b1, regr_intercept(y, x1) AS a1, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS v1, var_pop(x2) AS v2,
          covar_pop(x1, x2) AS v12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM f, k WHERE fold <> held GROUP BY held),
    c AS (SELECT *, (v2 * c1 - v12 * c2) / (v1 * v2 - v12 * v12) AS p1, (v1 * c2 - v12 * c1) / (v1 * v2 - v12 * v12) AS p2 FROM s),
    e AS (SELECT held, y, a1 + b1 * x1 AS f1, my + p1 * (x1 - m1) + p2 * (x2 - m2) AS f2 FROM f JOIN c ON fold = held),
    m AS (SELECT held, 1 - sum((y - f1) ** 2) / (var_pop(y) * count(*)) AS r1, avg(abs(y - f1)) AS a1, sqrt(avg((y - f1) ** 2)) AS s1,
          1 - sum((y - f2) ** 2) / (var_pop(y) * count(*)) AS r2, avg(abs(y - f2)) AS a2, sqrt(avg((y - f2) ** 2)) AS s2 FROM e GROUP BY held)
    SELECT 'LinearRegression' AS model, 'one' AS feature_set, 1 AS n_features, round(avg(r1), 5) AS r2, round(avg(a1), 5) AS mae, round(avg(s1), 5) AS rmse FROM m
    UNION ALL SELECT 'LinearRegression', 'two', 2, round(avg(r2), 5), round(avg(a2), 5), round(avg(s2), 5) FROM m"""


@query(with_tables("complete_subject", _CV_SQL))
def linear_regression_cv(spark, sf_dir):
    linear = {"LinearRegression": build.build_regressors()["LinearRegression"]}
    sets = {"one": ["price"], "two": ["price", "total"]}
    scores = evaluate.evaluate_feature_sets(complete_subject(spark, sf_dir), "id", "idx", sets, linear)
    return scores.select("model", "feature_set", "n_features", *[F.round(c, 5).alias(c) for c in ("r2", "mae", "rmse")])


@query()
def regression_models(spark, sf_dir):
    """All six regressors; ``SMALL`` boosters, a small forest, two folds."""
    small = {n: SMALL for n in ("XGBoost", "LightGBM", "CatBoost")} | {"RandomForest": {"numTrees": 5, "maxDepth": 4}}
    models = build.build_regressors(sizes=small)
    return evaluate.evaluate_feature_sets(complete_subject(spark, sf_dir), "id", "idx", {"four": FEATURES}, models, folds=2)


@query(with_tables("complete_subject", """WITH s AS (SELECT avg(price) AS m1, avg(total) AS m2, var_pop(price) AS v1, var_pop(total) AS v2, covar_pop(price, total) AS v12,
    covar_pop(price, ln(idx)) AS c1, covar_pop(total, ln(idx)) AS c2 FROM complete_subject),
    c AS (SELECT m1, m2, (v2 * c1 - v12 * c2) / (v1 * v2 - v12 * v12) AS p1, (v1 * c2 - v12 * c1) / (v1 * v2 - v12 * v12) AS p2 FROM s)
    SELECT 'price' AS feature, round(avg(abs(p1 * (price - m1))), 5) AS mean_abs FROM complete_subject, c
    UNION ALL SELECT 'total', round(avg(abs(p2 * (total - m2))), 5) FROM complete_subject, c"""))
def attribution_rank(spark, sf_dir):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    rows = complete_subject(spark, sf_dir).select("id", F.log("idx").alias("label"), "price", "total")
    names = ["price", "total"]
    stages = [VectorAssembler(inputCols=names, outputCol="features"), LinearRegression(regParam=0.0, standardization=False)]
    model = Pipeline(stages=stages).fit(rows)
    ranked = explain.rank_features(explain.linear_attributions(model, rows, rows), names)
    return ranked.select("feature", F.round("mean_abs", 5).alias("mean_abs"))


@query("SELECT count(*) AS n_rows, 0::BIGINT AS n_off FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def tree_attribution(spark, sf_dir):
    """Rows whose attributions and expected margin do not add up to the margin."""
    rows = complete_subject(spark, sf_dir).select("id", "label", *FEATURES)
    model = build.fit_classifier(rows, FEATURES, "label", "XGBoost", SMALL)
    explained, expected = explain.tree_attributions(model, explain.margin(model, rows))
    total = F.aggregate("attribution", F.lit(expected), lambda a, v: a + v)
    off = F.abs(total - F.col("margin")) > 1e-9
    return explained.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(off).alias("n_off"))


@query()
def tree_attribution_rank(spark, sf_dir):
    """Every feature by falling mean attribution; what the values are is tested on small models."""
    rows = complete_subject(spark, sf_dir).select("id", "label", *FEATURES)
    model = build.fit_classifier(rows, FEATURES, "label", "XGBoost", SMALL)
    return explain.rank_features(explain.tree_attributions(model, rows)[0], FEATURES)


@query()
def top_features(spark, sf_dir):
    """Rank by attribution, refit on the top two of four, score the test rows."""
    rows = complete_subject(spark, sf_dir).select("id", "label", *FEATURES)
    run = build.train_classifier(rows, FEATURES, "id", "label", "CatBoost", SMALL)
    chosen, _, scored = explain.top_features_retrain(run.model, run.train, run.test.drop("p"), "label", "CatBoost", SMALL, top=2)
    table_ = metrics.classification_metrics(scored.withColumn("y", F.col("label").cast("int")), "y", "p")
    return table_.withColumn("chosen", F.lit(",".join(chosen)))


_ABLATION = {"one": FEATURES[:1], "two": FEATURES[:2], "four": FEATURES, "all": FEATURES}


def _test_metrics_sql(features: list[str]) -> str:
    """Metrics of the test rows of the split, of trees on some features, and how many of these split."""
    inner = _metrics_sql("(SELECT y::INT AS y, p FROM scores WHERE NOT tr)", "0")
    select = f"SELECT f.*, (SELECT count(*) FROM used WHERE gain > 0) AS n_used FROM (WITH {inner} SELECT * FROM f) f"
    return scores_sql(build.booster_settings("XGBoost", SMALL), "id NOT IN (SELECT id FROM r JOIN q USING (label) WHERE rn <= quota)", select, features)


@query(with_tables("complete_subject", _SPLIT_SQL + "".join(f", of_{name} AS ({_test_metrics_sql(features)})" for name, features in _ABLATION.items()) + " UNION ALL ".join(
    f""" SELECT '{name}' AS feature_set, {len(features) + (name == "all")} AS n_features, TP, TN, FP, FN, {", ".join(f"round({m}, 3) AS {m}" for m in METRICS)},
    round(n_used / {len(features)}, 3) AS cfr, n_used::INT AS contributing_features, {len(features)} AS features_considered FROM of_{name}""" for name, features in _ABLATION.items())))
def feature_ablation(spark, sf_dir):
    """Four nested feature sets, the last with a column that never varies."""
    rows = complete_subject(spark, sf_dir).withColumn("constant", F.lit(1)).select("id", "label", "constant", *FEATURES)
    sets = _ABLATION | {"all": [*FEATURES, "constant"]}
    return evaluate.feature_ablation(rows, "id", "label", sets, "XGBoost", SMALL, cuts=CUTS)


@query()
def cross_cohort_transfer(spark, sf_dir):
    """Three presets and their vote of three cohorts, within and across, all metrics."""
    rows = complete_subject(spark, sf_dir).select("id", "sex", "label", *FEATURES)
    cohorts = {name: rows.where(F.col("sex") == name) for name in ("F", "O", "P")}
    return evaluate.cross_cohort_transfer(cohorts, FEATURES, "id", "label", {c: SMALL_PRESETS for c in cohorts})


@query()
def pooled_performance(spark, sf_dir):
    """Three presets and their vote on one split, all metrics."""
    rows = complete_subject(spark, sf_dir).select("id", "label", *FEATURES)
    return evaluate.pooled_performance(rows, FEATURES, "id", "label", SMALL_PRESETS)[0]


@query(with_tables("complete_subject", scores_sql(build.booster_settings("XGBoost", SMALL), "sex <> 'P'",
    "SELECT count(*) AS n, count(*) FILTER (p > 0.5) AS n_positive, round(avg((p > 0.5)::int), 6) AS prevalence, round(avg(p), 6) AS mean_p FROM scores WHERE NOT tr")))
def predict_unlabelled(spark, sf_dir):
    """Train on two cohorts, save and load, label every row of the third; how many there are and how many are positive."""
    rows = complete_subject(spark, sf_dir).select("id", "sex", "label", *FEATURES)
    model = build.fit_classifier(rows.where("sex <> 'P'"), FEATURES, "label", "XGBoost", SMALL, cuts=CUTS)
    loaded = writers.load_model(writers.save_model(model, scratch_path(spark, "model")))
    labelled = build.predict_labels(loaded, rows.where("sex = 'P'").drop("label"))
    return labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("IR").alias("n_positive"), F.round(F.avg("IR"), 6).alias("prevalence"), F.round(F.avg("p"), 6).alias("mean_p"))


@query(with_tables("complete_subject", _SPLIT_SQL + f""", scored AS ({_test_metrics_sql(FEATURES)}),
    sizes AS (SELECT count(*) FILTER (rn > quota) AS n_train, count(*) FILTER (rn <= quota) AS n_test FROM r JOIN q USING (label))
    SELECT 'orders' AS training_data, {len(FEATURES)} AS n_features, n_train, n_test, '{json.dumps(SMALL)}' AS hyperparameters,
    round(roc_auc, 3) AS roc_auc, round(sensitivity, 3) AS sensitivity, round(npv, 3) AS npv FROM scored, sizes"""))
def model_manifest(spark, sf_dir):
    """A model, saved, and its line in the list of models."""
    rows = complete_subject(spark, sf_dir).select("id", "label", *FEATURES)
    run = build.train_classifier(rows, FEATURES, "id", "label", "XGBoost", SMALL, cuts=CUTS)
    path = writers.save_model(run.model, scratch_path(spark, "model"))
    scores = metrics.classification_metrics(run.predictions("id", "label"), "y", "p").first()
    entry = {
        "file": path.rsplit("/", 1)[-1], "training_data": "orders", "n_features": len(FEATURES), "n_train": run.train.count(), "n_test": run.test.count(),
        "params": SMALL, "roc_auc": scores["roc_auc"], "sensitivity": scores["sensitivity"], "npv": scores["npv"],
    }
    return writers.model_manifest(spark, [entry]).drop("file")  # its folder is named anew in every run


@query()
def param_search(spark, sf_dir):
    """Two random candidates and one that the surrogate chose, two folds, at most eight trees with a patience of three."""
    rows = complete_subject(spark, sf_dir).select("id", "label", *FEATURES)
    return search.search_parameters(rows, FEATURES, "id", "label", "CatBoost", n_random=2, n_guided=1, folds=2, max_trees=8, patience=3)[1]
