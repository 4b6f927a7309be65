"""Classifiers and regressors.

The three boosted presets keep the names analysts know and grow trees by that library's rule with its own
penalties (``boosting``): level by level, best leaf first, or symmetric with ordered
gradients.  Sampling draws and quantile sketches differ, so metrics agree in kind, not digit by digit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.models import boosting
from cohortspark.models.boosting import Booster, Settings
from cohortspark.operators.splits import SEED, stratified_split
from cohortspark.session import materialise

# Default settings of each preset.  CatBoost grows 1,000 trees by default where it is
# native; as every level of a tree is a pass over the rows, 200 is the default here, and ``n_estimators`` is a parameter.
PRESETS = {
    "XGBoost": Settings(trees=100, rate=0.3, depth=6, growth="depth", reg_lambda=1.0),
    "lightGBM": Settings(trees=100, rate=0.1, depth=None, leaves=31, growth="leaf", reg_lambda=0.0, min_child_weight=1e-3, min_child_rows=20),
    "CatBoost": Settings(trees=200, rate=0.06, depth=6, growth="symmetric", reg_lambda=3.0, min_child_weight=0.0, ordered=True),
}
# Names of parameters and of the settings they set.
PARAMETERS = {
    "n_estimators": "trees", "learning_rate": "rate", "max_depth": "depth", "num_leaves": "leaves", "min_child_samples": "min_child_rows",
    "reg_lambda": "reg_lambda", "reg_alpha": "reg_alpha", "gamma": "gamma", "min_child_weight": "min_child_weight", "subsample": "subsample",
    "colsample_bytree": "colsample_bytree", "colsample_bylevel": "colsample_bylevel",
}
THRESHOLD = 0.5
FOREST_DEPTH = 12
SEARCH_SPACE = {
    "XGBoost": {
        "max_depth": (3, 12), "learning_rate": (0.01, 0.2), "colsample_bytree": (0.5, 1), "min_child_weight": (1, 20),
        "subsample": (0.5, 1), "colsample_bylevel": (0.5, 1), "gamma": (0, 5), "reg_lambda": (0.001, 10), "reg_alpha": (0.001, 10),
    },
    "lightGBM": {
        "max_depth": (3, 12), "learning_rate": (0.01, 0.2), "colsample_bytree": (0.5, 1), "min_child_weight": (1, 20),
        "subsample": (0.5, 1), "reg_lambda": (0.001, 10), "reg_alpha": (0.001, 10),
    },
    "CatBoost": {"max_depth": (3, 12), "learning_rate": (0.01, 0.2), "colsample_bylevel": (0.5, 1), "reg_lambda": (0.001, 10)},
}
"""Ranges searched per preset; fixed values."""


def booster_settings(algorithm: str, params: dict | None = None, **changes) -> Settings:
    """A preset with some parameters set; whole numbers stay whole, an unknown name raises."""
    if algorithm not in PRESETS:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    chosen = {}
    for name, value in (params or {}).items():
        if name not in PARAMETERS:
            raise ValueError(f"unknown parameter {name!r}")
        whole = PARAMETERS[name] in ("trees", "depth", "leaves", "min_child_rows") and value is not None
        chosen[PARAMETERS[name]] = int(value) if whole else value
    return boosting.replace(PRESETS[algorithm], **(chosen | changes))


def with_class_weight(df: DataFrame, label: str, algorithm: str, weight: str = "weight") -> DataFrame:
    """Weight rows by class: neg/pos on positives, or balanced on both classes; rows without a label are dropped."""
    df = df.where(F.col(label).isNotNull())
    positives = F.col(label).cast("boolean")
    negative, positive = df.agg(F.count_if(~positives), F.count_if(positives)).first()
    if not negative or not positive:
        raise ValueError("both classes are needed to weight them")
    if algorithm == "CatBoost":
        total = negative + positive
        weights = total / (2 * negative), total / (2 * positive)
    elif algorithm in PRESETS:
        weights = 1.0, negative / positive
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    return df.withColumn(weight, F.when(F.col(label).cast("boolean"), F.lit(weights[1])).otherwise(F.lit(weights[0])))


def fit_classifier(
    train: DataFrame, features: list[str], label: str, algorithm: str, params: dict | None = None, cuts: dict[str, list[float]] | None = None, **options,
) -> Booster:
    """Weight the classes of the training rows and fit; ``options`` change settings by their own names.

    Features are cut at quantiles, or at the borders that ``cuts`` has by name; one that is not named there is not cut.
    """
    rows = train.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*features, label])])
    rows = with_class_weight(rows, label, algorithm, "_weight")
    return boosting.fit(rows, features, label, booster_settings(algorithm, params, **options), weight="_weight", cuts=cuts and [cuts.get(f, []) for f in features])


def model_features(model: Booster | PipelineModel) -> list[str]:
    """Input columns of a fitted model in its own order."""
    return model.features if isinstance(model, Booster) else model.stages[0].getInputCols()


@dataclass
class VotingModel:
    """Mean of the member probabilities; members are applied to the same row, not joined."""

    members: list[Booster | PipelineModel]

    def scored(self, df: DataFrame, p: str = "p") -> DataFrame:
        names = [f"_p_{i}" for i in range(len(self.members))]
        for name, member in zip(names, self.members):
            df = scored(member, df, name)
        mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
        return df.withColumn(p, mean).drop(*names)


def scored(model, df: DataFrame, p: str = "p") -> DataFrame:
    """All columns of ``df`` plus the probability of the positive class."""
    if isinstance(model, VotingModel):
        return model.scored(df, p)
    if isinstance(model, Booster):
        return model.transform(df, p)
    made = ["features", "rawPrediction", "probability", "prediction"]
    return model.transform(df).withColumn(p, vector_to_array("probability")[1]).drop(*made)


def scored_by_all(models: dict, df: DataFrame, key: str, label: str) -> DataFrame:
    """Predictions of several models in long form: ``model``, key, ``y``, ``p``.

    The rows are read once.  A vote takes the probabilities of its members from the
    models that are scored anyway.
    """
    columns: dict[int, str] = {}
    for model in models.values():
        for member in model.members if isinstance(model, VotingModel) else [model]:
            if id(member) not in columns:
                columns[id(member)] = f"_p_{len(columns)}"
                df = scored(member, df, columns[id(member)])
    cells = []
    for name, model in models.items():
        members = model.members if isinstance(model, VotingModel) else [model]
        parts = [F.col(columns[id(m)]) for m in members]
        cells.append(F.struct(F.lit(name).alias("model"), (sum(parts[1:], parts[0]) / len(parts)).alias("p")))
    long = df.select(key, F.col(label).cast("int").alias("y"), F.explode(F.array(*cells)).alias("s"))
    return long.select("s.model", key, "y", "s.p")


def predict_labels(model, df: DataFrame, threshold: float = THRESHOLD, label: str = "IR") -> DataFrame:
    """Label an unlabelled cohort: 0/1 integer, 1 when p is strictly above the threshold."""
    return scored(model, df).withColumn(label, (F.col("p") > threshold).cast("int"))


@dataclass
class Run:
    """A fitted model with its split and the scored test rows."""

    model: Booster | PipelineModel | VotingModel
    train: DataFrame
    test: DataFrame
    features: list[str] = field(default_factory=list)

    def predictions(self, key: str, label: str) -> DataFrame:
        return self.test.select(key, F.col(label).cast("int").alias("y"), "p")


def split_once(df: DataFrame, key: str, label: str, test_share: float = 0.3, seed: int = SEED) -> DataFrame:
    """Rows with ``is_test``, computed once: every fit and every score reads them again."""
    return materialise(stratified_split(df, key, label, test_share, seed))


def run_on_split(split: DataFrame, features: list[str], label: str, algorithm: str, params: dict | None = None, **options) -> Run:
    """Fit on the training rows of a split and score its test rows."""
    train, test = split.where(~F.col("is_test")).drop("is_test"), split.where("is_test").drop("is_test")
    model = fit_classifier(train, features, label, algorithm, params, **options)
    return Run(model, train, scored(model, test), features)


def train_classifier(
    df: DataFrame, features: list[str], key: str, label: str, algorithm: str = "XGBoost", params: dict | None = None,
    test_share: float = 0.3, seed: int = SEED, **options,
) -> Run:
    """Split, fit and score one classifier on one feature set."""
    return run_on_split(split_once(df, key, label, test_share, seed), features, label, algorithm, params, **options)


def soft_voting(df: DataFrame, features: list[str], label: str, params: dict[str, dict], **options) -> VotingModel:
    """Fit every preset on the same rows and average their probabilities."""
    return VotingModel([fit_classifier(df, features, label, a, p, **options) for a, p in params.items()])


def average_predictions(frames: list[DataFrame], key: str, label: str, p: str = "p") -> DataFrame:
    """Soft vote of predictions that exist as separate tables: mean p per key."""
    union = frames[0].select(key, label, p)
    for frame in frames[1:]:
        union = union.unionByName(frame.select(key, label, p))
    return union.groupBy(key).agg(F.first(label).alias(label), F.avg(p).alias(p), F.count(p).alias("n_members"))


def build_regressors(seed: int = SEED, sizes: dict | None = None) -> dict[str, tuple]:
    """Model name to (feature stages, regressor or booster settings), all with default settings.

    ``sizes`` overrides parameters by model name, for instance fewer trees.  The forest's trees
    grow to ``FOREST_DEPTH``, which its ``maxDepth`` raises up to the 30 levels that Spark's trees can have.
    """
    sizes = sizes or {}

    def boosted(name: str, preset: str) -> tuple:
        return (), boosting.replace(booster_settings(preset, sizes.get(name)), loss="squared", seed=seed)

    forest = {"numTrees": 100, "featureSubsetStrategy": "all", "maxDepth": FOREST_DEPTH} | sizes.get("RandomForest", {})
    return {
        "LinearRegression": ((), LinearRegression(regParam=0.0, standardization=False)),
        "Polynomial_Regression": (
            (PolynomialExpansion(degree=2, inputCol="features", outputCol="expanded"),),
            LinearRegression(featuresCol="expanded", regParam=0.0),
        ),
        "RandomForest": ((), RandomForestRegressor(seed=seed, **forest)),
        "XGBoost": boosted("XGBoost", "XGBoost"),
        "LightGBM": boosted("LightGBM", "lightGBM"),
        "CatBoost": boosted("CatBoost", "CatBoost"),
    }
