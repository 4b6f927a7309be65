"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled texts train a small ensemble of numpy classifiers.
The risk is corrected by the class prior p: p R(P, +) + max(0, R(U, -) - p R(P, -)); when
the second part falls below zero, the step goes against it instead of fitting noise.
Rows labelled harmless only serve to estimate the prior.

A text is the set of its features: every distinct word and its first four and five bytes.
Which features a model sees is decided by counts over all training texts.  The texts it is
fitted on are a bounded sample (``MOST_TOXIC`` and ``MOST_UNLABELLED``).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.text import fold
from cohortspark.operators.joins import lookup_join
from cohortspark.session import materialise

MOST_TOXIC, MOST_UNLABELLED = 8_000, 16_000
LEAST_TEXTS, LEAST_Z = 5, 4.0
FOLDS = 5
EDGES = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())
REMEMBERED = 200_000  # words whose features a worker keeps at hand


def word_features(word: bytes) -> tuple[int, ...]:
    """The hashed features of a lower-case word: itself, its first four and five bytes."""
    core = word.strip(EDGES)
    if not core:
        return (zlib.crc32(b"w" + word),)
    return (zlib.crc32(b"w" + core), zlib.crc32(b"4" + core[:4]), zlib.crc32(b"5" + core[:5]))


class Featuriser:
    """The distinct features of a text, all or those listed; remembers a bounded number of words."""

    def __init__(self, listed: dict[int, int] | None = None):
        self.listed = listed
        self.known: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> set[int]:
        found: set[int] = set()
        known, listed = self.known, self.listed
        for word in set((text or "").encode().lower().split()):
            features = known.get(word)
            if features is None:
                features = word_features(word)
                if listed is not None:
                    features = tuple(listed[f] for f in features if f in listed)
                if len(known) >= REMEMBERED:
                    known.clear()
                known[word] = features
            if features:
                found.update(features)
        return found


@dataclass(frozen=True)
class Model:
    """Linear classifiers over the listed features; ``weights`` has a row per classifier, the last column is the bias."""

    listed: dict[int, int]
    weights: np.ndarray
    prior: float


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count texts per feature in a task."""
    features, counts, texts = Featuriser(), Counter(), 0

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["feature", "texts"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(features(text))
            texts += 1
        if len(counts) > 500_000:
            yield rows()
            counts.clear()
    counts[-1] = texts  # the number of texts itself
    yield rows()


def texts_per_feature(texts: DataFrame) -> DataFrame:
    """(feature, texts) over all rows of a one-column table; feature -1 counts the rows."""
    return texts.mapInArrow(_count, "feature bigint, texts bigint").groupBy("feature").agg(F.sum("texts").alias("texts"))


def choose_features(toxic: DataFrame, unlabelled: DataFrame) -> dict[int, int]:
    """Features that toxic texts have far more often than all texts, strongest first.

    All features of ``LEAST_TEXTS`` toxic texts at least are compared with their counts in all training
    texts, and those with a z-value above ``LEAST_Z`` are kept.
    """
    in_toxic, in_all = materialise(texts_per_feature(toxic)), materialise(texts_per_feature(unlabelled))
    n_toxic, n_all = (x.where("feature = -1").agg(F.sum("texts")).first()[0] or 0 for x in (in_toxic, in_all))
    candidates = in_toxic.where((F.col("feature") >= 0) & (F.col("texts") >= LEAST_TEXTS))
    met = candidates.join(in_all.withColumnRenamed("texts", "_all"), "feature", "left")
    share, expected = F.col("texts") / F.lit(max(1, n_toxic)), (F.coalesce("_all", F.lit(0)) + 1) / F.lit(max(1, n_all) + 2)
    z = (share - expected) / F.sqrt(expected * (1 - expected) / F.lit(max(1, n_toxic)))
    kept = met.select("feature", z.alias("z"), "texts").where(F.col("z") > LEAST_Z).orderBy(F.desc("z"), F.desc("texts"), "feature").select("feature").toArrow()
    return {f: k for k, f in enumerate(kept.column(0).to_pylist())}


class Sparse:
    """A matrix of zeros and ones by the columns that each row has; as much of one as ``fit_classifier`` needs."""

    __array_ufunc__ = None  # so that array @ Sparse comes here

    def __init__(self, columns: np.ndarray, lengths: np.ndarray, width: int):
        self.columns, self.lengths, self.shape = columns, lengths, (len(lengths), width)
        self.rows = np.repeat(np.arange(len(lengths)), lengths)

    def __len__(self) -> int:
        return self.shape[0]

    def __getitem__(self, drawn: np.ndarray) -> Sparse:
        lengths = self.lengths[drawn]
        starts = (np.cumsum(self.lengths) - self.lengths)[drawn]
        within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return Sparse(self.columns[np.repeat(starts, lengths) + within], lengths, self.shape[1])

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.columns], len(self)).astype(np.float32)

    def __rmatmul__(self, slope: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, slope[self.rows], self.shape[1])


def _loss(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic loss of a margin and its slope."""
    return np.logaddexp(0, -margin), -1 / (1 + np.exp(np.clip(margin, -60, 60)))


def fit_classifier(positive: np.ndarray | Sparse, unlabelled: np.ndarray | Sparse, prior: float, seed: int, rounds: int = 200, rate: float = 0.2, penalty: float = 5e-5) -> np.ndarray:
    """Weights and bias of one linear classifier that minimises the non-negative risk.

    The rows are a bootstrap draw; all of them make one Adam step.  Every feature was chosen
    because toxic texts have it more often, so no weight may fall below zero: a long toxic text is
    not excused by the number of its words.  ``penalty`` (L1) keeps features of chance at zero.
    """
    draw = np.random.default_rng(seed)
    xp, xu = positive[draw.integers(0, len(positive), len(positive))], unlabelled[draw.integers(0, len(unlabelled), len(unlabelled))]
    w = np.zeros(positive.shape[1] + 1, np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)

    def gradient(x: np.ndarray | Sparse, slope: np.ndarray) -> np.ndarray:
        return np.append(slope @ x, slope.sum()).astype(np.float32) / len(x)

    for step in range(1, rounds + 1):
        gp, gu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
        _, slope_plus = _loss(gp)
        as_negative, slope_minus = _loss(-gp)
        from_all, slope_all = _loss(-gu)
        rest = from_all.mean() - prior * as_negative.mean()
        of_rest = prior * gradient(xp, slope_minus) - gradient(xu, slope_all)  # the slopes are by -margin
        move = prior * gradient(xp, slope_plus) + of_rest if rest >= 0 else -of_rest
        move[:-1] += penalty
        first, second = 0.9 * first + 0.1 * move, 0.999 * second + 0.001 * move**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)
    return w


def _present(listed: dict[int, int]) -> Callable[[pa.Array], pa.Array]:
    features = Featuriser(listed)
    return lambda texts: pa.array([sorted(features(t)) for t in texts.to_pylist()], pa.list_(pa.int32()))


def _sparse(rows: list, width: int) -> Sparse:
    lengths = np.array([len(r[0]) for r in rows], np.int64)
    return Sparse(np.array([c for r in rows for c in r[0]], np.int64), lengths, width)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = FOLDS, classifiers: int = 3, default_prior: float = 0.1) -> Model:
    """Train on rows outside fold 0.

    A document is confirmed toxic if one of its labels says so.  The prior is the share of toxic
    among labelled documents of the training folds; ``default_prior`` holds if there is no label.
    Without a toxic example, or without any telling feature, every text gets the prior as its score.
    """
    training = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(fold(F.col("doc_id"), folds) != 0)
    known = labels.select(F.col(key).alias("doc_id"), F.col(label).alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = materialise(known.where(fold(F.col("doc_id"), folds) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n_known, n_toxic = known.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") == 1)).first()
    prior = min(max(n_toxic / n_known, 1e-4), 0.9) if n_known else default_prior
    if not n_toxic:
        return Model({}, np.array([[np.log(prior / (1 - prior))]]), prior)

    toxic = lookup_join(training, known.where("toxic = 1").select("doc_id"), ["doc_id"], "left_semi").select("doc_id", "text")
    listed = choose_features(toxic.select("text"), training.select("text"))
    if not listed:
        return Model({}, np.array([[np.log(prior / (1 - prior))]]), prior)

    n_training = training.count()

    def sample(rows: DataFrame, bound: int, of: int) -> np.ndarray:
        """About ``bound`` rows, picked by a hash of id and text, as a matrix of the listed features."""
        cut = int(min(1.0, bound / max(1, of)) * 1_000_000)
        picked = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < cut)
        found = picked.select(F.arrow_udf(_present(listed), "array<int>")("text")).collect()
        return _sparse(found, len(listed))

    positive, unlabelled = sample(toxic, MOST_TOXIC, n_toxic), sample(training, MOST_UNLABELLED, n_training)
    if not len(positive) or not len(unlabelled):
        return Model({}, np.array([[np.log(prior / (1 - prior))]]), prior)
    weights = [fit_classifier(positive, unlabelled, prior, seed) for seed in range(classifiers)]
    return Model(listed, np.array(weights), prior)


def score(text: Column, model: Model) -> Column:
    """Probability of being toxic, the mean logit of the classifiers; null counts as empty."""
    listed, mean = model.listed, model.weights.mean(axis=0)
    weights, bias = mean[:-1].tolist(), float(mean[-1])
    features = Featuriser(listed)

    def scores(texts: pa.Array) -> pa.Array:
        logits = np.array([bias + sum(weights[f] for f in features(t)) for t in texts.to_pylist()], dtype="float64")
        return pa.array(1 / (1 + np.exp(-np.clip(logits, -500, 500))), pa.float64())

    return F.arrow_udf(scores, "double").asNondeterministic()(text)


def keep_harmless(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that score below ``threshold``, with their own columns; repeated rows are judged alike."""
    model = fit(docs, labels, key, text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("text"))
    return rows.withColumn("_score", score(F.col("text"), model)).where(F.col("_score") < threshold).select("_row.*")
