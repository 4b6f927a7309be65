"""Quality rules whose cutoffs are chosen under a bound on false rejections.

Every rule compares a share of a document, in thousandths, with a cutoff.  For each
stratum and rule the cutoffs are tested from the most lenient one on: with k of n
documents that are labelled good rejected, the hypothesis "the rule rejects more than
``risk`` of the good documents" is refuted when P(Bin(n, risk) <= k) is small.  This is
the exact (Clopper-Pearson) bound.  The first failure ends a chain, so its length costs
nothing; the chains of all strata and rules share ``error`` by Bonferroni.  All certified
cutoffs hold at once, so the one that separates the labels best may be taken.  A stratum
with too few good labels certifies nothing and rejects nothing beyond the base rules.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.joins import fits_broadcast, lookup_join
from cohortspark.session import materialise

STATISTICS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper", "n_marks",
]
# Rule: what is counted, per what, and the cutoffs in thousandths from lenient to strict.
SHARES = [900, 700, 500, 400, 300, 200, 150, 100, 70, 50, 30, 20]
RULES = {
    "symbols": ("n_symbols", "n_words", SHARES),
    "duplicate_lines": ("n_dup_lines", "n_lines", SHARES),
    "repeated_words": ("n_repeat_words", "n_words", SHARES),
    "upper_case": ("n_upper", "word_chars", SHARES),
    "marks": ("n_marks", "n_words", SHARES),
    "word_length": ("word_chars", "n_words", [100_000, 50_000, 30_000, 20_000, 15_000, 12_000, 10_000]),
}
RISK, ERROR, GOOD_WEIGHT = 0.05, 0.05, 10.0

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows that occur twice or more, the first occurrence included.

    Windows get exact numbers: words are numbered, then pairs of numbers are ranked
    until ``window`` words are one number.
    """
    n = len(words)
    if n <= window:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    runs, counts = ids, None
    for step in range(1, window):
        _, runs, counts = np.unique(runs[:-1] * len(known) + ids[step:], return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
    again = counts[runs] > 1
    if not again.any():
        return 0
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.flatnonzero(again), 1)
    np.add.at(steps, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def statistics_of(text: str | None) -> tuple[int, ...]:
    """The figures of one text, in the order of ``STATISTICS``; null counts as empty."""
    text = text or ""
    plain = text.encode()
    words, letters = plain.split(), np.frombuffer(plain, np.uint8)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        len(lines),
        repeated_words(words),
        int(np.count_nonzero((letters >= 65) & (letters <= 90))),
        text.count("!"),
    )


def _statistics(texts: pa.Array) -> pa.Array:
    rows = [statistics_of(t) for t in texts.to_pylist()]
    figures = np.array(rows, np.int64).reshape(len(rows), len(STATISTICS))
    return pa.StructArray.from_arrays([pa.array(figures[:, i]) for i in range(len(STATISTICS))], STATISTICS)


def statistics(text: Column) -> Column:
    """A struct of counts for every whole text; null counts as empty."""
    kind = "struct<" + ",".join(f"{s}:bigint" for s in STATISTICS) + ">"
    return F.arrow_udf(_statistics, kind).asNondeterministic()(text)  # type: ignore[arg-type]


def base_failed(stats: str = "_stats") -> Column:
    words, repeats = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (words < 10) | (100 * repeats > 20 * words)


def exceeds(rule: str, cutoff: Column, stats: str = "_stats") -> Column:
    """Whether the share is above a cutoff in thousandths; false for a null cutoff."""
    count, per, _ = RULES[rule]
    return F.coalesce(1000 * F.col(f"{stats}.{count}") > cutoff * F.col(f"{stats}.{per}"), F.lit(False))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed from the largest term down."""
    if n == 0:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    if k > n * p:  # beyond the mode the complement is the short sum
        total, j = 0.0, k
        while j < n:
            term *= (n - j) / (j + 1) * p / (1 - p)
            j += 1
            total += term
            if term <= total * 1e-18:
                break
        return 1.0 - total
    total, j = term, k
    while j > 0 and term > total * 1e-18:
        term *= j / (n - j + 1) * (1 - p) / p
        j -= 1
        total += term
    return min(1.0, total)


def _tails(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_tail(int(a), int(b), float(c)) for a, b, c in zip(k, n, p)], dtype="float64")


def fit_cutoffs(labelled: DataFrame, risk: float = RISK, error: float = ERROR, good_weight: float = GOOD_WEIGHT) -> DataFrame:
    """Per stratum the chosen cutoff of every rule, null where none is certified.

    ``labelled`` has ``_stratum``, ``_stats`` and ``_good`` (1 or 0), one row per labelled
    document that passes the base rules.  ``risk`` bounds the share of good documents that
    all rules together reject in a stratum, with probability 1 - ``error`` for all strata
    at once.  Among certified cutoffs the one with the greatest share of bad documents
    rejected less ``good_weight`` times the share of good ones is taken, the more lenient
    in ties, and none if that is not above zero.  Only sums per stratum and cutoff are shuffled.
    """
    each = [(rule, step, cutoff) for rule, (_, _, cutoffs) in RULES.items() for step, cutoff in enumerate(cutoffs)]
    good, bad = F.col("_good") == 1, F.col("_good") == 0
    above = {(rule, step): exceeds(rule, F.lit(cutoff)) for rule, step, cutoff in each}
    sums = [F.count_if(kind & above[rule, step]).alias(f"{name}_{rule}_{step}") for rule, step, _ in each for name, kind in (("k", good), ("b", bad))]
    counts = materialise(labelled.groupBy("_stratum").agg(F.count_if(good).alias("n"), F.count_if(bad).alias("m"), *sums))
    strata = max(1, counts.count())
    cells = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(step).alias("step"), F.lit(cutoff).alias("cutoff"), F.col(f"k_{rule}_{step}").alias("k"), F.col(f"b_{rule}_{step}").alias("b"))
        for rule, step, cutoff in each
    ])
    long = counts.select("_stratum", "n", "m", F.inline(cells))
    share = F.lit(risk / len(RULES))
    tail = F.pandas_udf(_tails, "double")("k", "n", share)
    tested = long.withColumn("passes", tail <= error / (strata * len(RULES)))
    first_failure = F.min(F.when(~F.col("passes"), F.col("step")))
    value = F.col("b") / F.greatest(F.col("m"), F.lit(1)) - good_weight * F.col("k") / F.greatest(F.col("n"), F.lit(1))
    chains = tested.groupBy("_stratum", "rule").agg(
        first_failure.alias("stop"), F.collect_list(F.struct("step", "cutoff", value.alias("value"))).alias("steps"),  # as many as the rule has cutoffs
    )
    certified = F.filter("steps", lambda s: (s["step"] < F.coalesce(F.col("stop"), F.lit(1 << 30))) & (s["value"] > 0))
    best = F.array_max(F.transform(certified, lambda s: F.struct(s["value"].alias("value"), (-s["step"]).alias("step"), s["cutoff"].alias("cutoff"))))
    return chains.select("_stratum", "rule", best["cutoff"].alias("cutoff")).groupBy("_stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))


def verdicts(described: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add ``_kept`` to rows with ``_stratum`` and ``_stats``; a stratum without cutoffs only has the base rules."""
    renamed = cutoffs.withColumnsRenamed({rule: f"_cut_{rule}" for rule in RULES})
    joined = lookup_join(described, renamed, ["_stratum"])
    fails = reduce(lambda a, b: a | b, [exceeds(rule, F.col(f"_cut_{rule}")) for rule in RULES])
    return joined.withColumn("_kept", ~base_failed() & ~fails).drop(*[f"_cut_{rule}" for rule in RULES])


def described(docs: DataFrame, text: str = "text", stratum: str = "lang") -> DataFrame:
    """Add ``_stats`` and ``_stratum`` (a null stratum is one of its own)."""
    return docs.withColumns({"_stats": statistics(F.col(text)), "_stratum": F.coalesce(F.col(stratum).cast("string"), F.lit("\x00none"))})


def _held(labels: DataFrame, key: str, label: str) -> DataFrame:
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    return known.groupBy(F.col(key).alias("_label_key")).agg(F.max(label).alias("_good"))


def with_labels(rows: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Rows that have a label, with it as ``_good``; a document labelled twice counts as good if one label says so."""
    return rows.join(_held(labels, key, label), F.col(key) == F.col("_label_key")).drop("_label_key")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality") -> DataFrame:
    """The documents that pass, with their own columns.

    A null or empty text has no words and goes; repeated rows are judged alike; without
    labels only the base rules hold.  No text is shuffled: labels that fit are broadcast and the texts with a
    label are read twice; of more labels only the counts of the texts meet them, and all texts are read twice.
    """
    needed = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(stratum).alias("lang"))
    held = materialise(_held(labels, key, label))
    if fits := fits_broadcast(held):
        known = described(lookup_join(needed, held, [("doc_id", "_label_key")], "inner", kept=True, fits=fits))
    else:
        known = lookup_join(described(needed).drop("text"), held, [("doc_id", "_label_key")], "inner", kept=True, fits=fits)
    cutoffs = fit_cutoffs(known.where(~base_failed()))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("text"), F.col(stratum).alias("lang"))
    return verdicts(described(rows), cutoffs).where("_kept").select("_row.*")
