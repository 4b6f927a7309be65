"""Pairwise feature generation and feature-set selection."""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.numeric import INFINITY, log_if_positive, ratio
from cohortspark.operators.clean import column

# Columns never combined, columns that give the target away, and the
# nine baseline variables.
NOT_COMBINED = ["Release_No", "MET_ID", "IR", "SEX", "AGE", "RACE", "DIABETES"]
LEAKING = ["Release_No", ".*HOMA-IR.*", ".*FASTING_INSULIN.*", ".*DIABETES.*"]
BASELINE = ["AGE", "BMI", "FASTING_GLUCOSE", "HBA1C", "HDL_C", "RACE", "SEX", "TG", "T_CHO"]


# Suffixes of the generated columns and what each holds, of one column and of two.
OF_ONE = {"square": lambda x: x * x, "sqrt": F.sqrt, "log": lambda x: log_if_positive(x, 10)}
OF_TWO = {"mul": lambda x, y: x * y, "div": ratio}


def feature_expressions(bases: list[str]) -> dict[str, Column]:
    """Name to expression: every transform of a base, and every combination of a pair in name order."""
    value = lambda name: column(name).cast("double")
    of_one = {f"{b}_{suffix}": f(value(b)) for suffix, f in OF_ONE.items() for b in bases}
    return of_one | {f"{a}_{word}_{b}": f(value(a), value(b)) for word, f in OF_TWO.items() for a, b in combinations(sorted(bases), 2)}


SAFE_DIVISOR = 1e-150
"""No ratio overflows above this, given that every square is finite."""


def finite_rows(df: DataFrame, bases: list[str]) -> DataFrame:
    """Rows whose every generated feature is finite, decided on the bases.

    A finite logarithm needs a positive number, and then the roots exist too, so only
    overflow is left.  No product exceeds the square of the greatest base; and a ratio
    can overflow only for a divisor so small that the (rare) pairwise look is taken,
    where the dividend to beat is the greatest base before the divisor.  A few
    comparisons per row replace one test per generated column.
    """
    numbers = [column(b).cast("double") for b in sorted(bases)]
    known = df.na.drop("any", subset=bases)  # null and NaN
    least, greatest = (F.least(*numbers), F.greatest(*numbers)) if len(numbers) > 1 else (numbers[0], numbers[0])
    bounded = (least > 0) & (greatest * greatest < F.lit(INFINITY))
    pairwise = F.aggregate(
        F.array(*numbers),
        F.struct(F.lit(0.0).alias("top"), F.lit(True).alias("ok")),
        lambda s, x: F.struct(
            F.greatest(s["top"], x).alias("top"), (s["ok"] & F.coalesce(F.try_divide(s["top"], x) < INFINITY, F.lit(False))).alias("ok")
        ),
        lambda s: s["ok"],
    )
    return known.where(bounded & ((least > SAFE_DIVISOR) | pairwise))


def generate_interactions(
    df: DataFrame, code: int = 1, exclude: list[str] | None = None, code_column: str = "RACE"
) -> DataFrame:
    """Add a cohort code and all transforms and pairs; drop rows with a non-finite one.

    Columns come out in code-point order.
    """
    exclude = NOT_COMBINED if exclude is None else exclude
    df = df.withColumn(code_column, F.lit(code))
    bases = [c for c in df.columns if c not in exclude]
    made = feature_expressions(bases)
    kept = finite_rows(df, bases) if bases else df
    names = sorted([*df.columns, *made])
    return kept.select(*[made[n].alias(n) if n in made else column(n) for n in names])


def drop_target_derived(df: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Drop the identifier and every column that gives the target away."""
    patterns = LEAKING if patterns is None else patterns
    return df.select(*[column(c) for c in df.columns if not any(re.fullmatch(p, c) for p in patterns)])


def _is_generated(name: str, columns: set[str]) -> bool:
    """Whether a name is that of a transform, or of a pair, of columns that are there."""
    for transform in ("_square", "_sqrt", "_log"):
        if name.endswith(transform) and name.removesuffix(transform) in columns:
            return True
    for pair in ("_mul_", "_div_"):
        pieces = name.split(pair)
        if any(pair.join(pieces[:i]) in columns and pair.join(pieces[i:]) in columns for i in range(1, len(pieces))):
            return True
    return False


def ablation_feature_sets(
    columns: list[str], target: str = "IR", base: list[str] | None = None, measured: list[str] | None = None
) -> dict[str, list[str]]:
    """Four nested feature lists over one table, the target left out.

    ``measured`` names the variables that were not generated; by default those that are no
    transform and no pair of other columns in the list.
    """
    features = [c for c in columns if c != target]
    base = BASELINE if base is None else base
    measured = [c for c in features if not _is_generated(c, set(columns))] if measured is None else measured
    extra = [c for c in measured if c not in base and c != target]
    return {
        "baseline": list(base),
        "baseline + interactions": [c for c in features if not any(e in c for e in extra)],
        "extended": list(measured),
        "extended + interactions": features,
    }


def log_ratio(df: DataFrame, numerator: str, denominator: str, name: str, log: bool = True) -> DataFrame:
    """Ratio of two columns, by default on the natural log scale."""
    value = ratio(column(numerator), column(denominator))
    return df.withColumn(name, log_if_positive(value) if log else value)
