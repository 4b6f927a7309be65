"""Arrow UDFs over tables with one row per test."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cohortspark.functions import tails


@F.pandas_udf(DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(tails.student_two_sided(t.to_numpy(float), df.to_numpy(float))).replace(np.nan, None)


@F.pandas_udf(DoubleType())
def ks_one_sample(d: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else tails.ks_one_sample_tail(float(a), int(b)) for a, b in zip(d, n)], dtype=object)


@F.pandas_udf(DoubleType())
def ks_two_sample(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(a) else tails.ks_two_sample_tail(float(a), int(b), int(c)) for a, b, c in zip(d, n1, n2)],
        dtype=object,
    )


@F.pandas_udf(DoubleType())
def rank_sum_exact(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Null for rows whose smaller group is too large (or empty) to be counted."""

    def tail(value, a, b):
        countable = not pd.isna(value) and 0 < min(a, b) <= tails.EXACT_RANK_SUM
        return tails.rank_sum_exact_tail(float(value), int(a), int(b)) if countable else None

    return pd.Series([tail(*row) for row in zip(u, n1, n2)], dtype=object)


@F.pandas_udf(DoubleType())
def hypergeometric(k: pd.Series, marked: pd.Series, drawn: pd.Series, population: pd.Series) -> pd.Series:
    rows = zip(k, marked, drawn, population)
    return pd.Series([None if any(map(pd.isna, row)) else tails.hypergeometric_tail(*map(int, row)) for row in rows], dtype=object)
