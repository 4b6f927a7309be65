"""Cohort cleaning: shared schema, derived index and label, eligibility filters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cohortspark.functions.text import duration_minutes, zero_padded

# Cut-off of the index, its divisor, the shortest accepted fast.
INDEX_CUTOFF = 2.5
INDEX_DIVISOR = 405
MINIMUM_FAST_MINUTES = 480


def column(name: str) -> Column:
    """A column by its exact name, dots and hyphens included."""
    return F.col(f"`{name}`")


def normalise_codes(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Fold every alias into its canonical code, whichever of them are present."""
    canonical: dict[str, list[str]] = {}
    for name in df.columns:
        canonical.setdefault(aliases.get(name, name), []).append(name)
    return df.select(
        *[
            (F.coalesce(*[column(n) for n in names]) if len(names) > 1 else column(names[0])).alias(code)
            for code, names in canonical.items()
        ]
    )


def to_shared_schema(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Keep the mapped codes only, under their shared names."""
    return df.select(*[column(code).alias(name) for code, name in mapping.items()])


def select_matching(df: DataFrame, include: str | list[str] | None = None, exclude: str | list[str] | None = None) -> DataFrame:
    """Keep or drop columns by exact list or by full-match pattern."""

    def test(rule):
        if rule is None:
            return lambda name: False
        if isinstance(rule, str):
            return lambda name: re.fullmatch(rule, name) is not None
        return lambda name: name in set(rule)

    wanted = (lambda name: True) if include is None else test(include)
    unwanted = test(exclude)
    return df.select(*[column(c) for c in df.columns if wanted(c) and not unwanted(c)])


def mean_pressure(
    df: DataFrame, diastolic: list[str], systolic: list[str], name: str = "MAP", drop: str = r"^.*PRESSURE$"
) -> DataFrame:
    """Mean arterial pressure ``(2 D + S) / 3`` of averaged readings; readings dropped."""

    def mean(names: list[str]) -> Column:
        return reduce(lambda a, b: a + b, [column(n) for n in names]) / len(names)

    with_map = df.withColumn(name, (2 * mean(diastolic) + mean(systolic)) / 3)
    return select_matching(with_map, exclude=drop)


def add_index_label(
    df: DataFrame,
    first: str,
    second: str,
    cutoff: float = INDEX_CUTOFF,
    divisor: float = INDEX_DIVISOR,
    index: str = "HOMA-IR",
    label: str = "IR",
) -> DataFrame:
    """Index ``first * second / divisor`` and the label index > cutoff (strict)."""
    with_index = df.withColumn(index, column(first) * column(second) / divisor)
    return with_index.withColumn(label, column(index) > cutoff)


def recompute_ldl(df: DataFrame, total: str = "T_CHO", hdl: str = "HDL_C", tg: str = "TG", ldl: str = "LDL_C") -> DataFrame:
    """Overwrite LDL with the Friedewald value and keep positive results."""
    return df.withColumn(ldl, column(total) - column(hdl) - column(tg) / 5).where(column(ldl) > 0)


def complete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without any null.  NaN is a number here; see :func:`nan_as_null`."""
    present = [column(c).isNotNull() for c in (columns or df.columns)]
    return df.where(reduce(lambda a, b: a & b, present))


def nan_as_null(df: DataFrame) -> DataFrame:
    """Turn NaN of floating columns into null, as readers of coded files do."""
    floating = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[F.nanvl(column(c), F.lit(None)).alias(c) if c in floating else column(c) for c in df.columns])


def integers_as_double(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cast whole-number columns to double so that cohorts can be united."""
    whole = {f.name for f in df.schema.fields if isinstance(f.dataType, IntegralType)}
    chosen = whole if columns is None else whole & set(columns)
    return df.select(*[column(c).cast("double").alias(c) if c in chosen else column(c) for c in df.columns])


def eligible(
    df: DataFrame,
    minimum_age: float | None = 18,
    age: str = "AGE",
    diagnosis: str = "DIABETES",
    diagnosis_range: tuple[float, float] = (0, 0),
) -> DataFrame:
    """Strict age filter (optional per cohort) and closed range of accepted diagnoses."""
    kept = df if minimum_age is None else df.where(column(age) > minimum_age)
    return kept.where(column(diagnosis).between(*diagnosis_range))


def padded_id(df: DataFrame, key: str, width: int = 6) -> DataFrame:
    return df.withColumn(key, zero_padded(column(key), width))


def long_enough(df: DataFrame, duration: str, minimum: int = MINIMUM_FAST_MINUTES, on_bad: str = "null") -> DataFrame:
    """Keep rows whose text duration reaches ``minimum`` minutes; drop the column."""
    return df.where(duration_minutes(column(duration), on_bad) >= minimum).drop(duration)


def plausible(df: DataFrame, upper: dict[str, float]) -> DataFrame:
    """Rows where every named column is below its bound."""
    return df.where(reduce(lambda a, b: a & b, [column(c) < bound for c, bound in upper.items()]))


def union_cohorts(frames: dict[object, DataFrame], code: str = "RACE", relaxed: bool = False) -> DataFrame:
    """Union by name with a constant cohort code; ``relaxed`` fills missing columns."""
    parts = [frame.withColumn(code, F.lit(value)) for value, frame in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=relaxed), parts)


def union_in_order(frames: list[DataFrame], sequence: str = "file_seq") -> DataFrame:
    """Union that keeps the listing order as a column, since rows are unordered."""
    return reduce(lambda a, b: a.unionByName(b), [f.withColumn(sequence, F.lit(i)) for i, f in enumerate(frames)])


def cascade(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Rows left after each successive filter, counted in one pass.

    Returns ``step, stage, n``; a null predicate removes the row, as in a filter.
    """
    running, counts = F.lit(True), [F.count(F.lit(1)).alias("read")]
    for name, rule in steps.items():
        running = running & F.coalesce(rule, F.lit(False))
        counts.append(F.count_if(running).alias(name))
    names = ["read", *steps]
    stages = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("stage"), F.col(f"`{n}`").alias("n")) for i, n in enumerate(names)])
    return df.agg(*counts).select(F.explode(stages).alias("s")).select("s.*")


def chain(df: DataFrame, *steps) -> DataFrame:
    """Apply DataFrame -> DataFrame steps in order."""
    return reduce(lambda frame, step: frame.transform(step), steps, df)
