"""Reproducible train/test splits and cross-validation folds.

Rows are ordered by a hash of (seed, key).  Which part a row falls in depends only on
which side of a few border rows it lies: the borders (one per class and part) are looked up
among counts of hash prefixes, and each full row is then assigned by comparing its own hash
with them, where it is, without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.numeric import hash_order
from cohortspark.session import materialise

SEED = 30
HASH_PREFIX = 4
MOST_CLASSES = 1_000
TEST_SHARE = 0.3


def _borders(
    df: DataFrame, key: str, by: list[str], seed: int, wanted: list[tuple[Column, Column]], prefix: int = HASH_PREFIX
) -> list[tuple[object, str, object]]:
    """(class, hash, key) of the rows at the wanted places of their class's order.

    ``wanted`` has pairs of a condition on the class and a place counted from 1, which may use ``_size``.
    The first ``prefix`` letters of the hash cut a class into buckets.  They are counted, and only
    the buckets that hold a border are put in order; no table is ever sorted as a whole.
    """
    hashes = df.select(*by, key, hash_order(seed, key).alias("_hash")).withColumn("_bucket", F.substring("_hash", 1, prefix))
    counts = materialise(hashes.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n")))  # at most 16 ** prefix rows a class
    in_order = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(in_order), F.lit(0)), "_size": F.sum("_n").over(Window.partitionBy(*by))})
    holds = [rule & (place > F.col("_before")) & (place <= F.col("_before") + F.col("_n")) for rule, place in wanted]
    held = placed.where(reduce(lambda a, b: a | b, holds)).withColumnsRenamed({c: f"_of_{c}" for c in [*by, "_bucket"]})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*by, "_bucket"]])
    near = hashes.join(F.broadcast(held), same)  # a bucket for each border at most
    row = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_hash", key))
    numbered = near.withColumn("_row", F.col("_before") + row)
    rows = numbered.where(reduce(lambda a, b: a | b, [rule & (F.col("_row") == place) for rule, place in wanted])).select(*by, "_hash", key).collect()
    return [(r[by[0]] if by else None, r["_hash"], r[key]) for r in rows]


def _classes(df: DataFrame, label: str) -> dict[object, int]:
    """Size of every class; a column with more than ``MOST_CLASSES`` values is not a label."""
    sizes = df.groupBy(label).count().limit(MOST_CLASSES + 1).collect()
    if len(sizes) > MOST_CLASSES:
        raise ValueError(f"{label} has more than {MOST_CLASSES} classes")
    return {r[label]: r["count"] for r in sizes}


def _beyond(key: str, seed: int, border: tuple[object, str, object]) -> Column:
    """Whether a row comes after a border row."""
    own, (_, at_hash, at_key) = hash_order(seed, key), border
    return (own > at_hash) | ((own == at_hash) & (F.col(key) > F.lit(at_key)))


def stratified_split(
    df: DataFrame, key: str, label: str, test_share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Add a boolean ``is_test``; exactly ceil(share * N) rows are test rows.

    Classes get the whole part of their proportional share; the remaining rows go to
    the classes with the largest fractions (ties to the smaller label).
    """
    sizes = _classes(df, label)
    total = sum(sizes.values())
    wanted = -(-round(test_share * total * 1e9) // 1_000_000_000)
    exact = {c: wanted * n / total for c, n in sizes.items()}
    quota = {c: int(e) for c, e in exact.items()}
    by_fraction = sorted(exact, key=lambda c: (-(exact[c] - quota[c]), str(c)))
    for c in by_fraction[: wanted - sum(quota.values())]:
        quota[c] += 1
    at_quota = [(F.col(label).eqNullSafe(F.lit(c)), F.lit(q)) for c, q in quota.items() if q]
    if not at_quota:
        return df.withColumn("is_test", F.lit(False))
    last = _borders(df, key, [label], seed, at_quota)
    chosen = [F.col(label).eqNullSafe(F.lit(border[0])) & ~_beyond(key, seed, border) for border in last]
    return df.withColumn("is_test", reduce(lambda a, b: a | b, chosen))


def assign_folds(
    df: DataFrame, key: str, folds: int = 5, seed: int = SEED, by: str | None = None
) -> DataFrame:
    """Add ``fold`` (0-based); sizes differ by at most one, the larger ones first.

    With ``by`` the folds are dealt within each class.
    """
    # Last row of fold f, counted from 1: the first _size % folds folds get one more.
    ends = [F.expr(f"_size div {folds} * {f + 1} + least(_size % {folds}, {f + 1})") for f in range(folds - 1)]
    if by:
        _classes(df, by)
    borders = _borders(df, key, [by] if by else [], seed, [(F.lit(True), end) for end in ends]) if ends else []
    # A fold that ends at row 0 of a small class has no border row; every row is beyond it.
    passed = [
        ((F.col(by).eqNullSafe(F.lit(border[0])) if by else F.lit(True)) & _beyond(key, seed, border)).cast("int") for border in borders
    ]
    return df.withColumn("fold", reduce(lambda a, b: a + b, passed, F.lit(0)))
