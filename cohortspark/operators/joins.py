"""Joins whose smaller side is measured before it is broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from cohortspark.session import materialise

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
HEAVY_ROWS = 5_000_000
MOST_HEAVY = 100_000

Pairs = list[str] | list[tuple[str, str]]


def fits_broadcast(small: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a materialised table, reading at most ``max_rows + 1`` rows of it."""
    varying = [F.col(f"`{f.name}`") for f in small.schema.fields if isinstance(f.dataType, (StringType, BinaryType, ArrayType, MapType, StructType))]
    fixed = 8 * (len(small.columns) - len(varying))
    size = F.sum(F.length(F.to_json(F.struct(*varying)))) if varying else F.lit(0)
    rows, size = small.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    return rows <= max_rows and rows * fixed + (size or 0) <= max_bytes


def lookup_join(
    big: DataFrame, small: DataFrame, on: Pairs, how: str = "left", max_rows: int = BROADCAST_ROWS, condition: Column | None = None,
    heavy_rows: int | None = HEAVY_ROWS, null_safe: bool = False, kept: bool = False,
    fits: bool | None = None,
) -> DataFrame:
    """Join ``big`` to a table that is expected to be much smaller.

    The small side is computed once and measured.  Within the bounds it is broadcast.
    Beyond them the sides are shuffled, and keys with at least ``heavy_rows`` rows in
    ``big`` are salted: a key with k times that many rows is spread over k + 1 tasks by a hash
    of the whole row, and only its partners are repeated.  The most frequent
    ``MOST_HEAVY`` of them are broadcast to be marked; more than that are even by their number.
    None spares the count of the keys where they are even by construction.  Rows of the small
    side without a partner are never kept, so ``how`` is inner, left, left_semi or left_anti.
    ``on`` lists shared names or (big, small) pairs; the small side's key columns are
    dropped from the result.  With ``null_safe`` null keys meet each other; ``kept`` says the
    small side is materialised already, ``fits`` that it was measured already.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a lookup cannot be a {how} join")
    pairs = [(c, c) if isinstance(c, str) else c for c in on]
    mine, theirs = [b for b, _ in pairs], [f"_on_{i}" for i in range(len(pairs))]
    small = small if kept else materialise(small)
    renamed = small.withColumnsRenamed({s: t for (_, s), t in zip(pairs, theirs)})
    same = (lambda a, b: a.eqNullSafe(b)) if null_safe else (lambda a, b: a == b)
    match = [same(F.col(f"`{b}`"), F.col(t)) for b, t in zip(mine, theirs)]
    if condition is not None:
        match.append(condition)
    if fits_broadcast(small, max_rows) if fits is None else fits:
        return big.join(F.broadcast(renamed), _all(match), how).drop(*theirs)

    if heavy_rows is None:
        return big.join(renamed, _all(match), how).drop(*theirs)
    heavy = big.groupBy(*[F.col(f"`{b}`").alias(f"_h{i}") for i, b in enumerate(mine)]).count().where(F.col("count") >= heavy_rows)
    heavy = heavy.orderBy(F.desc("count")).limit(MOST_HEAVY)
    heavy = materialise(heavy.select(*[f"_h{i}" for i in range(len(pairs))], (F.expr(f"count div {heavy_rows}") + 1).alias("_salts")))
    if heavy.isEmpty():
        return big.join(renamed, _all(match), how).drop(*theirs)

    def marked(side: DataFrame, names: list[str]) -> DataFrame:
        equal = [same(F.col(f"`{n}`"), F.col(f"_h{i}")) for i, n in enumerate(names)]
        return side.join(F.broadcast(heavy), _all(equal), "left").drop(*[f"_h{i}" for i in range(len(names))])

    salts = F.coalesce("_salts", F.lit(1))
    row_salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), salts)
    salted = marked(big, mine).withColumn("_salt", row_salt).drop("_salts")
    repeated = marked(renamed, theirs).withColumn("_salt_s", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("_salts")
    match.append(F.col("_salt") == F.col("_salt_s"))
    return salted.join(repeated, _all(match), how).drop("_salt", "_salt_s", *theirs)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def full_outer_all(frames: list[DataFrame], key: str) -> DataFrame:
    """Chain of full outer joins on one key; the key is coalesced."""
    return reduce(lambda left, right: left.join(right, key, "full_outer"), frames)


def complete_keys(
    readings: DataFrame, key: str, member: str, value: str, n_members: int, unique: bool = False
) -> DataFrame:
    """Keys with a usable value for every one of ``n_members`` members.

    ``n_members`` comes from the list of members: a member without any reading must
    make every key incomplete.  Distinct (key, member) pairs are reduced before the
    count, so repeated readings do not pass for missing ones; that shuffles the pairs.
    When the source holds a pair only once, ``unique`` counts rows instead, and only
    one partial count per key and task is shuffled.
    """
    usable = readings.where(F.col(value).isNotNull() & ~F.isnan(value)).select(key, member)
    usable = usable if unique else usable.distinct()
    return usable.groupBy(key).count().where(F.col("count") == n_members).select(key)


def keep_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed (semi join)."""
    return lookup_join(rows, keys.select(key), [key], "left_semi")


def drop_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed (anti join; null keys are kept)."""
    return lookup_join(rows, keys.select(key), [key], "left_anti")


def attach_checked(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on a key that must be unique and identical on both sides.

    Raises, when the rows are computed, if one of either side finds no partner or more than one:
    the keyed form of pasting two aligned tables side by side.  Each side is read and shuffled once.
    """
    one = lambda side, name: side.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(key)))
    theirs = one(right, "_r").withColumnRenamed(key, "_key")
    both = one(left, "_l").join(theirs, F.col(f"`{key}`").eqNullSafe(F.col("_key")), "full_outer")
    aligned = F.coalesce((F.col("_l") == 1) & (F.col("_r") == 1), F.lit(False))
    shown = F.coalesce(F.col(f"`{key}`").cast("string"), F.col("_key").cast("string"), F.lit("null"))
    wrong = F.raise_error(F.concat(F.lit(f"tables are not aligned on {key}: "), shown))
    kept = F.when(aligned, F.col(f"`{key}`")).otherwise(wrong.cast(left.schema[key].dataType))
    return both.withColumn(key, kept).drop("_l", "_r", "_key")


def points_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    key: str,
    chrom: str = "chrom",
    position: str = "pos",
    start: str = "tx_start",
    end: str = "tx_end",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join of points (unique by ``key``) to intervals, ``start < position <= end``.

    Every interval is filed under the power of two that is at least its length, where
    it touches at most two cells; a point looks in one cell per size in use.  Interval
    length therefore never multiplies rows, unlike a fixed bin width, and the join is
    an equi join.  Points without a hit keep one row with nulls.
    """
    intervals = intervals.where(F.col(end) > F.col(start))
    size = F.ceil(F.log2((F.col(end) - F.col(start)).cast("double"))).cast("int")
    filed = intervals.withColumn("_size", size)
    # Positions covered are start + 1 .. end; dividing by 2^size is a right shift.
    cells = F.expr(f"sequence(shiftright(bigint(`{start}` + 1), _size), shiftright(bigint(`{end}`), _size))")
    filed = filed.withColumn("_cell", F.explode(cells))

    sizes = sorted(r[0] for r in filed.select("_size").distinct().collect())  # at most 63 values
    probes = points.withColumn("_at_size", F.explode(F.array(*[F.lit(s) for s in sizes or [0]])))
    probes = probes.withColumn("_at_cell", F.expr(f"shiftright(bigint(`{position}`), _at_size)"))
    covered = (F.col(start) < F.col(position)) & (F.col(end) >= F.col(position))
    cell = [(chrom, chrom), ("_at_size", "_size"), ("_at_cell", "_cell")]
    hits = materialise(lookup_join(probes, filed, cell, "inner", max_rows, condition=covered).drop("_at_size", "_at_cell"))
    missing = lookup_join(points, hits.select(key).distinct(), [key], "left_anti", max_rows)
    return hits.unionByName(missing, allowMissingColumns=True)
