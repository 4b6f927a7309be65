"""Running aggregates over ordered groups of any size.

A window ``PARTITION BY key ORDER BY value`` puts a whole group into one task.
That is right for many moderate groups and wrong once a single group holds a large
share of the rows, or when there is no key at all.  :class:`OrderedGroups` measures
the largest group first and then lays the rows out in one of two exact ways:

* every group fits a task: one hash exchange on the keys;
* some group does not: a range exchange on (keys, order) cuts the groups into
  slices, the layout is checkpointed so that slice numbers are the same for every
  reader, and what earlier slices contribute is added from a table that holds a
  row only for groups reaching over a slice border.  A border is crossed by at most
  one group, so that table has at most twice as many rows as there are slices and
  can be broadcast whatever the data size.

All rank-type operators (rank sums, empirical distribution functions, ROC and PR
curves, quantiles, multiple-testing correction, split assignment) build on this.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.session import materialise

MAX_GROUP_ROWS = 5_000_000
"""Rows one task may sort for one group before the group is cut into slices."""

KEYLESS_ROWS = 250_000
"""The same for rows without keys, which would otherwise all meet in one task."""

SLICE_ROWS = 2_000_000
"""Rows aimed at per slice."""

MAX_SLICES = 20_000
"""Most slices made; beyond that slices grow.  Bounds the broadcast border table."""

_SLICE = "_slice"
_COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Running:
    """A running aggregate, the current row included.

    ``backward`` runs from the last row of the group to the first.
    """

    value: Column
    how: str = "sum"
    backward: bool = False


@dataclass(frozen=True)
class Total:
    """An aggregate over the whole group, repeated on each of its rows."""

    value: Column
    how: str = "sum"


def _fold(how: str, left: Column, right: Column) -> Column:
    if how == "sum":
        return left + F.coalesce(right, F.lit(0))
    return F.least(left, right) if how == "min" else F.greatest(left, right)


class OrderedGroups:
    """Rows laid out so that group-wise running aggregates can be computed."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], sliced: bool):
        self.rows = rows
        self.keys = keys
        self.order = order
        self.sliced = sliced

    def replace(self, rows: DataFrame) -> "OrderedGroups":
        """The same layout with changed columns."""
        return OrderedGroups(rows, self.keys, self.order, self.sliced)

    def with_columns(self, columns: dict[str, Column]) -> "OrderedGroups":
        return self.replace(self.rows.withColumns(columns))

    def frame(self) -> DataFrame:
        """The rows without layout columns."""
        return self.rows.drop(_SLICE)

    def compute(self, **wanted: Running | Total) -> "OrderedGroups":
        """Append one column per requested running aggregate or total."""
        inputs = {f"_in_{name}": spec.value for name, spec in wanted.items()}
        rows = self.rows.withColumns(inputs)

        groups = ([_SLICE] if self.sliced else []) + self.keys
        partition = Window.partitionBy(*(groups or [F.lit(0)]))
        local = {}
        for name, spec in wanted.items():
            if isinstance(spec, Total):
                # Ordered like the running ones, so that one window operator does all.
                over = partition.orderBy(*self.order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            else:
                # A frame that grows is one pass; one that shrinks would start over
                # for every row, so backward means forward in descending order.
                ends = [F.desc(c) if spec.backward else F.asc(c) for c in self.order]
                over = partition.orderBy(*ends).rowsBetween(Window.unboundedPreceding, 0)
            local[name] = _COMBINE[spec.how](f"_in_{name}").over(over)
        if not self.sliced:
            return self.replace(rows.withColumns(local).drop(*inputs))

        borders = self._borders(rows, wanted)
        joined = _join_null_safe(rows.withColumns(local), F.broadcast(borders), groups)
        final = {name: _fold(spec.how, F.col(name), F.col(f"_out_{name}")) for name, spec in wanted.items()}
        dropped = list(inputs) + [f"_out_{name}" for name in wanted]
        return self.replace(joined.withColumns(final).drop(*dropped))

    def _borders(self, rows: DataFrame, wanted: dict[str, Running | Total]) -> DataFrame:
        """What the other slices of a group contribute, for groups in several slices."""
        parts = rows.groupBy(_SLICE, *self.keys).agg(
            *[_COMBINE[spec.how](f"_in_{name}").alias(f"_part_{name}") for name, spec in wanted.items()]
        )
        over_keys = Window.partitionBy(*(self.keys or [F.lit(0)]))
        earlier = over_keys.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
        later = over_keys.orderBy(_SLICE).rowsBetween(1, Window.unboundedFollowing)
        outside = {"_slices": F.count(F.lit(1)).over(over_keys)}
        for name, spec in wanted.items():
            combine, part = _COMBINE[spec.how], f"_part_{name}"
            if isinstance(spec, Running):
                outside[f"_out_{name}"] = combine(part).over(later if spec.backward else earlier)
            elif spec.how == "sum":
                outside[f"_out_{name}"] = F.sum(part).over(over_keys) - F.col(part)
            else:
                outside[f"_out_{name}"] = combine(part).over(over_keys)
        kept = [_SLICE, *self.keys, *[f"_out_{name}" for name in wanted]]
        return parts.withColumns(outside).where("_slices > 1").select(*kept)


def _join_null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join that lets null keys meet, keeping the left copy of the keys."""
    renamed = right.select(*[F.col(c).alias(f"_k_{c}") if c in on else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in on])
    return left.join(renamed, condition, "left").drop(*[f"_k_{c}" for c in on])


def ordered_groups(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    counts: dict[str, Column] | None = None,
    max_group_rows: int | None = None,
    sizes: tuple[int, int] | None = None,
) -> OrderedGroups:
    """Lay out ``rows`` by ``keys``, ordered by ``order`` within each group.

    With ``counts`` (aggregate expressions) the rows are first collapsed to one per
    (keys, order), which turns any number of ties into a single row; without it the
    order columns must be unique within a group.  ``sizes`` (rows of the largest group,
    rows in all) spares the count when the caller has measured them already.
    """
    limit = (MAX_GROUP_ROWS if keys else KEYLESS_ROWS) if max_group_rows is None else max_group_rows
    if sizes is None:
        sizes = rows.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    largest, total = sizes[0] or 0, sizes[1] or 0

    def collapse(df: DataFrame) -> DataFrame:
        if counts is None:
            return df
        return df.groupBy(*keys, *order).agg(*[c.alias(name) for name, c in counts.items()])

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if largest <= limit:
        # One exchange on the keys serves the collapse and every window that follows; it
        # gets more partitions than the session's default when the rows call for them.
        # Without keys the rows are collapsed where they are before they meet.
        placed, by = rows, [F.col(k) for k in keys]
        if keys:
            needed = min(-(-total // SLICE_ROWS), MAX_SLICES)
            placed = rows.repartition(needed, *by) if needed > partitions else rows.repartition(*by)
        return OrderedGroups(collapse(placed), keys, order, sliced=False)

    slices = max(partitions, min(-(-total // min(SLICE_ROWS, limit)), MAX_SLICES))
    laid_out = (
        collapse(rows)
        .repartitionByRange(slices, *[F.col(c) for c in keys + order])
        .withColumn(_SLICE, F.spark_partition_id())
    )
    placed = materialise(laid_out)
    if slices > partitions:
        placed = placed.repartition(slices, _SLICE, *[F.col(k) for k in keys])
    return OrderedGroups(placed, keys, order, sliced=True)
