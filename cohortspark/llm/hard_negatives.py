"""Hard negatives by angular triangle filtering.

Every row keeps its norm and its angles to a few reference directions.  The angle between an anchor
and a row is at least the difference of their angles to any reference and at most their sum, so the
references give an interval of cosines; times both norms, widened by more than the rounding, it is
a window that holds the integer score.  Only rows whose window overlaps the scores an anchor still
wants are scored: those that can enter its positives, and then those within the shares of its
positives.  References are chosen from a bounded sample (``SAMPLE``) and decide the cost alone.

Anchors and rows meet in blocks: a grid of anchor blocks and row blocks, in which each cell is a
task that holds one block of either.  A cell hands on the few best of each anchor, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.session import materialise

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # a negative's score in hundredths of the positive's
REFERENCES, SAMPLE = 8, 2_000
ROWS, ANCHORS, LEAST = 16_384, 16_384, 1_024  # rows and anchors in a block; a table is not cut into smaller blocks than the last
ANCHORS_AT_ONCE, ROWS_AT_ONCE = 64, 4_096  # of a cell
LARGEST = 2.0**28  # norm: the product of two, times 100, fits 64 bits
FLOAT_EXACT = 2.0**46  # the same product in doubles
ANGLE_SLACK, SCORE_SLACK = 4e-6, 1e-9  # angles are stored in single precision


def usable(vector: Column, label: Column) -> Column:
    """Whether a row takes part: a label, a vector, and only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return label.isNotNull() & vector.isNotNull() & finite


def _matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), max(int(lengths.max(initial=0)), width or 0)))
    out[np.arange(out.shape[1]) < lengths[:, None]] = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return out


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The integer components, as doubles."""
    return np.floor(vectors * SCALE)


def _angles(values: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of rows to unit references; a row without a direction is at right angles to all."""
    width = max(values.shape[1], references.shape[1])
    wide = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    with np.errstate(over="ignore", invalid="ignore"):
        cosines = np.nan_to_num((wide(values) / np.where(norms > 0, norms, 1)[:, None]) @ wide(references).T)
    return np.arccos(np.clip(cosines, -1, 1))


def choose_references(vectors: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit directions of the rows that are farthest in angle from those chosen before."""
    values = scaled(vectors)
    norms = np.linalg.norm(values, axis=1)
    units = values[(norms > 0) & (norms <= LARGEST)] / norms[(norms > 0) & (norms <= LARGEST)][:, None]
    chosen: list[int] = []
    closest = np.full(len(units), -1.0)  # greatest absolute cosine to those chosen: an opposite direction tells nothing new
    while len(chosen) < min(count, len(units)):
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, np.abs(units @ units[chosen[-1]]))
    return units[chosen]


def described(vectors: DataFrame, references: np.ndarray, key: str, label: str, vector: str, anchor: Column) -> DataFrame:
    """Rows that take part with norm, angles, a row number and whether they are anchors; kept on shared storage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = scaled(_matrix(batch.column("vector")))
            with np.errstate(over="ignore"):
                norms = np.linalg.norm(values, axis=1)
            angles = _angles(values, norms, references).astype(np.float32)
            offsets = pa.array(np.arange(len(angles) + 1, dtype=np.int32) * angles.shape[1])
            made = [pa.array(norms), pa.ListArray.from_arrays(offsets, pa.array(angles.ravel()))]
            full = pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "norm", "angles"])
            yield full.filter(pa.array(norms <= LARGEST))

    column = lambda name: F.col(f"`{name}`")
    rows = vectors.where(usable(column(vector), column(label))).select(
        F.monotonically_increasing_id().alias("row"), column(key).cast("bigint").alias("id"), column(label).cast("bigint").alias("label"),
        column(vector).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    kind = vectors.schema[vector].dataType.simpleString()
    return materialise(rows.mapInArrow(run, f"row bigint, id bigint, label bigint, vector {kind}, anchor boolean, norm double, angles array<float>"))


class _Block:
    """One side of a cell as arrays, shorter vectors filled up."""

    def __init__(self, table: pa.Table, width: int):
        self.values = scaled(_matrix(table["vector"], width))
        self.angles = _matrix(table["angles"]).astype(np.float64)
        self.norm, self.row, self.label = (table[c].to_numpy() for c in ("norm", "row", "label"))
        self.no_id = table["id"].is_null().to_numpy()
        self.id = table["id"].fill_null(0).to_numpy()


def _overlapping(a: _Block, chosen: np.ndarray, x: _Block, near: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor of ``chosen``, row of ``near``, score) for the pairs whose score may and does lie within low and high."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    # First the rows that no anchor of the chunk can reach by any single reference.
    # A score above zero is easiest for the longest row, one below zero for the shortest.
    norm = np.where(low > 1, x.norm[near].max(initial=0), x.norm[near].min(initial=np.inf))
    size = np.maximum(a.norm[chosen] * norm, 1e-9)
    reach = np.arccos(np.clip((low - 1) / size - SCORE_SLACK, -1, 1)) + ANGLE_SLACK
    theirs = x.angles[near]
    within = ((theirs >= (a.angles[chosen] - reach[:, None]).min(axis=0)) & (theirs <= (a.angles[chosen] + reach[:, None]).max(axis=0))).all(axis=1)
    near = near[within]
    if not len(near):
        return nothing
    least, most = np.zeros((len(chosen), len(near))), np.full((len(chosen), len(near)), np.pi)
    for mine, other in zip(a.angles[chosen].T, x.angles[near].T):
        both = mine[:, None] + other
        np.maximum(least, np.abs(mine[:, None] - other), out=least)
        np.minimum(most, np.minimum(both, 2 * np.pi - both), out=most)
    size = a.norm[chosen][:, None] * x.norm[near]
    slack = 1 + SCORE_SLACK * size
    may = np.cos(np.maximum(least - ANGLE_SLACK, 0)) * size + slack >= low[:, None]
    may &= np.cos(np.minimum(most + ANGLE_SLACK, np.pi)) * size - slack <= high[:, None]
    may &= (a.label[chosen][:, None] == x.label[near]) == same
    may &= a.row[chosen][:, None] != x.row[near]
    some = may.any(axis=0)
    near, may = near[some], may[:, some]
    exact = np.float64 if size.max(initial=0) < FLOAT_EXACT else np.int64
    scores = a.values[chosen].astype(exact) @ x.values[near].astype(exact).T
    may &= (scores >= low[:, None]) & (scores <= high[:, None])
    at, of = np.nonzero(may)
    return at, near[of], scores[at, of].astype(np.int64)


def _first(k: int, at: np.ndarray, of: np.ndarray, score: np.ndarray, x: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of every anchor: greatest score, then least id, ids that are null last."""
    order = np.lexsort((x.id[of], x.no_id[of], -score, at))
    at, of, score = at[order], of[order], score[order]
    starts = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
    rank = np.arange(len(at)) - np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
    return at[rank < k], of[rank < k], score[rank < k]


def _merged(k: int, x: _Block, old: tuple, new: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _first(k, *(np.concatenate(p) for p in zip(old, new)), x)


def _chunks(a: _Block) -> Iterator[np.ndarray]:
    """Anchors in small groups of like direction."""
    order = np.lexsort((a.angles[:, 0], a.angles.argmin(axis=1))) if a.angles.shape[1] else np.arange(len(a.row))
    for start in range(0, len(order), ANCHORS_AT_ONCE):
        yield order[start : start + ANCHORS_AT_ONCE]


def _blocks(left: pa.Table, right: pa.Table) -> tuple[_Block, _Block, list[np.ndarray]]:
    width = max(int(pc.max(pc.list_value_length(t["vector"])).as_py() or 0) for t in (left, right))
    x = _Block(right, width)
    order = np.lexsort((x.angles[:, 0], x.angles.argmin(axis=1))) if x.angles.shape[1] else np.arange(len(x.row))
    return _Block(left, width), x, [order[s : s + ROWS_AT_ONCE] for s in range(0, len(order), ROWS_AT_ONCE)]


_NONE = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)


def _find_positives(k: int):
    schema = pa.schema([("row", pa.int64()), ("other", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        a, x, parts = _blocks(left, right)
        found = []
        for chosen in _chunks(a):
            best, low = _NONE, np.full(len(chosen), -np.inf)
            for near in parts:
                best = _merged(k, x, best, _overlapping(a, chosen, x, near, low, np.full(len(chosen), np.inf), True))
                full = np.bincount(best[0], minlength=len(chosen)) >= k
                worst = np.full(len(chosen), np.inf)
                np.minimum.at(worst, best[0], best[2].astype(np.float64))
                low = np.where(full, worst, -np.inf)
            at, of, score = best
            found.append((a.row[chosen[at]], pa.array(x.id[of], mask=x.no_id[of]), score))
        rows, others, scores = zip(*found)
        return pa.table([np.concatenate(rows), pa.concat_arrays(others), np.concatenate(scores)], schema)

    return run


def _find_negatives(k: int, low_share: int, high_share: int):
    schema = pa.schema([("row", pa.int64()), ("place", pa.int32()), ("other", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        a, x, parts = _blocks(left, right)
        lengths = pc.list_value_length(left["scores"]).to_numpy()
        scores = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
        there = np.arange(scores.shape[1]) < lengths[:, None]
        scores[there] = pc.list_flatten(left["scores"]).to_numpy()
        found = []
        for chosen in _chunks(a):
            wanted, own = scores[chosen], there[chosen]
            low = np.where(own, wanted * (low_share / 100), np.inf).min(axis=1) - 1
            high = np.where(own, wanted * (high_share / 100), -np.inf).max(axis=1) + 1
            best = [_NONE] * wanted.shape[1]
            for near in parts:
                at, of, score = _overlapping(a, chosen, x, near, low, high, False)
                for j in range(wanted.shape[1]):
                    goal = wanted[at, j]
                    fits = own[at, j] & (low_share * goal <= 100 * score) & (100 * score <= high_share * goal)
                    best[j] = _merged(k, x, best[j], (at[fits], of[fits], score[fits]))
            for j, (at, of, score) in enumerate(best):
                found.append((a.row[chosen[at]], np.full(len(at), j, np.int32), pa.array(x.id[of], mask=x.no_id[of]), score))
        rows, places, others, values = zip(*found)
        return pa.table([np.concatenate(rows), np.concatenate(places), pa.concat_arrays(others), np.concatenate(values)], schema)

    return run


def _pieces(n: int, most: int, tasks: int) -> int:
    """Blocks of at most about ``most`` rows, and enough of them for the tasks that run at once."""
    return max(1, ceil(n / most), min(tasks, ceil(n / LEAST)))


def mine(
    vectors: DataFrame, anchor: Column, key: str = "id", label: str = "label", vector: str = "vector", positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, place) for the rows that ``anchor`` selects.

    A score is the inner product of the vectors' ``floor(256 * x)``.  Positives are the first other rows of the
    anchor's label (``place`` counts them from 0), negatives the first rows of another label whose score lies
    between ``low`` and ``high`` hundredths of the positive's; ties go to the smaller id, null ids last.
    Rows without a label, a vector or finite components take no part, nor do those whose scaled norm exceeds
    2^28, whose scores may not fit 64 bits.  Shorter vectors count as filled with zeros; a vector
    of zeros scores 0.  Repeated rows are rows of their own: each is a positive of the others.  A null
    ``anchor`` condition is false; an anchor without positives or negatives has no row; no rows give no rows.
    """
    spark = vectors.sparkSession
    column = F.col(f"`{vector}`")
    sample = vectors.where(usable(column, F.col(f"`{label}`"))).select(column.alias("vector")).orderBy(F.xxhash64("vector")).limit(SAMPLE).toArrow()
    rows = described(vectors, choose_references(_matrix(sample["vector"])), key, label, vector, anchor)
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    tasks = spark.sparkContext.defaultParallelism
    in_rows, in_anchors = _pieces(n, ROWS, tasks), max(1, ceil(n_anchors / ANCHORS))
    cells = min(in_rows * in_anchors, 20_000)

    def cell(side: DataFrame, own: str, pieces: int, other: str, others: int) -> DataFrame:
        """A row of one side goes to the cells of its block, one per block of the other side."""
        placed = side.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(pieces)))
        placed = placed.withColumn(other, F.explode(F.expr(f"sequence(0L, {others - 1}L)")))
        return placed.repartition(cells, "_a", "_x")

    side_x = cell(rows.drop("anchor"), "_x", in_rows, "_a", in_anchors).groupBy("_a", "_x")
    anchors = rows.where("anchor").drop("anchor")
    side_a = cell(anchors, "_a", in_anchors, "_x", in_rows).groupBy("_a", "_x")
    best = side_a.cogroup(side_x).applyInArrow(_find_positives(positives), "row bigint, other bigint, score bigint")
    place = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("other"))
    best = best.withColumn("place", F.row_number().over(place) - 1).where(F.col("place") < positives)
    of_anchor = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "other", "score"))).alias("p"))  # as many as positives
    known = materialise(anchors.join(of_anchor, "row").select(*anchors.columns, "p", F.col("p.score").alias("scores")))
    side_a = cell(known.drop("p"), "_a", in_anchors, "_x", in_rows).groupBy("_a", "_x")
    worst = side_a.cogroup(side_x).applyInArrow(_find_negatives(negatives, low, high), "row bigint, place int, other bigint, score bigint")
    place = Window.partitionBy("row", "place").orderBy(F.desc("score"), F.asc_nulls_last("other"))
    worst = worst.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= negatives)
    of = known.select("row", F.col("id").alias("anchor_id"), "p")
    positive = F.col("p")[F.col("place")]
    return worst.join(of, "row").select(
        "anchor_id", positive["other"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"),
        positive["score"].alias("positive_score"), F.col("score").alias("negative_score"), "place",
    )
