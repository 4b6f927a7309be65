"""Second-order boosted trees over binned features.

Features are cut at quantiles once; a tree then grows by passes over the binned rows.  A pass sums
gradients, hessians and rows per (node, feature, bin), and the split of a node is the cut with the
greatest gain

    T(GL)^2 / (HL + lambda) + T(GR)^2 / (HR + lambda) - T(G)^2 / (H + lambda),

where T moves a sum towards zero by ``alpha``; leaves are worth -T(G) / (H + lambda).  Of two siblings only
the one with fewer rows is summed, the other is its parent less that one.  Rows with a missing
value go to the side that gains more.

Trees grow level by level, best leaf first (the open leaf with the greatest gain splits until there are ``leaves``),
or with one split for a whole level.  Ordered boosting takes the gradient of a row from a margin to which only
rows that come before it in a permutation have contributed: positions are grouped by powers of two, and a
leaf's value for a group rests on the groups before it.

The passes read blocks: a row of the table holds tens of thousands of binned rows as packed columns, those that are
grown on apart from those held out, so a pass costs what its arithmetic costs.  Sums that fit the driver are added up there,
after tasks have added up parts of them if there are many; larger ones are an aggregation
and windows on the executors, of which the driver sees one split per node.  Margins are part of
the rows and brought up to date every ``REBASE`` trees, so a pass applies few trees.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.clean import column
from cohortspark.operators.splits import SEED
from cohortspark.session import materialise, tidy

REBASE = 10
DRIVER_BYTES = 128 * 1024 * 1024  # sums of the nodes of one level that the driver holds
GATHER_BYTES = 16 * 1024 * 1024  # sums of one pass, over all tasks, that the driver adds up itself
PART_BYTES = 256 * 1024  # sums that travel together
BLOCK_ROWS, BLOCK_BYTES = 65_536, 4 * 1024 * 1024  # binned rows that are packed together, and bytes of their bins
TASK_BYTES = 32 * 1024 * 1024  # packed rows that a task reads, unless there are tasks to spare
NODES_AT_ONCE = 32  # nodes whose gains the driver computes together
QUANTILE_ERROR = 1e-3
BUCKETS = 48  # powers of two of positions


@dataclass(frozen=True)
class Settings:
    """How trees grow.  ``growth`` is ``depth``, ``leaf`` or ``symmetric``; ``loss`` is ``logistic`` or ``squared``."""

    trees: int = 100
    rate: float = 0.3
    depth: int | None = 6
    leaves: int | None = None
    growth: str = "depth"
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    gamma: float = 0.0  # a split must gain more
    min_child_weight: float = 1.0  # sum of hessians
    min_child_rows: int = 1
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    colsample_bylevel: float = 1.0
    bins: int = 254
    loss: str = "logistic"
    ordered: bool = False
    seed: int = SEED


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    cut: int  # bins up to this one go left; bin 0 is a missing value
    missing_left: bool
    left: tuple[float, float, float]  # gradients, hessians, rows
    right: tuple[float, float, float]


@dataclass
class Tree:
    """Nodes as lists; ``left`` is -1 at a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [math.nan])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    weight: list[float] = field(default_factory=lambda: [0.0])  # sum of hessians
    gain: list[float] = field(default_factory=lambda: [0.0])
    by_bucket: list[list[float]] = field(default_factory=list)  # ordered values: leaf, bucket

    def split(self, node: int, how: Split, threshold: float) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.threshold[node] = how.feature, how.cut, threshold
        self.missing_left[node], self.gain[node] = how.missing_left, how.gain
        self.left[node], self.right[node] = len(self.left), len(self.left) + 1
        for _ in range(2):
            for values, new in ((self.feature, -1), (self.cut, 0), (self.threshold, math.nan), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.weight, 0.0), (self.gain, 0.0)):
                values.append(new)
        return self.left[node], self.right[node]

    def levels(self) -> list[int] | None:
        """The first node of every level that splits, if all nodes of a level share their split; else none."""
        left, first = self.left, []
        while left[at := 2 ** len(first) - 1] >= 0:
            level = range(at, min(2 * at + 1, len(left)))
            if any(left[n] != 2 * n + 1 or (self.feature[n], self.cut[n], self.missing_left[n]) != (self.feature[at], self.cut[at], self.missing_left[at]) for n in level):
                return None
            first.append(at)
        return first if len(left) == 2 ** (len(first) + 1) - 1 else None

    def route(self, binned: bool) -> Callable[[np.ndarray], np.ndarray]:
        """Finds the leaf of every row of an array of bins, or of values with NaN for missing."""
        feature, left, right = np.array(self.feature), np.array(self.left), np.array(self.right)
        bound, missing_left = np.array(self.cut if binned else self.threshold), np.array(self.missing_left)
        shared = self.levels()
        if shared is not None:
            splits = [(self.feature[n], bound[n].item(), self.missing_left[n]) for n in shared]

            def path(x: np.ndarray) -> np.ndarray:
                # A bit per level, whatever the nodes between.
                node = np.zeros(len(x), np.int32)
                for f, cut, to_left in splits:
                    values = x[:, f]
                    goes_right = values > cut
                    if not to_left:
                        goes_right |= values == 0 if binned else np.isnan(values)
                    node += node
                    node += goes_right
                return node + (2 ** len(splits) - 1)

            return path

        def walk(x: np.ndarray) -> np.ndarray:
            node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
            while len(rows):
                rows = rows[left[node[rows]] >= 0]
                at = node[rows]
                values = x[rows, feature[at]]
                missing = values == 0 if binned else np.isnan(values)
                goes_left = np.where(missing, missing_left[at], values <= bound[at])
                node[rows] = np.where(goes_left, left[at], right[at])
            return node

        return walk

    def changing(self) -> np.ndarray:
        """Ordered values up to the first bucket from which on they stay as they are."""
        if not self.by_bucket:
            return np.zeros((0, 0))
        table = np.array(self.by_bucket)
        same = (table[:, 1:] == table[:, :-1]).all(axis=0)
        return table[:, : 1 + len(same) - int(np.cumprod(same[::-1]).sum())]

    def leaf_of(self, x: np.ndarray, binned: bool) -> np.ndarray:
        """The leaf of every row; ``x`` holds bins, or values with NaN for missing."""
        return self.route(binned)(x)


def shrunk(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def leaf_value(g: float, h: float, p: Settings) -> float:
    return float(-shrunk(g, p.reg_alpha) / (h + p.reg_lambda)) if h + p.reg_lambda > 0 else 0.0


def _score(sums: np.ndarray, p: Settings) -> np.ndarray:
    below = sums[..., 1] + p.reg_lambda
    return np.where(below > 0, shrunk(sums[..., 0], p.reg_alpha) ** 2 / np.where(below > 0, below, 1), 0.0)


def gains(sums: np.ndarray, p: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Gain (-inf where not allowed) and left sums of every side of missing values (right first), node, feature and cut.

    ``sums`` is (nodes, features, bins, 3), bin 0 the missing values.
    """
    missing, known = sums[:, :, :1], np.cumsum(sums[:, :, 1:], axis=2)
    total = known[:, :, -1:] + missing
    left = np.stack([known, known + missing])
    right = total - left
    allowed = (left[..., 2] > 0) & (right[..., 2] > 0)
    for side in (left, right):
        allowed &= (side[..., 1] >= p.min_child_weight - 1e-12) & (side[..., 2] >= p.min_child_rows)
    return np.where(allowed, _score(left, p) + _score(right, p) - _score(total, p), -np.inf), left


def _picked(gain: np.ndarray, left: np.ndarray, total: np.ndarray, features: np.ndarray) -> Split | None:
    """The best of (side, feature, cut); ties go to the first feature, then the first cut, missing values to the right."""
    best = gain.max(initial=-np.inf)
    if not np.isfinite(best):
        return None
    near = np.argwhere(gain >= best - 1e-9 * max(1.0, abs(best)))
    side, f, cut = min(map(tuple, near.tolist()), key=lambda k: (k[1], k[2], k[0]))
    mine = left[side, f, cut]
    return Split(float(gain[side, f, cut]), int(features[f]), cut + 1, bool(side), tuple(mine.tolist()), tuple((total - mine).tolist()))


class _OnDriver:
    """Sums of the open nodes as arrays."""

    def __init__(self, p: Settings):
        self.p, self.held = p, {}

    def take(self, partial: _Parts, nodes: list[int], shape: tuple[int, ...], derived: dict[int, tuple[int, int]]) -> None:
        self.held.update(zip(nodes, partial.collect().reshape(shape)))
        for other, (parent, child) in derived.items():
            self.held[other] = self.held[parent] - self.held[child]

    def totals(self, node: int) -> tuple[float, float, float]:
        return tuple(self.held[node][0].sum(axis=0).tolist())

    def best(self, nodes: list[int], features: np.ndarray) -> dict[int, Split | None]:
        found = {}
        for node in nodes:
            sums = self.held[node][features]
            gain, left = gains(sums[None], self.p)
            found[node] = _picked(gain[:, 0], left[:, 0], sums[0].sum(axis=0), features)
        return found

    def shared(self, nodes: list[int], features: np.ndarray) -> tuple[Split | None, dict[int, tuple]]:
        """The split with the greatest sum of gains over the nodes it can split, and the left and right sums of each."""
        summed, split, lefts, totals = 0.0, False, 0.0, []
        for k in range(0, len(nodes), NODES_AT_ONCE):
            sums = np.stack([self.held[n][features] for n in nodes[k : k + NODES_AT_ONCE]])
            gain, left = gains(sums, self.p)
            finite = np.isfinite(gain)
            summed, split, lefts = summed + np.where(finite, gain, 0).sum(axis=1), split | finite.any(axis=1), lefts + left.sum(axis=1)
            totals += list(sums[:, 0].sum(axis=1))
        how = _picked(np.where(split, summed, -np.inf), lefts, np.sum(totals, axis=0), features)
        if how is None:
            return None, {}
        sides = {}
        for n, total in zip(nodes, totals):
            own = self.held[n][how.feature]
            mine = np.cumsum(own[1 : how.cut + 1], axis=0)[-1] + (own[0] if how.missing_left else 0)
            sides[n] = tuple(mine.tolist()), tuple((total - mine).tolist())
        return how, sides

    def close(self, nodes: list[int]) -> None:
        for n in nodes:
            self.held.pop(n, None)


class _OnExecutors:
    """Sums of the open nodes as a table (node, feature, bin, g, h, n); bins without rows are absent."""

    def __init__(self, p: Settings, known: dict[int, tuple], opened: set[int]):
        self.p, self.held, self.known, self.open = p, None, known, opened

    def take(self, partial: DataFrame, nodes: list[int], shape: tuple[int, ...], derived: dict[int, tuple[int, int]]) -> None:
        del nodes, shape
        rows, sums = partial, [F.sum(c).alias(c) for c in "ghn"]
        if derived:
            # A summed row counts for its node and against the sibling, which has the parent's rows.
            of = F.broadcast(partial.sparkSession.createDataFrame([(o, p, c) for o, (p, c) in derived.items()], "_other int, _parent int, _child int"))
            both = F.explode(F.array(F.struct(F.col("node"), F.lit(1.0).alias("_sign")), F.struct(F.col("_other").alias("node"), F.lit(-1.0).alias("_sign")))).alias("_to")
            rows = partial.join(of, F.col("node") == F.col("_child")).select("feature", "bin", "g", "h", "n", both)
            rows = rows.select(F.col("_to.node").alias("node"), "feature", "bin", *[(F.col(c) * F.col("_to._sign")).alias(c) for c in "ghn"])
            rows = rows.unionByName(self.held.join(of, F.col("node") == F.col("_parent")).select(F.col("_other").alias("node"), "feature", "bin", "g", "h", "n"))
        summed = rows.groupBy("node", "feature", "bin").agg(*sums).where("n > 0")
        kept = None if self.held is None or not self.open else self.held.where(F.col("node").isin(list(self.open)))
        self.held = materialise(summed if kept is None else kept.unionByName(summed))

    def totals(self, node: int) -> tuple[float, float, float]:
        if node not in self.known:
            row = self.held.where((F.col("feature") == 0) & (F.col("node") == node)).agg(*[F.sum(c) for c in "ghn"]).first()
            self.known[node] = tuple(float(v or 0) for v in row)
        return self.known[node]

    def _of(self, nodes: list[int], features: np.ndarray) -> DataFrame:
        return self.held.where(F.col("node").isin(nodes) & F.col("feature").isin(features.tolist()))

    def _gains(self, kept: DataFrame) -> DataFrame:
        """(node, feature, bin, gain, side, lg, lh, ln) for every cut and side of missing values."""
        p = self.p
        group = Window.partitionBy("node", "feature")
        before = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        for c in "ghn":
            known = F.when(F.col("bin") > 0, F.col(c)).otherwise(F.lit(0.0))
            kept = kept.withColumns({f"_k{c}": F.sum(known).over(before), f"_m{c}": F.sum(F.col(c) - known).over(group), f"_t{c}": F.sum(c).over(group)})
        sides = F.array(*[F.struct(F.lit(side).alias("side"), *[(F.col(f"_k{c}") + side * F.col(f"_m{c}")).alias(f"l{c}") for c in "ghn"]) for side in (0, 1)])
        cuts = kept.where("bin > 0").select("node", "feature", "bin", *[f"_t{c}" for c in "ghn"], F.inline(sides))
        rest = {c: F.col(f"_t{c}") - F.col(f"l{c}") for c in "ghn"}

        def score(g: Column, h: Column) -> Column:
            moved = F.greatest(F.abs(g) - p.reg_alpha, F.lit(0.0))
            return F.when(h + p.reg_lambda > 0, moved * moved / (h + p.reg_lambda)).otherwise(0.0)

        gain = score(F.col("lg"), F.col("lh")) + score(rest["g"], rest["h"]) - score(F.col("_tg"), F.col("_th"))
        allowed = (F.col("ln") > 0) & (rest["n"] > 0)
        for h, n in ((F.col("lh"), F.col("ln")), (rest["h"], rest["n"])):
            allowed &= (h >= p.min_child_weight - 1e-12) & (n >= p.min_child_rows)
        return cuts.withColumn("gain", gain).where(allowed)

    @staticmethod
    def _first(cuts: DataFrame, by: list[str]) -> DataFrame:
        """The best row per group, ties as on the driver."""
        best = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        near = cuts.withColumn("_most", F.max("gain").over(best)) if by else cuts.join(F.broadcast(cuts.agg(F.max("gain").alias("_most"))))
        near = near.where(F.col("gain") >= F.col("_most") - F.greatest(F.lit(1.0), F.abs("_most")) * 1e-9)
        order = F.struct("feature", "bin", "side")
        return near.groupBy(*by).agg(F.min_by(F.struct("gain", "feature", "bin", "side", "lg", "lh", "ln"), order).alias("s"))

    def best(self, nodes: list[int], features: np.ndarray) -> dict[int, Split | None]:
        found: dict[int, Split | None] = dict.fromkeys(nodes)
        for r in self._first(self._gains(self._of(nodes, features)), ["node"]).collect():  # a row per open node
            found[r["node"]] = self._split(r["s"], self.totals(r["node"]))
        return found

    @staticmethod
    def _split(s, total: tuple) -> Split:
        left = (s["lg"], s["lh"], float(s["ln"]))
        return Split(s["gain"], s["feature"], s["bin"], bool(s["side"]), left, tuple(t - v for t, v in zip(total, left)))

    def shared(self, nodes: list[int], features: np.ndarray) -> tuple[Split | None, dict[int, tuple]]:
        # A node without rows in a bin has the sums of the bin before: every cut is looked up in every node.
        every = self._of(nodes, features)
        grid = every.where("bin > 0").select("feature", "bin").distinct()
        grid = grid.withColumn("node", F.explode(F.array(*[F.lit(n) for n in nodes])))
        full = grid.join(every, ["node", "feature", "bin"], "left").unionByName(every.where("bin = 0")).na.fill(0.0, list("ghn"))
        cuts = materialise(self._gains(full))
        summed = cuts.groupBy("feature", "bin", "side").agg(F.sum("gain").alias("gain"), *[F.sum(f"l{c}").alias(f"l{c}") for c in "ghn"])
        row = self._first(summed, []).first()
        if row is None or row["s"] is None:
            return None, {}
        total = tuple(sum(self.totals(n)[k] for n in nodes) for k in range(3))
        how = self._split(row["s"], total)
        at = full.where((F.col("feature") == how.feature) & (F.col("bin") <= how.cut) & ((F.col("bin") > 0) | F.lit(how.missing_left)))
        left = {r[0]: tuple(map(float, r[1:])) for r in at.groupBy("node").agg(*[F.sum(c) for c in "ghn"]).collect()}  # a row per node
        sides = {n: left.get(n, (0.0, 0.0, 0.0)) for n in nodes}
        return how, {n: (a, tuple(t - v for t, v in zip(self.totals(n), a))) for n, a in sides.items()}

    def close(self, nodes: list[int]) -> None:
        """What is no longer open is left out when sums are next taken."""


def quantile_cuts(df: DataFrame, features: list[str], bins: int = 254, error: float = QUANTILE_ERROR) -> list[list[float]]:
    """Ascending cuts of every feature, one pass; at most ``bins`` - 1, missing values left out."""
    named = df.select(*[column(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    found = named.approxQuantile(named.columns, [k / bins for k in range(1, bins)], error)
    return [sorted(set(q)) for q in found]


def _uniform(u: np.ndarray, seed: int) -> np.ndarray:
    """Uniforms in [0, 1) from row numbers and a seed (splitmix)."""
    with np.errstate(over="ignore"):
        z = u.view(np.uint64) + np.uint64(seed % 2**63) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53


def slopes(y: np.ndarray, w: np.ndarray, margin: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of every row's loss."""
    if loss == "squared":
        return w * (margin - y), w.copy()
    p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
    return w * (p - y), w * np.maximum(p * (1 - p), 1e-16)


def losses(y: np.ndarray, margin: np.ndarray, loss: str) -> np.ndarray:
    return (margin - y) ** 2 if loss == "squared" else np.logaddexp(0, np.where(y > 0.5, -margin, margin))


BINNED = "x binary, y double, w double, u bigint, bucket int, held boolean, margin double, ordered double"
BLOCKS = "n int, held boolean, x binary, code binary, y binary, w binary, u binary, bucket binary, margin binary, ordered binary"
"""Packed rows: bins feature by feature; ``y`` and ``w`` hold the values that ``code`` points to, or every row's if there is no code;
margins that are not there are the base."""


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _block(now: dict[str, np.ndarray], held: bool) -> dict:
    """Rows as one block; where pairs of label and weight are few, a byte tells which it is."""
    (ys, y_at), (ws, w_at) = (np.unique(now[c], return_inverse=True) for c in "yw")
    out = {"n": len(now["y"]), "held": held, "x": now["x"].T.tobytes(), "code": b"", "y": now["y"].tobytes(), "w": now["w"].tobytes()}
    if len(ys) * len(ws) <= 256:
        out |= {"code": (y_at * len(ws) + w_at).astype(np.uint8).tobytes(), "y": np.repeat(ys, len(ws)).tobytes(), "w": np.tile(ws, len(ys)).tobytes()}
    return out | {"u": now["u"].tobytes(), "bucket": now["bucket"].astype(np.uint8).tobytes()} | {c: now[c].tobytes() if c in now else b"" for c in ("margin", "ordered")}


def _blocks(parts: Iterator[dict[str, np.ndarray]], width: int) -> Iterator[pa.RecordBatch]:
    """Arrays of rows gathered to blocks, held-out rows apart."""
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, width)))
    waiting: dict[bool, list[dict]] = {False: [], True: []}

    def out(held: bool) -> pa.RecordBatch:
        rows, waiting[held] = waiting[held], []
        block = _block({c: np.concatenate([r[c] for r in rows]) for c in rows[0]}, held)
        kinds = {"n": pa.int32(), "held": pa.bool_()}
        return pa.RecordBatch.from_arrays([pa.array([block[c]], kinds.get(c, pa.binary())) for c in _names(BLOCKS)], _names(BLOCKS))

    for part in parts:
        held = part.pop("held")
        for side in (False, True):
            if (mine := held == side).any():
                waiting[side].append({c: v[mine] for c, v in part.items()})
                if sum(len(r["y"]) for r in waiting[side]) >= most:
                    yield out(side)
    for side in (False, True):
        if waiting[side]:
            yield out(side)


def _unpacked(batch: pa.RecordBatch, k: int, width: int, base: float) -> dict[str, np.ndarray]:
    """The columns that a batch of blocks has of block ``k``, as arrays."""
    kinds, n = {"x": np.uint8, "code": np.uint8, "u": np.int64, "bucket": np.uint8}, batch.column("n")[k].as_py()
    out = {c: np.frombuffer(batch.column(c)[k].as_buffer(), kinds.get(c, np.float64)) for c in batch.schema.names if c not in ("n", "held")}
    if "held" in batch.schema.names:
        out["held"] = batch.column("held")[k].as_py()
    out["x"] = out["x"].reshape(width, n).T
    code = out.pop("code")
    for c in ("y", "w"):
        out[c] = out[c][code] if len(code) else out[c]
    return out | {c: out[c].copy() if len(out[c]) else np.full(n, base) for c in ("margin", "ordered") if c in out}


def blocks(df: DataFrame, features: list[str], label: str, weight: str | None, held: str | None, cuts: list[list[float]], n: int, seed: int) -> DataFrame:
    """Rows in the form the passes read: a byte per feature, 0 for a missing value; many rows packed in one."""
    edges = [np.array(c) for c in cuts]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for batch in batches:
            x = np.zeros((len(batch), len(edges)), np.uint8)
            for i, e in enumerate(edges):
                values = batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64)
                x[:, i] = np.where(np.isnan(values), 0, np.searchsorted(e, values, side="left") + 1)
            u = batch.column("u").to_numpy()
            place = np.log2(np.maximum(_uniform(u, seed) * n, 1)).astype(np.int32)
            yield {"x": x, "u": u, "bucket": place} | {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "held")}

    values = [column(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    y = column(label).cast("boolean").cast("double") if df.schema[label].dataType.simpleString() == "boolean" else column(label).cast("double")
    others = [y.alias("y"), (column(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.coalesce(column(held), F.lit(False)).alias("held") if held else F.lit(False).alias("held")]
    rows = df.select(*values, *others).where("y IS NOT NULL AND w IS NOT NULL")
    number = F.xxhash64(*rows.columns, F.monotonically_increasing_id())  # equal rows are drawn apart
    return rows.withColumn("u", number).mapInArrow(lambda batches: _blocks(parts(batches), len(edges)), BLOCKS)


def packed(rows: DataFrame, width: int) -> DataFrame:
    """Binned rows (``BINNED``) as blocks."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for batch in batches:
            now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _names(BINNED)[1:]}
            yield now | {"x": np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(-1, width)}

    return rows.mapInArrow(lambda batches: _blocks(parts(batches), width), BLOCKS)


def unpacked(table: DataFrame, width: int, base: float) -> DataFrame:
    """Blocks row by row (``BINNED``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                now = _unpacked(batch, k, width, base)
                now |= {"bucket": now["bucket"].astype(np.int32), "held": np.full(len(now["y"]), now["held"])}
                columns = [pa.array([r.tobytes() for r in now["x"]], pa.binary()), *[pa.array(now[c]) for c in _names(BINNED)[1:]]]
                yield pa.RecordBatch.from_arrays(columns, _names(BINNED))

    return table.mapInArrow(run, BINNED)


def binned(df: DataFrame, features: list[str], label: str, weight: str | None, held: str | None, cuts: list[list[float]], base: float, n: int, seed: int) -> DataFrame:
    """The rows of :func:`blocks` one by one."""
    return unpacked(materialise(blocks(df, features, label, weight, held, cuts, n, seed)), len(features), base)


class _Parts:
    """Sums that every task has of its rows, as rows of (part, bytes); together they have ``size`` numbers."""

    def __init__(self, table: DataFrame, size: int, tasks: int):
        self.table, self.size, self.tasks = table, size, tasks

    @staticmethod
    def of(sums: np.ndarray, step: int) -> pa.RecordBatch:
        """The sums of a task, ``step`` numbers in a part."""
        flat = np.ascontiguousarray(sums).ravel()
        cut = [flat[k : k + step].tobytes() for k in range(0, len(flat), step)]
        return pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.binary())], ["part", "sums"])

    def collect(self) -> np.ndarray:
        """The sums over all tasks; tasks add up the parts before if they are many, so that the driver gets each part once."""
        table, step = self.table, PART_BYTES // 8

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for part, blob in zip(batch.column("part").to_pylist(), batch.column("sums")):
                    more = np.frombuffer(blob.as_buffer())
                    held[part] = held[part] + more if part in held else more.copy()
            for part, sums in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["part", "sums"])

        if self.tasks * self.size * 8 > GATHER_BYTES:
            cores = table.sparkSession.sparkContext.defaultParallelism
            table = table.repartition(max(1, min(cores, -(-self.size // step))), "part").mapInArrow(added, "part int, sums binary")
        out = np.zeros(self.size)
        for part, blob in table.collect():
            more = np.frombuffer(blob)
            out[part * step : part * step + len(more)] += more
        return out


class _Rows:
    """The binned rows, as blocks, and the trees that their margins do not hold yet.  Blocks that are ``shared`` stay when these rows go."""

    def __init__(self, rows: DataFrame, p: Settings, n_features: int, base: float, shared: bool = False):
        self.p, self.width, self.base, self.fresh, self.shared = p, n_features, base, [], shared
        self.blocks = (rows if rows.columns == _names(BLOCKS) else packed(rows, n_features)).persist()
        self.tasks = self.blocks.rdd.getNumPartitions()

    @property
    def table(self) -> DataFrame:
        """The rows one by one."""
        return unpacked(self.blocks, self.width, self.base)

    def close(self) -> None:
        if not self.shared:
            self.blocks.unpersist()

    def _mapped(self, run: Callable, schema: str, columns: list[str], held: bool | None, fresh: list[Tree] | None = None) -> DataFrame:
        """What ``run`` makes of arrays of the blocks, whose margins have the steps of the trees in ``fresh``."""
        p, width, base = self.p, self.width, self.base
        steps = [(t.route(True), p.rate * np.array(t.value), p.rate * t.changing()) for t in (self.fresh if fresh is None else fresh)]

        def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
            for batch in batches:
                for k in range(len(batch)):
                    now = _unpacked(batch, k, width, base)
                    for route, value, by_bucket in steps:
                        leaf = route(now["x"])
                        if "margin" in now:
                            now["margin"] += value[leaf]
                        if "ordered" in now and by_bucket.size:
                            last = by_bucket.shape[1]
                            now["ordered"] += by_bucket.ravel()[leaf * last + np.minimum(now["bucket"], last - 1)]
                    yield now

        table = self.blocks if held is None else self.blocks.where(F.col("held") == held)
        return table.select("n", "x", "code", "y", "w", *columns).mapInArrow(lambda batches: run(arrays(batches)), schema)

    def rebase(self) -> None:
        """Bring the margins up to date."""
        width = self.width
        run = lambda rows: _blocks((now | {"held": np.full(len(now["y"]), now["held"])} for now in rows), width)
        old, shared = self.blocks, self.shared
        self.blocks, self.shared = materialise(self._mapped(run, BLOCKS, ["held", "u", "bucket", "margin", "ordered"], None)).persist(), False
        self.fresh = []
        if not shared:
            old.unpersist()

    def held_losses(self) -> np.ndarray:
        """Mean loss of the held-out rows after every tree since the margins were brought up to date."""
        p = self.p
        trees = [(t.route(True), p.rate * np.array(t.value)) for t in self.fresh]

        def run(rows: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            sums, weight = np.zeros(len(trees)), 0.0
            for now in rows:
                for k, (route, value) in enumerate(trees):
                    now["margin"] += value[route(now["x"])]
                    sums[k] += (now["w"] * losses(now["y"], now["margin"], p.loss)).sum()
                weight += now["w"].sum()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(trees)), pa.int32()), pa.array(sums), pa.array(np.full(len(trees), weight))], ["k", "loss", "w"])

        mapped = self._mapped(run, "k int, loss double, w double", ["margin"], True, [])
        summed = mapped.groupBy("k").agg((F.sum("loss") / F.sum("w")).alias("mean")).orderBy("k")
        return np.array([r["mean"] for r in summed.collect()])  # a row per tree

    def partial(self, tree: Tree, nodes: list[int], seed: int, spread: bool) -> _Parts | DataFrame:
        """Sums of the rows in ``nodes``, per task: bytes, or rows of (node, feature, bin)."""
        p, width, bins, route, step = self.p, self.width, self.p.bins + 1, tree.route(True), PART_BYTES // 8
        slot = np.full(len(tree.left), -1)
        slot[nodes] = np.arange(len(nodes))
        grad = "ordered" if p.ordered else "margin"

        def run(rows: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((3, width, len(nodes) * bins))
            for now in rows:
                at = slot[route(now["x"])]
                keep = at >= 0
                if p.subsample < 1:
                    keep &= _uniform(now["u"], seed) < p.subsample
                keep = slice(None) if keep.all() else np.flatnonzero(keep)
                g, h = slopes(now["y"][keep], now["w"][keep], now[grad][keep], p.loss)
                at = at[keep] * bins
                for f in range(width):
                    cell = at + now["x"][:, f][keep]
                    for k, values in enumerate((g, h, None)):
                        sums[k, f] += np.bincount(cell, values, minlength=sums.shape[2])
            cube = sums.reshape(3, width, len(nodes), bins).transpose(2, 1, 3, 0)
            if not spread:
                yield _Parts.of(cube, step)
                return
            s, f, b = np.nonzero(cube[..., 2])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(nodes, np.int32)[s]), pa.array(f.astype(np.int32)), pa.array(b.astype(np.int32)), *[pa.array(cube[s, f, b, k]) for k in range(3)]], ["node", "feature", "bin", "g", "h", "n"],
            )

        columns = [grad, *(["bucket"] if p.ordered else []), *(["u"] if p.subsample < 1 else [])]
        if spread:
            return self._mapped(run, "node int, feature int, bin int, g double, h double, n double", columns, False)
        return _Parts(self._mapped(run, "part int, sums binary", columns, False), 3 * width * len(nodes) * bins, self.tasks)

    def leaf_sums(self, tree: Tree, seed: int) -> np.ndarray:
        """(leaf, bucket, plain and ordered gradient and hessian) of a grown tree; its size is that of the tree."""
        p, route, leaves, step = self.p, tree.route(True), len(tree.left), PART_BYTES // 8

        def run(rows: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((leaves * BUCKETS, 4))
            for now in rows:
                cell, keep = route(now["x"]) * BUCKETS + now["bucket"], slice(None)
                if p.subsample < 1:
                    keep = np.flatnonzero(_uniform(now["u"], seed) < p.subsample)
                for k, v in enumerate([s for c in ("margin", "ordered") for s in slopes(now["y"][keep], now["w"][keep], now[c][keep], p.loss)]):
                    sums[:, k] += np.bincount(cell[keep], v, minlength=len(sums))
            yield _Parts.of(sums, step)

        columns = ["bucket", "margin", "ordered", *(["u"] if p.subsample < 1 else [])]
        summed = _Parts(self._mapped(run, "part int, sums binary", columns, False), leaves * BUCKETS * 4, self.tasks)
        return summed.collect().reshape(leaves, BUCKETS, 4)


def _share(draw: np.random.Generator, features: np.ndarray, share: float) -> np.ndarray:
    return np.sort(draw.choice(features, max(1, round(share * len(features))), replace=False)) if share < 1 else features


def grow(rows: _Rows, cuts: list[list[float]], number: int, driver_bytes: int = DRIVER_BYTES) -> Tree:
    """One tree on the current gradients."""
    p, width, bins = rows.p, rows.width, rows.p.bins + 1
    seed = p.seed * 1_000_003 + number
    draw = np.random.default_rng(seed)
    of_tree = _share(draw, np.arange(width), p.colsample_bytree)
    most_leaves = p.leaves or 2 ** min(p.depth or 30, 30)
    # A level has its own sums and, while siblings are taken from their parents, half as many more.
    spread = min(most_leaves, 2 ** max(min(p.depth or 30, 30) - 1, 0)) * width * bins * 24 > driver_bytes
    tree, known, depth, others = Tree(), {}, {0: 0}, set()
    sums: _OnDriver | _OnExecutors = _OnExecutors(p, known, others) if spread else _OnDriver(p)

    def summed(nodes: list[int], derived: dict[int, tuple[int, int]]) -> None:
        sums.take(rows.partial(tree, nodes, seed, spread), nodes, (len(nodes), width, bins, 3), derived)

    def opened(node: int, how: Split, sides: tuple | None = None) -> tuple[int, int]:
        threshold = cuts[how.feature][how.cut - 1] if how.cut <= len(cuts[how.feature]) else math.inf
        children = tree.split(node, how, threshold)
        for child, side in zip(children, sides or (how.left, how.right)):
            known[child], depth[child] = side, depth[node] + 1
        return children

    def smaller(pairs: list[tuple[int, tuple[int, int]]]) -> tuple[list[int], dict[int, tuple[int, int]]]:
        """The children to sum, and the others with their parent and the child to take away."""
        first, derived = [], {}
        for parent, (a, b) in pairs:
            few, many = (a, b) if known[a][2] <= known[b][2] else (b, a)
            first.append(few)
            derived[many] = (parent, few)
        return first, derived

    summed([0], {})
    known[0] = sums.totals(0)
    if p.growth == "leaf":
        _best_first(tree, p, sums, summed, opened, smaller, depth, of_tree, most_leaves, others)
    else:
        frontier = [0]
        while frontier and depth[frontier[0]] < (p.depth or 30):
            features = _share(draw, of_tree, p.colsample_bylevel)
            if p.growth == "symmetric":
                how, sides = sums.shared(frontier, features)
                pairs = [(n, opened(n, how, sides[n])) for n in frontier] if how and how.gain > p.gamma + 1e-12 else []
            else:
                best = sums.best(frontier, features)
                pairs = [(n, opened(n, best[n])) for n in frontier if best[n] and best[n].gain > p.gamma + 1e-12]
            closed = [n for n in frontier if n not in {q for q, _ in pairs}]
            frontier = [c for _, children in pairs for c in children]
            if frontier and depth[frontier[0]] < (p.depth or 30):
                summed(*smaller(pairs))
            sums.close([*closed, *[q for q, _ in pairs]])
    for node, (g, h, _) in known.items():
        tree.weight[node] = h
        if tree.left[node] < 0:
            tree.value[node] = leaf_value(g, h, p)
    if p.ordered:
        _order_values(tree, rows.leaf_sums(tree, seed), p)
    return tree


def _best_first(tree: Tree, p: Settings, sums, summed, opened, smaller, depth: dict[int, int], features: np.ndarray, most: int, others: set[int]) -> None:
    """Split the open leaf with the greatest gain until there are ``most`` leaves.

    A pass sums the children of all open leaves that might split; as many splits as those sums decide are
    made before the next one.
    """
    plans = sums.best([0], features)
    trial: dict[int, tuple[int, int]] = {}  # open leaf: its children, opened ahead
    n_leaves = 1

    def may(node: int) -> bool:
        return bool(plans.get(node)) and plans[node].gain > p.gamma + 1e-12 and (p.depth is None or depth[node] < p.depth)

    open_leaves = [0]
    while n_leaves < most:
        ready = sorted((n for n in open_leaves if may(n)), key=lambda n: (-plans[n].gain, n))
        if not ready:
            break
        best = ready[0]
        if best not in trial:
            # Ahead: every leaf that could be among the next splits.
            ahead = [n for n in ready[: most - n_leaves] if n not in trial]
            pairs = [(n, opened(n, plans[n])) for n in ahead]
            trial.update(pairs)
            deeper = [(n, c) for n, c in pairs if p.depth is None or depth[n] + 1 < p.depth]
            if deeper:
                others.clear()
                others.update(n for n in open_leaves if n not in trial)
                others.update(c for pair in trial.values() for c in pair if c in plans)
                summed(*smaller(deeper))
                plans.update(sums.best([c for _, pair in deeper for c in pair], features))
        open_leaves = [n for n in open_leaves if n != best] + list(trial.pop(best))
        sums.close([best])
        n_leaves += 1
    for node in trial:  # opened ahead, but never split
        tree.left[node] = tree.right[node] = tree.feature[node] = -1
        tree.gain[node] = 0.0


def _order_values(tree: Tree, sums: np.ndarray, p: Settings) -> None:
    """Leaf values from all rows, and for every bucket of positions from the buckets before it."""
    before = np.cumsum(sums, axis=1) - sums
    table = np.zeros((len(tree.left), BUCKETS))
    for node in range(len(tree.left)):
        if tree.left[node] < 0:
            g, h = sums[node, :, 0].sum(), sums[node, :, 1].sum()
            tree.value[node], tree.weight[node] = leaf_value(g, h, p), float(h)
            table[node] = [leaf_value(*before[node, b, 2:4], p) if before[node, b, 3] > 0 else 0.0 for b in range(BUCKETS)]
    tree.by_bucket = table.tolist()


@dataclass
class Booster:
    """A fitted ensemble; picks its own columns, any others may be present."""

    features: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Tree]
    settings: Settings
    staged: list[float] = field(default_factory=list)  # mean loss of the held-out rows after every tree

    def margin_of(self, x: np.ndarray, staged: bool = False) -> np.ndarray:
        """Margins of rows of values, after all trees or, as columns, after each."""
        out = np.full((len(x), len(self.trees)) if staged else len(x), self.base)
        for k, tree in enumerate(self.trees):
            step = (self.settings.rate * np.array(tree.value))[tree.leaf_of(x, False)]
            if staged:
                out[:, k:] += step[:, None]
            else:
                out += step
        return out

    def _udf(self, df: DataFrame, staged: bool) -> Column:
        shared = df.sparkSession.sparkContext.broadcast(self)  # the size of the model

        def run(*columns: pa.Array) -> pa.Array:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns]).T
            got = shared.value.margin_of(x, staged)
            if not staged:
                return pa.array(got)
            offsets = pa.array((np.arange(len(got) + 1) * got.shape[1]).astype(np.int32))
            return pa.ListArray.from_arrays(offsets, pa.array(got.ravel()))

        return F.arrow_udf(run, "array<double>" if staged else "double")(*[column(f).cast("double") for f in self.features])

    def with_margin(self, df: DataFrame, name: str = "margin") -> DataFrame:
        """All columns and the margin; null and NaN are missing values."""
        return df.withColumn(name, self._udf(df, False))

    def with_staged(self, df: DataFrame, name: str = "margins") -> DataFrame:
        """All columns and the margins after each tree, from one pass over the ensemble."""
        return df.withColumn(name, self._udf(df, True))

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Predicted value, or the probability of the positive class."""
        scored = self.with_margin(df, name)
        return scored.withColumn(name, 1 / (1 + F.exp(-F.col(name)))) if self.settings.loss == "logistic" else scored

    def first(self, trees: int) -> Booster:
        """The model cut off after some trees."""
        return replace(self, trees=self.trees[:trees])

    @property
    def importance(self) -> dict[str, float]:
        """Share of the total gain by feature."""
        total = dict.fromkeys(self.features, 0.0)
        for tree in self.trees:
            for f, left, gain in zip(tree.feature, tree.left, tree.gain):
                if left >= 0:
                    total[self.features[f]] += gain
        whole = sum(total.values())
        return {f: v / whole if whole else 0.0 for f, v in total.items()}

    def to_json(self) -> str:
        return json.dumps({**asdict(self), "trees": [asdict(replace(t, by_bucket=[])) for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Booster:
        held = json.loads(text)
        return Booster(**{**held, "trees": [Tree(**t) for t in held["trees"]], "settings": Settings(**held["settings"])})


@dataclass
class Prepared:
    """The rows of a table as blocks, for any number of fits that differ in how trees grow."""

    features: list[str]
    cuts: list[list[float]]
    base: float
    blocks: DataFrame
    bins: int
    loss: str
    seed: int


def prepare(
    df: DataFrame, features: list[str], label: str, settings: Settings = Settings(), weight: str | None = None, held: str | None = None, cuts: list[list[float]] | None = None,
) -> Prepared:
    """Cut the features and pack the rows; of the settings the bins, the loss and the seed count here."""
    if not 2 <= settings.bins <= 254:
        raise ValueError("a bin is a byte, one value of which is for missing values: 2 to 254 bins")
    used = df.where(column(label).isNotNull() & (~F.coalesce(column(held), F.lit(False)) if held else F.lit(True)))
    cuts = quantile_cuts(used, features, settings.bins) if cuts is None else [sorted(set(c)) for c in cuts]
    y, w = column(label).cast("double") if df.schema[label].dataType.simpleString() != "boolean" else column(label).cast("int"), column(weight) if weight else F.lit(1.0)
    n, total, weighted = used.agg(F.count(F.lit(1)), F.sum(w), F.sum(w * y)).first()
    if not n or not total:
        raise ValueError("there are no labelled rows to fit")
    mean = weighted / total
    base = mean if settings.loss == "squared" else math.log(min(max(mean, 1e-12), 1 - 1e-12) / (1 - min(max(mean, 1e-12), 1 - 1e-12)))
    rows = blocks(df, features, label, weight, held, cuts, n, settings.seed)
    # Packed rows are small: few tasks read them, as a tree takes a pass per level.
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n * (len(features) + 24) // TASK_BYTES))
    return Prepared(features, cuts, base, materialise(rows.coalesce(tasks)), settings.bins, settings.loss, settings.seed)


def fit(
    df: DataFrame, features: list[str], label: str, settings: Settings = Settings(), weight: str | None = None, held: str | None = None, patience: int | None = None,
    cuts: list[list[float]] | None = None, driver_bytes: int = DRIVER_BYTES,
) -> Booster:
    """Boost trees on the rows of ``df`` whose ``held`` column is not true.

    With ``patience`` the loss of the held rows is followed after every tree; growth stops once it has not
    improved for so many trees, and the model is cut off after the best one.  Rows without a label or a weight take no part.
    """
    return boost(prepare(df, features, label, settings, weight, held, cuts), settings, patience if held else None, driver_bytes)


def boost(ready: Prepared, settings: Settings, patience: int | None = None, driver_bytes: int = DRIVER_BYTES, shared: bool = False) -> Booster:
    """Boost trees on prepared rows, with ``patience`` as in :func:`fit`; rows that are ``shared`` stay cached for the next fit."""
    if (settings.bins, settings.loss, settings.seed) != (ready.bins, ready.loss, ready.seed):
        raise ValueError("the rows were prepared for other bins, another loss or another seed")
    features, cuts, base = ready.features, ready.cuts, ready.base
    p = replace(settings, bins=max(2, max(len(c) for c in cuts) + 1))
    rows = _Rows(ready.blocks, p, len(features), base, shared)
    trees: list[Tree] = []
    staged: list[float] = []
    best = 0
    try:
        for number in range(p.trees):
            trees.append(grow(rows, cuts, number, driver_bytes))
            rows.fresh.append(trees[-1])
            if len(trees[-1].left) == 1 and p.subsample == p.colsample_bytree == p.colsample_bylevel == 1 and not trees[-1].value[0]:
                break
            if len(rows.fresh) == REBASE or number == p.trees - 1:
                if patience is not None:
                    staged += rows.held_losses().tolist()
                    best = int(np.argmin(staged))
                    if len(staged) - 1 - best >= patience:
                        break
                if number < p.trees - 1:
                    rows.rebase()
            tidy(ready.blocks.sparkSession)
    finally:
        rows.close()
    model = Booster(features, cuts, base, trees, p, staged)
    return model.first(best + 1) if patience is not None and staged else model
