"""Boosted trees against slow growth on plain lists, and both ways of summing."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.models import boosting as b

NAMES = ["a", "b", "c"]
CUTS = [[-1.0, -0.3, 0.0, 0.4, 1.1], [-0.5, 0.0, 0.5], [0.0]]


@pytest.fixture(scope="module")
def points():
    draw = np.random.default_rng(11)
    x = draw.normal(size=(400, 3)).round(2)
    x[draw.random(x.shape) < 0.08] = np.nan
    known = np.nan_to_num(x)
    y = known[:, 0] * known[:, 1] + known[:, 2] + draw.normal(size=400) * 0.4 > 0.2
    return x, y.astype(float), draw.choice([0.5, 1.0, 2.0], 400)


@pytest.fixture(scope="module")
def frame(spark, points):
    rows = [(i, *[None if math.isnan(v) and i % 2 else float(v) for v in x], bool(y), float(w), i % 4 == 0) for i, (x, y, w) in enumerate(zip(*points))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, label boolean, w double, held boolean").repartition(3).cache()


def slow_best(x, g, h, rows, p):
    """(gain, feature, threshold, missing left, left rows, right rows) of the best split of a node, by trying all."""
    score = lambda r: (math.copysign(max(abs(sum(g[i] for i in r)) - p.reg_alpha, 0), 1) ** 2) / (sum(h[i] for i in r) + p.reg_lambda)
    found = []
    for f, cuts in enumerate(CUTS):
        for cut in [*cuts, math.inf]:
            for missing_left in (False, True):
                left = [i for i in rows if (missing_left if math.isnan(x[i][f]) else x[i][f] <= cut)]
                right = [i for i in rows if i not in set(left)]
                if not left or not right or min(len(left), len(right)) < p.min_child_rows or min(sum(h[i] for i in s) for s in (left, right)) < p.min_child_weight:
                    continue
                found.append((score(left) + score(right) - score(rows), -f, -cut, not missing_left, left, right))
    if not found:
        return None
    best = max(v[0] for v in found)
    return max((v for v in found if v[0] >= best - 1e-9), key=lambda v: v[1:4])


def slow_tree(x, g, h, p):
    """Leaves as sets of rows."""
    value = lambda r: -math.copysign(max(abs(sum(g[i] for i in r)) - p.reg_alpha, 0), sum(g[i] for i in r)) / (sum(h[i] for i in r) + p.reg_lambda)
    leaves, order, heap = {0: (list(range(len(x))), 0)}, 1, []
    push = lambda k: (s := slow_best(x, g, h, leaves[k][0], p)) and s[0] > p.gamma and (p.depth is None or leaves[k][1] < p.depth) and heapq.heappush(heap, (-s[0], k, s))
    push(0)
    while heap and (p.leaves is None or len(leaves) < p.leaves):
        _, k, s = heapq.heappop(heap)
        depth = leaves.pop(k)[1]
        for side in s[4:]:
            leaves[order] = (side, depth + 1)
            push(order)
            order += 1
    out = np.zeros(len(x))
    for rows, _ in leaves.values():
        out[rows] = value(rows)
    return out, len(leaves)


DEEP = b.Settings(trees=2, rate=0.3, depth=3, reg_lambda=1.5, reg_alpha=0.7, gamma=0.2, min_child_weight=2.0)
WIDE = b.Settings(trees=2, rate=0.2, depth=None, leaves=8, growth="leaf", reg_lambda=0.1, min_child_weight=1e-3, min_child_rows=6)


@pytest.mark.parametrize("p", [DEEP, WIDE, b.replace(WIDE, depth=3, leaves=6, loss="squared")])
@pytest.mark.parametrize("driver_bytes", [b.DRIVER_BYTES, 0])
def test_trees_equal_slow_growth(points, frame, p, driver_bytes):
    x, y, w = points
    model = b.fit(frame.withColumn("y", F.col("label").cast("double")), NAMES, "y", p, "w", cuts=CUTS, driver_bytes=driver_bytes)
    margin = np.full(len(y), model.base)
    assert model.base == pytest.approx((w * y).sum() / w.sum() if p.loss == "squared" else math.log((w * y).sum() / (w * (1 - y)).sum()))
    for tree in model.trees:
        g, h = b.slopes(y, w, margin, p.loss)
        step, n_leaves = slow_tree(x.tolist(), g.tolist(), h.tolist(), p)
        leaf = tree.leaf_of(x, False)
        assert np.array(tree.value)[leaf] == pytest.approx(step, abs=1e-9) and len(set(leaf)) == n_leaves
        margin += p.rate * step
    got = {r["id"]: r["margin"] for r in model.with_margin(frame).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(margin, abs=1e-9)


@pytest.mark.parametrize("ordered", [False, True])
def test_symmetric_trees_share_their_splits_and_both_ways_agree(frame, points, ordered):
    p = b.Settings(trees=3, rate=0.3, depth=3, growth="symmetric", reg_lambda=2.0, min_child_weight=0.0, ordered=ordered)
    models = [b.fit(frame, NAMES, "label", p, "w", cuts=CUTS, driver_bytes=n) for n in (b.DRIVER_BYTES, 0)]
    for one, other in zip(models[0].trees, models[1].trees):
        assert (one.feature, one.cut, one.missing_left) == (other.feature, other.cut, other.missing_left)
        assert one.value == pytest.approx(other.value) and len(one.left) == 15
        level = [0]
        while one.left[level[0]] >= 0:
            assert len({(one.feature[n], one.cut[n], one.missing_left[n]) for n in level}) == 1
            level = [c for n in level for c in (one.left[n], one.right[n])]


def test_ordered_margins_rest_on_earlier_rows_alone(frame):
    p = b.Settings(trees=2, rate=0.5, depth=2, growth="symmetric", reg_lambda=1.0, min_child_weight=0.0, ordered=True)
    cuts = b.quantile_cuts(frame, NAMES, 16)
    table = b.binned(frame, NAMES, "label", "w", None, cuts, 0.25, 400, p.seed)
    rows = b._Rows(table, b.replace(p, bins=17), 3, 0.25)
    held = rows.table.collect()
    x, bucket = np.array([list(r["x"]) for r in held]), np.array([r["bucket"] for r in held])
    y, w = np.array([r["y"] for r in held]), np.array([r["w"] for r in held])
    plain, ordered = np.full(400, 0.25), np.full(400, 0.25)
    for number in range(2):
        tree = b.grow(rows, cuts, number)
        rows.fresh.append(tree)
        leaf = tree.leaf_of(x, True)
        (gp, hp), (go, ho) = b.slopes(y, w, plain, p.loss), b.slopes(y, w, ordered, p.loss)
        now = np.zeros(400)
        for i in range(400):
            before = (leaf == leaf[i]) & (bucket < bucket[i])
            now[i] = -go[before].sum() / (ho[before].sum() + 1.0) if before.any() else 0.0
            assert tree.value[leaf[i]] == pytest.approx(-gp[leaf == leaf[i]].sum() / (hp[leaf == leaf[i]].sum() + 1.0))
        plain, ordered = plain + 0.5 * np.array(tree.value)[leaf], ordered + 0.5 * now
    rows.rebase()
    after = {r["u"]: (r["margin"], r["ordered"]) for r in rows.table.collect()}
    for i, r in enumerate(held):
        assert after[r["u"]] == pytest.approx((plain[i], ordered[i]))


def test_patience_cuts_off_at_the_best_tree(frame, points):
    p = b.Settings(trees=40, rate=0.8, depth=3, reg_lambda=0.1, min_child_weight=0.0)
    model = b.fit(frame, NAMES, "label", p, "w", "held", patience=5, cuts=CUTS)
    x, y, w = points
    held = np.arange(len(y)) % 4 == 0
    assert len(model.staged) < 40 and len(model.trees) == int(np.argmin(model.staged)) + 1
    margins = {r["id"]: r["margins"] for r in model.with_staged(frame).collect()}
    for k in range(len(model.trees)):
        loss = b.losses(y, np.array([margins[i][k] for i in range(len(y))]), "logistic")
        assert model.staged[k] == pytest.approx((w * loss)[held].sum() / w[held].sum())
    assert [r["margin"] for r in model.with_margin(frame).orderBy("id").collect()] == pytest.approx([margins[i][-1] for i in range(len(y))])


def test_samples_of_rows_and_columns_are_reproducible(frame):
    p = b.Settings(trees=3, depth=3, subsample=0.6, colsample_bytree=0.7, colsample_bylevel=0.5)
    one, other = (b.fit(frame, NAMES, "label", p, cuts=CUTS) for _ in range(2))
    assert [t.feature for t in one.trees] == [t.feature for t in other.trees] and one.trees[0].weight[0] < 0.75 * 100
    assert all(len(set(t.feature) - {-1}) <= 2 for t in one.trees)


def test_odd_tables(spark, frame):
    with pytest.raises(ValueError):
        b.fit(frame.limit(0), NAMES, "label")
    with pytest.raises(ValueError):
        b.fit(frame, NAMES, "label", b.Settings(bins=300))
    rows = [(1.0, None, True), (1.0, None, False), (1.0, None, None)]
    model = b.fit(spark.createDataFrame(rows, "a double, b double, label boolean"), ["a", "b"], "label", b.Settings(trees=3))
    assert len(model.trees) == 1 and model.base == pytest.approx(0) and set(model.importance.values()) == {0.0}
    again = b.Booster.from_json(b.fit(frame, NAMES, "label", b.replace(DEEP, trees=1), cuts=CUTS).to_json())
    assert again.trees[0].threshold[0] in [c for cuts in CUTS for c in cuts] and again.settings.reg_alpha == 0.7


@pytest.mark.parametrize("weight", ["w", "id"])
def test_blocks_hold_every_row(frame, points, weight):
    # Weights that are all different are kept one by one, few by a code.
    table = b.blocks(frame, NAMES, "label", weight, "held", CUTS, 400, 30)
    assert table.count() <= 2 * frame.rdd.getNumPartitions()
    rows = b._Rows(table, b.Settings(bins=6), 3, 0.25)
    got = sorted((bytes(r["x"]), r["y"], r["w"], r["held"], r["margin"], r["ordered"]) for r in rows.table.collect())
    x, y, w = points
    bins = [bytes(0 if math.isnan(v) else sum(c < v for c in cuts) + 1 for v, cuts in zip(row, CUTS)) for row in x]
    assert got == sorted((bins[i], y[i], float(i) if weight == "id" else w[i], i % 4 == 0, 0.25, 0.25) for i in range(400))
    rows.close()


def test_a_path_ends_where_a_walk_does(points):
    draw, tree, level = np.random.default_rng(3), b.Tree(), [0]
    for _ in range(4):
        f = int(draw.integers(3))
        cut = int(draw.integers(len(CUTS[f]) + 1)) + 1
        how = b.Split(1.0, f, cut, bool(draw.integers(2)), (0.0,) * 3, (0.0,) * 3)
        level = [c for n in level for c in tree.split(n, how, [*CUTS[f], math.inf][cut - 1])]
    assert tree.levels() == [0, 1, 3, 7]
    x = points[0]
    bins = np.array([[0 if math.isnan(v) else sum(c < v for c in cuts) + 1 for v, cuts in zip(row, CUTS)] for row in x], np.uint8)
    expected = []
    for row in x:
        node = 0
        while tree.left[node] >= 0:
            v = row[tree.feature[node]]
            node = (tree.left if (tree.missing_left[node] if math.isnan(v) else v <= tree.threshold[node]) else tree.right)[node]
        expected.append(node)
    assert tree.leaf_of(x, False).tolist() == tree.leaf_of(bins, True).tolist() == expected
    tree.split(tree.left[7], b.Split(1.0, 0, 1, False, (0.0,) * 3, (0.0,) * 3), -1.0)  # no longer alike on all paths
    assert tree.levels() is None


@pytest.mark.parametrize("p", [DEEP, b.Settings(trees=2, depth=4, growth="symmetric", reg_lambda=2.0, min_child_weight=0.0, ordered=True)])
def test_sums_added_by_tasks_are_those_of_the_driver(frame, monkeypatch, p):
    one = b.fit(frame, NAMES, "label", p, "w", cuts=CUTS)
    monkeypatch.setattr(b, "GATHER_BYTES", 0)
    monkeypatch.setattr(b, "PART_BYTES", 64)
    monkeypatch.setattr(b, "NODES_AT_ONCE", 1)
    other = b.fit(frame, NAMES, "label", p, "w", cuts=CUTS)
    for tree, again in zip(one.trees, other.trees):
        assert (tree.feature, tree.cut) == (again.feature, again.cut) and tree.value == pytest.approx(again.value)
