import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import hard_negatives as h

SCHEMA = "id bigint, label bigint, vector array<float>, score string, row string, norm string"


def brute(rows, anchors, positives=5, negatives=3, low=50, high=95):
    """Rows (id, label, vector); by definition, one pair at a time."""
    kept = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    ints = [[math.floor(256 * float(np.float32(x))) for x in r[2]] for r in kept]
    score = lambda i, j: sum(a * b for a, b in zip(ints[i], ints[j]))
    order = lambda i: lambda j: (-score(i, j), kept[j][0] is None, kept[j][0] or 0)
    out = []
    for i, (own, label, _) in enumerate(kept):
        if own is None or not anchors(own):
            continue
        others = [j for j in range(len(kept)) if j != i]
        for p in sorted((j for j in others if kept[j][1] == label), key=order(i))[:positives]:
            s = score(i, p)
            fits = sorted((j for j in others if kept[j][1] != label and low * s <= 100 * score(i, j) <= high * s), key=order(i))
            out += [(own, kept[p][0], rank, kept[n][0], s, score(i, n)) for rank, n in enumerate(fits[:negatives], 1)]
    return sorted(out, key=str)


def mined(spark, rows, every=3, **options):
    df = spark.createDataFrame([(*r, "s", "r", "n") for r in rows], SCHEMA).repartition(3)
    got = h.mine(df, F.col("id") % every == 0, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(map(tuple, got.collect()), key=str)


def clustered(n, seed, width=12):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(4, width))
    for i in range(n):
        x = centres[draw.integers(4)] + draw.normal(size=width) * draw.choice([0.05, 0.6])
        yield i, int(draw.integers(3)), [float(v) for v in (x * draw.choice([0.1, 1.0]))]


ODD = [
    (None, 1, [0.5] * 12), (None, 1, [0.5] * 12), (900, None, [0.1] * 12), (901, 1, None), (902, 1, [0.1, None] + [0.2] * 10), (903, 1, [float("nan")] * 12),
    (904, 1, [float("inf")] * 12), (905, 1, []), (906, 2, [0.0] * 12), (907, 2, [1.0, 2.0]), (3, 0, [0.25] * 12), (3, 0, [0.25] * 12), (3, 1, [0.25] * 12), (909, 1, [3e38] * 12),
]


@pytest.mark.parametrize("blocks", [(16_384, 16_384, 1_024), (40, 15, 20)])
def test_equals_brute_force_on_odd_rows(spark, monkeypatch, blocks):
    for name, value in zip(("ROWS", "ANCHORS", "LEAST"), blocks):
        monkeypatch.setattr(h, name, value)
    rows = list(clustered(150, 1)) + ODD
    wanted = brute([r for r in rows if r[0] != 909], lambda i: i % 3 == 0)  # 909's scores do not fit
    assert len(wanted) > 100 and mined(spark, rows) == wanted


def test_few_at_once_and_other_shares(spark, monkeypatch):
    monkeypatch.setattr(h, "ANCHORS_AT_ONCE", 3)
    monkeypatch.setattr(h, "ROWS_AT_ONCE", 7)
    rows = list(clustered(120, 2))
    wanted = brute(rows, lambda i: i % 4 == 0, 2, 4, -20, 100)
    assert mined(spark, rows, 4, positives=2, negatives=4, low=-20, high=100) == wanted


def test_one_label_and_no_rows(spark):
    rows = [(i, 1, [float(i), 1.0]) for i in range(12)]
    assert mined(spark, rows) == [] and mined(spark, [(0, 1, [1.0])]) == [] and mined(spark, []) == []


def test_windows_hold_every_score_and_close_on_clusters():
    draw = random.Random(3)
    vectors = np.array([v for _, _, v in clustered(400, 4)])
    values = h.scaled(vectors)
    norms = np.linalg.norm(values, axis=1)
    angles = h._angles(values, norms, h.choose_references(vectors)).astype(np.float32).astype(float)
    least = np.abs(angles[:, None] - angles[None]).max(axis=2)
    most = np.minimum(angles[:, None] + angles[None], 2 * np.pi - angles[:, None] - angles[None]).min(axis=2)
    size, scores = norms[:, None] * norms, values @ values.T
    slack = 1 + h.SCORE_SLACK * size
    high = np.cos(np.maximum(least - h.ANGLE_SLACK, 0)) * size + slack
    low = np.cos(np.minimum(most + h.ANGLE_SLACK, np.pi)) * size - slack
    assert (scores <= high).all() and (scores >= low).all()
    assert (high < 0.5 * norms.max() ** 2).mean() > 0.2 and draw  # rows that no anchor has to score


def test_large_components_are_exact(spark):
    rows = [(i, i % 2, [1e5 + i, -9e4 - 3 * i, 0.004 * i]) for i in range(20)]
    assert mined(spark, rows, high=100) == brute(rows, lambda i: i % 3 == 0, high=100)


def test_scores_below_zero_are_not_cut_off_by_long_rows():
    # Anchors that wait for scores below zero, rows of very different lengths, and chunks of every make-up.
    draw = np.random.default_rng(7)
    vectors = draw.normal(size=(240, 6)) * np.repeat([0.02, 1.0, 30.0], 80)[:, None]
    block = h._Block.__new__(h._Block)
    block.values = h.scaled(vectors)
    block.norm, block.row, block.label = np.linalg.norm(block.values, axis=1), np.arange(240), np.zeros(240, np.int64)
    block.angles = h._angles(block.values, block.norm, h.choose_references(vectors)).astype(np.float32).astype(float)
    scores = block.values @ block.values.T
    for n in [1] * 200 + [9] * 40:
        chosen, near = draw.choice(240, n, replace=False), draw.choice(240, 60, replace=False)
        low = np.repeat(draw.choice([-1e5, -300.0, -1.0, 0.0, 0.5, 40.0, 1e4]), n) * draw.choice([1.0, 2.0], n)
        high = low + draw.choice([1.0, 1e3, np.inf], n)
        at, of, got = h._overlapping(block, chosen, block, near, low, high, True)
        wanted = {(i, j, int(scores[c, j])) for i, c in enumerate(chosen) for j in near if c != j and low[i] <= scores[c, j] <= high[i]}
        assert set(zip(at.tolist(), of.tolist(), got.tolist())) == wanted
