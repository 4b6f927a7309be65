"""Single boosted trees against the same growth written in SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from cohortspark.models import boosting
from cohortspark.models.boosting import Settings
from cohortspark.plans.registry import query
from cohortspark.plans.stand_ins import complete_subject, with_tables

FEATURES = ["qty", "price", "disc", "tax"]
CUTS = {
    "qty": [20.0 * k for k in range(1, 14)], "price": [30_000.0 * k for k in range(1, 13)], "disc": [0.01 * k for k in range(1, 10)], "tax": [0.01 * k for k in range(1, 8)],
}
RATE = 0.3


def _grown_sql(p: Settings, trees: int, trained: str = "TRUE", weighted: bool = False, features: list[str] = FEATURES) -> tuple[list[str], list[str]]:
    """Growth on ln(idx) or the label, leaf by leaf, level by level or with shared splits.

    Returns common table expressions and a selection per split and leaf.  ``t<k>`` has a row per subject with its margin ``m`` after k trees and
    ``tr``, whether it was trained on; with ``weighted`` positives count for as much as negatives.
    """
    cuts = ", ".join(f"({f}, {c}, {CUTS[name][c]!r})" for f, name in enumerate(features) for c in range(len(CUTS[name])))
    shrunk = lambda g: f"(greatest(abs({g}) - {p.reg_alpha}, 0) * sign({g}))"
    score = lambda g, h: f"({shrunk(g)} ** 2 / ({h} + {p.reg_lambda}))"
    slopes = "w * (m - y) AS g, w AS h" if p.loss == "squared" else "w * (1 / (1 + exp(-m)) - y) AS g, w / (1 + exp(-m)) * (1 - 1 / (1 + exp(-m))) AS h"
    y, base = ("ln(idx)", "y") if p.loss == "squared" else ("label::int::double", "ln(y / (1 - y))")
    weight = "CASE WHEN y > 0.5 THEN (SELECT count(*) FILTER (y < 0.5) / count(*) FILTER (y > 0.5) FROM data WHERE tr) ELSE 1.0 END" if weighted else "1.0"
    parts = [
        f"cuts AS (SELECT f, c, cut::double AS cut FROM (VALUES {cuts}) v(f, c, cut))",
        f"data AS (SELECT id, {y} AS y, {trained} AS tr, [{', '.join(f'{f}::double' for f in features)}] AS x FROM complete_subject)",
        f"weighed AS (SELECT *, {weight} AS w FROM data)",
        f"t0 AS (SELECT id, y, tr, w, x, (SELECT {base} FROM (SELECT sum(w * y) / sum(w) AS y FROM weighed WHERE tr)) AS m FROM weighed)",
    ]
    found = []
    steps = (p.leaves or 2) - 1 if p.growth == "leaf" else p.depth
    for t in range(trees):
        parts.append(f"n{t}_0 AS (SELECT id, tr, x, {slopes}, '' AS node FROM t{t})")
        for k in range(steps):
            now, name = f"n{t}_{k}", f"{t}_{k}"
            partition = "" if p.growth in ("leaf", "symmetric") else "PARTITION BY node"
            gain = f"{score('gl', 'hl')} + {score('(gt - gl)', '(ht - hl)')} - {score('gt', 'ht')}"
            level = f"AND length(node) = {k}" if p.growth != "leaf" else ""
            parts += [
                f"""e{name} AS (SELECT node, f, c, cut, sum(g) FILTER (x[f + 1] <= cut) AS gl, sum(h) FILTER (x[f + 1] <= cut) AS hl, sum(g) AS gt, sum(h) AS ht,
                    count(*) FILTER (x[f + 1] <= cut) AS nl, count(*) AS nt FROM {now}, cuts WHERE tr {level} GROUP BY ALL)""",
                f"""g{name} AS (SELECT *, {gain} AS gain FROM e{name} WHERE nl >= {p.min_child_rows} AND nt - nl >= {p.min_child_rows}
                    AND hl >= {p.min_child_weight} AND ht - hl >= {p.min_child_weight})""",
            ]
            if p.growth == "symmetric":
                parts.append(f"s{name} AS (SELECT f, cut, gain FROM (SELECT f, c, cut, sum(gain) AS gain FROM g{name} GROUP BY ALL) ORDER BY round(gain, 7) DESC, f, c LIMIT 1)")
                parts.append(f"b{name} AS (SELECT DISTINCT node, s.f, s.cut, s.gain FROM s{name} s, {now} WHERE length(node) = {k})")
            else:
                parts.append(f"b{name} AS (SELECT node, f, cut, gain FROM g{name} WHERE gain > {p.gamma} QUALIFY row_number() OVER ({partition} ORDER BY round(gain, 7) DESC, f, c) = 1)")
            moved = "CASE WHEN b.node IS NULL THEN n.node WHEN x[b.f + 1] <= b.cut THEN n.node || 'L' ELSE n.node || 'R' END"
            parts.append(f"n{t}_{k + 1} AS (SELECT id, tr, x, g, h, {moved} AS node FROM {now} n LEFT JOIN b{name} b ON n.node = b.node)")
            found.append(f"SELECT {t} AS tree, node AS path, f::int AS feature, cut AS threshold, gain, NULL::double AS value, NULL::double AS weight FROM b{name}")
        last = f"n{t}_{steps}"
        parts.append(f"v{t} AS (SELECT node, -{shrunk('sum(g)')} / (sum(h) + {p.reg_lambda}) AS value, sum(h) AS weight FROM {last} WHERE tr GROUP BY node)")
        parts.append(f"t{t + 1} AS (SELECT id, r.y, r.tr, r.w, r.x, m + {p.rate} * value AS m FROM t{t} r JOIN {last} n USING (id) JOIN v{t} v USING (node))")
        found.append(f"SELECT {t}, node, NULL, NULL, NULL, value, weight FROM v{t}")
    return parts, found


def _tree_sql(p: Settings, trees: int) -> str:
    parts, found = _grown_sql(p, trees)
    every = " UNION ALL ".join(found)
    return f"WITH {', '.join(parts)} SELECT tree::int AS tree, path, feature, threshold, round(gain, 4) AS gain, round(value, 8) AS value, round(weight, 4) AS weight FROM ({every})"


def scores_sql(p: Settings, trained: str, select: str, features: list[str] = FEATURES) -> str:
    """A selection from ``scores`` (id, y, tr, p), the probabilities of boosted trees that weigh the classes and are trained on some of
    the rows, and ``used`` (feature, gain), the features that split."""
    parts, found = _grown_sql(p, p.trees, trained, True, features)
    made = [f"scores AS (SELECT id, y, tr, 1 / (1 + exp(-m)) AS p FROM t{p.trees})", f"used AS (SELECT feature, sum(gain) AS gain FROM ({' UNION ALL '.join(found)}) WHERE feature IS NOT NULL GROUP BY feature)"]
    return f"WITH {', '.join([*parts, *made])} {select}"


def _tree_rows(spark, model: boosting.Booster):
    """A row per node of a model: splits with their gain, leaves with their value."""
    rows = []
    for t, tree in enumerate(model.trees):
        stack = [(0, "")]
        while stack:
            node, path = stack.pop()
            if tree.left[node] < 0 and not tree.weight[node]:
                continue  # a shared split may leave a node without rows on one side
            if tree.left[node] < 0:
                rows.append((t, path, None, None, None, tree.value[node], tree.weight[node]))
            else:
                rows.append((t, path, tree.feature[node], tree.threshold[node], tree.gain[node], None, None))
                stack += [(tree.left[node], f"{path}L"), (tree.right[node], f"{path}R")]
    table = spark.createDataFrame(rows, "tree int, path string, feature int, threshold double, gain double, value double, weight double")
    return table.select("tree", "path", "feature", "threshold", F.round("gain", 4).alias("gain"), F.round("value", 8).alias("value"), F.round("weight", 4).alias("weight"))


LEVEL = Settings(trees=2, rate=RATE, depth=3, reg_lambda=1.5, reg_alpha=2.0, gamma=0.5, min_child_weight=3.0)
LEAF = Settings(trees=2, rate=RATE, depth=None, leaves=7, growth="leaf", reg_lambda=0.5, min_child_weight=1e-3, min_child_rows=20)
SYMMETRIC = Settings(trees=2, rate=RATE, depth=2, growth="symmetric", reg_lambda=3.0, min_child_weight=0.0, loss="squared")


def _grown(spark, sf_dir, p: Settings):
    rows = complete_subject(spark, sf_dir).select("label", F.log("idx").alias("y"), *FEATURES)
    return _tree_rows(spark, boosting.fit(rows, FEATURES, "y" if p.loss == "squared" else "label", p, cuts=[CUTS[f] for f in FEATURES]))


@query(with_tables("complete_subject", _tree_sql(LEVEL, 2)))
def boosted_level_trees(spark, sf_dir):
    """Two trees grown level by level with penalties on leaf values: every split, gain and leaf."""
    return _grown(spark, sf_dir, LEVEL)


@query(with_tables("complete_subject", _tree_sql(LEAF, 2)))
def boosted_leafwise_trees(spark, sf_dir):
    """Two trees whose best leaf splits first, up to seven leaves."""
    return _grown(spark, sf_dir, LEAF)


@query(with_tables("complete_subject", _tree_sql(SYMMETRIC, 2)))
def boosted_symmetric_trees(spark, sf_dir):
    """Two trees with one split per level, on the logarithm of the index."""
    return _grown(spark, sf_dir, SYMMETRIC)
