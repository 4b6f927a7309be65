import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import merkle as m

SCHEMA = "doc_id bigint, source string, text string, leaf string, root string, proof string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_tree(leaves, arity):
    """Root, and the siblings of every leaf by level."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // arity * arity : i // arity * arity + arity]
            proofs[k].append(("".join(run[: i % arity]), "".join(run[i % arity + 1 :])))
        at = [i // arity for i in at]
        level = [sha(*level[i : i + arity]) for i in range(0, len(level), arity)]
    return level[0], proofs


def slow_leaf(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def slow_manifest(rows, arity=3):
    groups = {}
    for doc_id, source, text in rows:
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, slow_leaf(doc_id, source, text), doc_id))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: slow_tree([r[2] for r in sorted(groups[s])], arity) for s in order}
    root, above = slow_tree([trees[s][0] for s in order], arity)
    out = []
    for s, more in zip(order, above):
        for (_, _, leaf, doc_id), proof in zip(sorted(groups[s]), trees[s][1]):
            out.append((doc_id, s, leaf, trees[s][0], root, proof + more))
    return sorted(out, key=str)


def manifest(spark, rows, **options):
    df = spark.createDataFrame([(*r, "l", "r", "p") for r in rows], SCHEMA).repartition(3)
    got = m.manifest(df, m.leaf_of(F.col("doc_id"), F.col("source"), F.col("text")), "doc_id", "source", **options)
    return sorted(((r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in got.collect()), key=str)


def rows_of(sizes, seed=1):
    draw = random.Random(seed)
    sources = [None, "", "a", "ab", "b", "é", "z\U0001f600", "￿"]
    out = [(draw.randrange(10_000) - 50, s, f"t\n{i}ä" if i % 3 else None) for s, n in zip(sources, sizes) for i in range(n)]
    draw.shuffle(out)
    return out


# One stretch, several rounds of stretches of three and nine leaves, two children, four.
@pytest.mark.parametrize("arity, levels", [(3, 6), (3, 1), (3, 2), (2, 2), (4, 3)])
def test_equals_slow_tree(spark, arity, levels):
    rows = rows_of([1, 2, 3, 4, 10, 28, 82, 5])
    assert manifest(spark, rows, arity=arity, levels=levels) == slow_manifest(rows, arity)


def test_odd_rows(spark):
    rows = [(None, None, None), (None, "a", ""), (None, "a", None), (1, "a", "x"), (1, "a", "x"), (1, "a", "y"), (2, "", "w" * 200_000)]
    assert manifest(spark, rows) == slow_manifest(rows)
    assert manifest(spark, [(5, "a", "alone")]) == slow_manifest([(5, "a", "alone")])
    assert manifest(spark, []) == []


def test_large_groups_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(m, "ROWS_IN_TASK", 100)
    rows = rows_of([1_500, 3, 700])
    assert manifest(spark, rows, levels=3) == slow_manifest(rows)


def test_only_the_right_leaf_folds_to_the_root(spark):
    rows = rows_of([7, 1, 30])
    df = spark.createDataFrame([(*r, "l", "r", "p") for r in rows], SCHEMA)
    leaf = m.leaf_of(F.col("doc_id"), F.col("source"), F.col("text"))
    got = m.manifest(df, leaf, "doc_id", "source", {"other": m.leaf_of(F.col("doc_id"), F.col("source"), F.lit("forged"))})
    right, wrong = got.agg(F.count_if(m.fold(F.col("leaf"), F.col("proof")) == F.col("root")), F.count_if(m.fold(F.col("other"), F.col("proof")) == F.col("root"))).first()
    assert (right, wrong) == (38, 0)
