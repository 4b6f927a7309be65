"""Running aggregates agree between the two layouts and with plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from cohortspark.operators.ordered import Running, Total, ordered_groups


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(1)
    # One key holds a third of the rows; one key is null.
    keys = ["hot"] * 100 + [None] * 30 + [f"k{i % 40}" for i in range(170)]
    return [(k, i, float(draw.randint(0, 20))) for i, k in enumerate(keys)]


def expected(rows, key_of):
    groups = {}
    for r in rows:
        groups.setdefault(key_of(r), []).append(r)
    out = {}
    for members in groups.values():
        members.sort(key=lambda r: r[1])
        values = [r[2] for r in members]
        for i, r in enumerate(members):
            out[r[1]] = (sum(values[: i + 1]), max(values[: i + 1]), min(values[i:]), sum(values), max(values))
    return out


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("limit", [None, 20])
def test_running_and_totals(spark, rows, keys, limit):
    df = spark.createDataFrame(rows, "k string, i int, v double")
    layout = ordered_groups(df, keys, ["i"], None, limit)
    assert layout.sliced == (limit is not None)
    v = F.col("v")
    done = layout.compute(
        a=Running(v), b=Running(v, "max"), c=Running(v, "min", backward=True), d=Total(v), e=Total(v, "max")
    ).frame()
    wanted = expected(rows, (lambda r: r[0]) if keys else (lambda r: 0))
    got = {r["i"]: (r["a"], r["b"], r["c"], r["d"], r["e"]) for r in done.collect()}
    assert got == wanted


def test_collapse_counts_ties_once(spark, rows):
    df = spark.createDataFrame(rows, "k string, i int, v double")
    layout = ordered_groups(df, ["k"], ["v"], {"n": F.count(F.lit(1))}, 20).compute(c=Running(F.col("n")), t=Total(F.col("n")))
    got = layout.frame().where("k = 'hot'").orderBy("v").collect()
    assert got[-1]["c"] == got[-1]["t"] == 100
    assert len({r["v"] for r in got}) == len(got)


def test_hot_group_is_spread(spark):
    df = spark.range(10_000).select(F.lit("one").alias("k"), F.col("id"))
    layout = ordered_groups(df, ["k"], ["id"], None, 1000)
    assert layout.rows.select("_slice").distinct().count() >= 4


def test_many_rows_get_more_partitions(spark, monkeypatch):
    from cohortspark.operators import ordered

    monkeypatch.setattr(ordered, "SLICE_ROWS", 100)
    df = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    layout = ordered.ordered_groups(df, ["k"], ["id"]).compute(r=Running(F.lit(1)))
    assert not layout.sliced and layout.rows.rdd.getNumPartitions() == 10
    assert layout.frame().agg(F.sum("r")).first()[0] == 50 * 210


def test_one_exchange_serves_all_tests(spark):
    from cohortspark.operators import hypothesis

    df = spark.range(400).select((F.col("id") % 4).alias("k"), (F.col("id") * 7 % 31).cast("double").alias("v"), (F.col("id") % 3 == 0).alias("g"))
    tested = hypothesis.two_group_tests(df, ["k"], "v", F.col("g"))
    plan = tested._jdf.queryExecution().executedPlan().toString()
    # Broadcasts of the kept moments aside, the rows are shuffled once.
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange rangepartitioning" not in plan
