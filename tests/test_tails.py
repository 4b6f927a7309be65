"""Tail probabilities against known constants and full enumeration."""

import math
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.functions import numeric, tails


def test_student_constants():
    t = np.array([0.3, 2.0, 12.7, 300.0])
    # Closed forms for one, two and four degrees of freedom.
    assert tails.student_two_sided(t, np.full(4, 1.0)) == pytest.approx(list(2 * np.arctan2(1, t) / math.pi), rel=1e-12)
    assert tails.student_two_sided(t, np.full(4, 2.0)) == pytest.approx(list(1 - t / np.sqrt(2 + t * t)), rel=1e-9)
    s = t / np.sqrt(4 + t * t)
    assert tails.student_two_sided(t[:3], np.full(3, 4.0)) == pytest.approx(list((1 - 1.5 * s + 0.5 * s**3)[:3]), rel=1e-9)
    assert tails.student_two_sided(np.array([2.228138852]), np.array([10.0]))[0] == pytest.approx(0.05, abs=1e-10)
    assert list(tails.student_two_sided(np.array([0.0, np.inf]), np.array([5.0, 3.0]))) == [1, 0]
    # The normal form takes over smoothly.
    near = tails.student_two_sided(np.array([2.0, 2.0]), np.array([tails.LARGE_DF, tails.LARGE_DF * 1.001]))
    assert near[0] == pytest.approx(near[1], rel=1e-8)


def test_one_sample_ks_constants():
    assert 1 - tails.ks_one_sample_tail(0.274, 10) == pytest.approx(0.6284796154565, abs=1e-12)
    assert 1 - tails.ks_one_sample_tail(0.04, 2000) == pytest.approx(0.99676943191713, abs=1e-8)
    assert tails.ks_one_sample_tail(0.75, 1) == pytest.approx(0.5)
    assert tails.ks_one_sample_tail(1.0, 5) == 0 and tails.ks_one_sample_tail(0.05, 5) == 1


@pytest.mark.parametrize("n", [140, 141, 1000, 5000])
def test_ks_methods_agree_at_their_borders(n):
    for d in np.linspace(0.4, 1.6, 13) / math.sqrt(n):
        exact = 1 - tails._matrix_ks_cdf(n, d)
        assert tails.ks_one_sample_tail(d, n) == pytest.approx(exact, abs=4e-6 if n < 1000 else 2e-7)


def enumerate_ks(n1, n2, height):
    hit = total = 0
    for chosen in combinations(range(n1 + n2), n1):
        i = j = top = 0
        for k in range(n1 + n2):
            if k in chosen:
                i += 1
            else:
                j += 1
            top = max(top, abs(i * n2 - j * n1))
        total += 1
        hit += top >= height
    return hit / total


@pytest.mark.parametrize("n1,n2,height", [(3, 3, 9), (5, 7, 10), (6, 6, 12), (4, 9, 12), (7, 5, 35), (8, 4, 16)])
def test_two_sample_ks_by_enumeration(n1, n2, height):
    assert tails.ks_two_sample_tail(height / (n1 * n2), n1, n2) == pytest.approx(enumerate_ks(n1, n2, height), abs=1e-12)


@pytest.mark.parametrize("u,n1,n2", [(9, 3, 3), (0, 3, 3), (13, 8, 6), (20, 8, 6), (30, 5, 7)])
def test_rank_sum_by_enumeration(u, n1, n2):
    sums = [sum(c) - n1 * (n1 + 1) / 2 for c in combinations(range(1, n1 + n2 + 1), n1)]
    top = max(u, n1 * n2 - u)
    assert tails.rank_sum_exact_tail(u, n1, n2) == pytest.approx(min(1, 2 * np.mean(np.array(sums) >= top)))


def test_hypergeometric():
    direct = sum(math.comb(5, i) * math.comb(15, 4 - i) for i in range(2, 5)) / math.comb(20, 4)
    assert tails.hypergeometric_tail(2, 5, 4, 20) == pytest.approx(direct)
    assert tails.hypergeometric_tail(0, 5, 4, 20) == 1


def test_erfc_expression(spark):
    xs = [-30.0, -7.0, -4.0, -1.2, -0.46875, 0.0, 0.1, 0.46875, 0.5, 1.0, 3.99, 4.0, 4.01, 10.0, 26.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", numeric.erfc("x").alias("y")).collect()
    assert all(r["y"] == pytest.approx(math.erfc(r["x"]), rel=1e-14, abs=1e-300) for r in got)


def test_finite_and_logs(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    got = df.select(numeric.is_finite(F.col("x")).alias("f"), numeric.log_if_positive(F.col("x"), 10).alias("l")).collect()
    assert [r["f"] for r in got] == [True, True, True, False, False, False]
    assert got[0]["l"] == 0 and got[1]["l"] is None and got[2]["l"] is None


def test_normal_cdf_expression(spark):
    xs = [x / 16 for x in range(-160, 161)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", numeric.normal_cdf("x").alias("y")).collect()
    assert all(abs(r["y"] - 0.5 * math.erfc(-r["x"] / math.sqrt(2))) < 1e-12 for r in got)


@pytest.mark.parametrize("n1,n2", [(1, 5), (3, 7), (8, 12), (8, 1_000), (2, 60_000)])
def test_rank_sum_tail_by_integers(n1, n2):
    size = n1 * n2 + 1
    ways = [1] + [0] * (size - 1)
    for i in range(1, n1 + 1):  # whole numbers, so nothing is lost
        for u in range(size - 1, n2 + i - 1, -1):
            ways[u] -= ways[u - n2 - i]
        for u in range(i, size):
            ways[u] += ways[u - i]
    total = math.comb(n1 + n2, n1)
    assert sum(ways) == total
    for u in sorted({0, 1, 2, n2 // 2, n2, n1 * n2 // 4, n1 * n2 // 2, n1 * n2, min(n2 + 1, n1 * n2)}):
        low = min(u, n1 * n2 - u)
        exact = min(1.0, float(Fraction(2 * sum(ways[: low + 1]), total)))
        assert tails.rank_sum_exact_tail(u, n1, n2) == pytest.approx(exact, rel=1e-9)


@pytest.mark.parametrize("d", [0.004, 0.006, 0.01])
def test_one_sided_sum_and_expansion_meet(d):
    n = 200_000
    assert tails._one_sided_ks(n, d) == pytest.approx(math.exp(-((6 * n * d + 1) ** 2) / (18 * n)), rel=2e-3)


@pytest.mark.parametrize("d", [0.0016, 0.0024])
def test_matrix_and_expansion_meet(d):
    n = 100_000
    assert tails._matrix_ks_cdf(n, d) == pytest.approx(tails._expansion_ks_cdf(n, d), abs=1e-6)
