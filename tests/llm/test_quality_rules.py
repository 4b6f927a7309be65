import random
from collections import Counter
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import quality_rules as q


def slow_repeats(words, window=5):
    grams = Counter(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    hit = {i + k for i in range(len(words) - window + 1) if grams[tuple(words[i : i + window])] > 1 for k in range(window)}
    return len(hit)


def test_repeated_words_by_brute_force():
    draw = random.Random(1)
    for n in [0, 1, 4, 5, 6, 9, 10, 11, 40, 200]:
        for alphabet in (1, 2, 3, 8):
            words = [bytes([97 + draw.randrange(alphabet)]) for _ in range(n)]
            assert q.repeated_words(words) == slow_repeats(words)


def test_statistics_of_odd_texts():
    assert q.statistics_of(None) == q.statistics_of("") == (0,) * 8
    text = "Ab  cd\n\n é#|\x0bx!\nAb  cd\n \nAb  cd"
    words, chars, symbols, dup, lines, repeats, upper, marks = q.statistics_of(text)
    assert (words, chars, symbols, dup, lines, repeats, upper, marks) == (8, 17, 2, 2, 4, 0, 3, 1)


@pytest.mark.parametrize("n,p", [(1, 0.5), (17, 0.01), (300, 0.008), (300, 0.6)])
def test_binomial_tail_is_exact(n, p):
    exact = Fraction(p)
    total = Fraction(0)
    for k in range(n + 1):
        total += comb(n, k) * exact**k * (1 - exact) ** (n - k)
        assert q.binomial_tail(k, n, p) == pytest.approx(float(total), rel=1e-9, abs=1e-15)


def labelled(spark, good, bad, stratum="s"):
    """Rows with a share of symbols in thousandths of 1,000 words, and a label."""
    kind = "struct<" + ",".join(f"{s}:bigint" for s in q.STATISTICS) + ">"
    rows = [(stratum, g, (1000, 4000, x, 0, 10, 0, 0, 0)) for g, values in ((1, good), (0, bad)) for x in values]
    return spark.createDataFrame(rows, f"_stratum string, _good int, _stats {kind}")


def test_cutoff_is_certified_or_absent(spark):
    enough = labelled(spark, [0] * 900 + [40], [600] * 50 + [60] * 50)
    few = labelled(spark, [0] * 40, [600] * 50, "few")
    cutoffs = {r["_stratum"]: r for r in q.fit_cutoffs(enough.unionByName(few)).collect()}
    assert cutoffs["few"]["symbols"] is None  # 40 good ones cannot refute anything
    assert cutoffs["s"]["symbols"] == 50  # all bad ones go, no good one does
    assert cutoffs["s"]["marks"] is None  # nothing to gain


def test_no_more_good_ones_go_than_allowed(spark):
    draw = random.Random(3)
    good = [draw.choice([0, 0, 0, 0, 500]) for _ in range(2_000)]  # a fifth of the good ones look bad
    cutoffs = q.fit_cutoffs(labelled(spark, good, [500] * 2_000)).first()
    assert cutoffs["symbols"] is None


def test_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "doc_id bigint, quality int")
    kept = q.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    # Twelve different words pass; the long text repeats itself and the rest is too short.
    assert sorted(r[0] for r in kept.collect()) == [1, 1, 2, 7]
    assert q.keep_good(no_docs, labels).count() == 0
    assert q.keep_good(odd_docs, labels.limit(0)).count() == 4


def test_query_keeps_what_the_rules_say(spark, data):
    from cohortspark.llm.queries import QUERIES

    rows = QUERIES["op3_quality_rules"](spark, data)
    assert rows.where("base_failed AND kept").count() == 0 and rows.where(F.col("kept").isNull()).count() == 0
