import pytest
from pyspark.sql import functions as F

from cohortspark.llm import mixing as m


def slow_targets(sizes, share=1.5, most=2):
    """Share by weight; what is above a cap is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while rest > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += rest * weight[s] / total
        rest = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1_000, "c": 70, None: 30}, {"a": 5}, {"x": 100, "y": 0, "z": 100}, {f"s{i}": 10 + i**3 for i in range(20)}, {"a": 0}])
def test_targets_by_resharing(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    got = {r["source"]: r["target"] for r in m.targets(rows).collect()}
    assert got == pytest.approx(slow_targets(sizes))


@pytest.mark.parametrize("n", [1, 2, 3, 6, 12, 97, 1_000])
def test_permutation(spark, n):
    rows = spark.range(n).select("id", F.lit(n).cast("bigint").alias("n"), F.lit(5).cast("bigint").alias("key"))
    got = [r[0] for r in m.permuted(rows, "id", "n", "key", "image").orderBy("id").select("image").collect()]
    assert sorted(got) == list(range(n))
    if n > 90:
        assert got != sorted(got) and sum(a + 1 == b for a, b in zip(got, got[1:])) < n / 10


def test_mix_meets_its_targets(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = m.taken(docs)
    assert rows.where("taken > 2 * size OR taken < 0").count() == 0
    for r in rows.groupBy("source", "target").agg(F.sum("taken").alias("taken"), F.first("source_size").alias("size")).collect():
        assert abs(r["taken"] - r["target"]) <= m.BLOCK_WORDS / 2 + m.BLOCK_WORDS * r["target"] / r["size"]
    assert sorted(rows.collect()) == sorted(m.taken(docs.repartition(3)).collect())


def test_blocks_hold_what_is_taken(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    blocks = m.mixed(docs)
    per_source = {r[0]: r[1] for r in m.taken(docs).groupBy("source").agg(F.sum("taken")).collect()}
    assert {r[0]: r[1] for r in blocks.groupBy("source").agg(F.sum("n_words")).collect()} == per_source
    assert blocks.where(F.size(F.split("text", " ")) != F.col("n_words")).count() == 0
    assert blocks.select("slot").distinct().count() == blocks.count()
    words = {r[0]: r[1].split() for r in docs.select("doc_id", "text").collect()}
    for r in blocks.limit(50).collect():
        joined = [w for x in r["doc_ids"] for w in words[x]]
        assert set(r["text"].split()) <= set(joined)


def test_a_block_is_taken_anew_only_after_all_others(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = m.described(docs)
    goals = m.targets(rows)
    _, buckets = m.placed(rows, goals)
    times = m.slots(goals, buckets).groupBy("rank", "block").count()
    totals = buckets.groupBy("rank").agg(F.sum("blocks").alias("blocks"))
    spread = times.groupBy("rank").agg(F.min("count").alias("least"), F.max("count").alias("most"), F.count(F.lit(1)).alias("met")).join(totals, "rank")
    assert spread.where("most - (CASE WHEN met < blocks THEN 0 ELSE least END) > 1").count() == 0


def test_odd_tables(spark, odd_docs, no_docs):
    rows = m.taken(odd_docs)
    assert rows.count() == odd_docs.count() and rows.where("taken > 2 * size").count() == 0
    assert rows.where("size = 0 AND taken != 0").count() == 0
    assert m.mixed(odd_docs).agg(F.sum("n_words")).first()[0] == rows.agg(F.sum("taken")).first()[0]
    assert m.taken(no_docs).count() == 0 and m.mixed(no_docs).count() == 0
    assert m.taken(odd_docs.where("text = ''")).agg(F.sum("taken")).first()[0] == 0


def test_very_many_empty_texts_of_one_source(spark):
    full = [(i, f"w{i} " * (i % 40 + 1), "a" if i % 2 else "b") for i in range(200)]
    docs = spark.createDataFrame(full, "doc_id long, text string, source string")
    empty = spark.range(1_000, 101_000).selectExpr("id AS doc_id", "CAST(NULL AS string) AS text", "'a' AS source")
    got = {r["doc_id"]: (r["size"], r["taken"]) for r in m.taken(docs.unionByName(empty)).where("size > 0 OR taken > 0").collect()}
    assert got == {r["doc_id"]: (r["size"], r["taken"]) for r in m.taken(docs).collect()}
    # They have no place in a stream, so no window holds them.
    at, buckets = m.placed(m.described(docs.unionByName(empty)), m.targets(m.described(docs)))
    assert at.where("size = 0").agg(F.max("at"), F.max("bucket"), F.count(F.lit(1))).first()[:] == (0, 0, 100_000)
    assert buckets.agg(F.sum("blocks")).first()[0] == m.placed(m.described(docs), m.targets(m.described(docs)))[1].agg(F.sum("blocks")).first()[0]


def test_permutations_are_not_repeated_in_filters(spark, data):
    """Null filters of the joins once carried copies of both permutations: a method of 18 kB, never compiled."""
    rows = m.described(spark.read.parquet(f"{data}/documents.parquet"))
    goals = m.materialise(m.targets(rows))
    _, buckets = m.placed(rows, goals)
    dealt = m.slots(goals, buckets)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    for first, second in m.ROUNDS:
        assert plan.count(f"* {first}") == plan.count(f"* {second}") == 2
    assert dealt.where("slot IS NULL OR rank IS NULL OR block IS NULL OR block < 0").count() == 0
