import pytest
from pyspark.sql import functions as F

from cohortspark.llm import rollups as r

ROWS = "source string, lang string, tokenizer_version string, n_tokens bigint"


def totals(rollup):
    return {(x["source"], x["lang"], x["tokenizer_version"]): (x["n_docs"], x["n_tokens"]) for x in rollup.totals().collect()}


def test_batches_count_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", "v1", 5), ("a", "en", "v1", 7), (None, None, "v1", 0), ("b", "de", "v1", None)], ROWS)
    rollup = r.Rollup(spark, f"file://{tmp_path}/r")
    assert totals(rollup) == {}
    assert rollup.commit("one", r.inserts(rows))
    first = {("a", "en", "v1"): (2, 12), (None, None, "v1"): (1, 0), ("b", "de", "v1"): (1, None)}
    assert {k: v[0] for k, v in totals(rollup).items()} == {k: v[0] for k, v in first.items()}
    assert not rollup.commit("one", r.inserts(rows))
    gone, old, new = (rows.where(F.col("n_tokens") == n) for n in (5, 7, 7))
    assert rollup.commit("two", r.deletes(gone).unionByName(r.revisions(old, new.withColumns({"tokenizer_version": F.lit("v2"), "n_tokens": F.lit(9).cast("bigint")}))))
    assert totals(rollup)["a", "en", "v2"] == (1, 9) and ("a", "en", "v1") not in totals(rollup)
    before = totals(rollup)
    rollup.compact()
    assert totals(rollup) == before and not rollup.commit("two", r.inserts(rows))
    assert rollup.commit("three", r.deletes(new.withColumns({"tokenizer_version": F.lit("v2"), "n_tokens": F.lit(9).cast("bigint")})))
    assert ("a", "en", "v2") not in totals(rollup)
    rollup.compact()
    assert rollup.committed() == {"one", "two", "three"} and len(totals(rollup)) == 2


def test_an_interrupted_commit_does_not_count(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", "v1", 5)], ROWS)
    rollup = r.Rollup(spark, f"file://{tmp_path}/r")
    r.inserts(rows).write.parquet(f"file://{tmp_path}/r/pending/half/totals")
    assert totals(rollup) == {} and rollup.commit("half", r.inserts(rows)) and totals(rollup) == {("a", "en", "v1"): (1, 5)}


def test_odd_batches(spark, odd_docs, no_docs, tmp_path):
    rollup = r.Rollup(spark, f"file://{tmp_path}/r")
    counted = lambda docs: docs.select("source", "lang", F.lit("v").alias("tokenizer_version"), r.token_count(F.col("text"), "spaced-1").alias("n_tokens"))
    assert rollup.commit("empty", r.inserts(counted(no_docs))) and rollup.commit("odd", r.inserts(counted(odd_docs)))
    assert sum(n for n, _ in totals(rollup).values()) == odd_docs.count()
    with pytest.raises(ValueError):
        rollup.commit("../up", r.inserts(counted(no_docs)))
