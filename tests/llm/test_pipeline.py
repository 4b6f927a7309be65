"""Every stage against its operator and a plain count, on the smallest tables."""

import pytest

import corpus_pipeline as c
from cohortspark.llm import mixing, simhash, toxicity
from cohortspark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def steps(spark, data, tmp_path_factory):
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in c.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, data).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_filters_follow_their_verdicts(spark, data, steps):
    (_, raw, good), (_, _, harmless), (_, _, single), (_, _, clean), _ = steps
    labels = spark.read.parquet(f"{data}/labels.parquet")
    assert all(x.columns == raw.columns for x in (good, harmless, single, clean))
    assert ids(good) == ids(QUERIES["op3_quality_rules"](spark, data).where("kept"))
    model = toxicity.fit(good, labels)
    assert ids(harmless) == ids(good.where(toxicity.score(good["text"], model) < 0.5))
    least = {}
    judged = simhash.near_duplicates(harmless).collect()
    for r in judged:
        least.setdefault(r["component_id"], []).append(r["doc_id"])
    assert ids(single) == sorted(min(v) for v in least.values())


def test_decontamination_and_mix(spark, data, db, steps):
    from cohortspark.llm.corpus_queries import HITS_SQL

    _, _, (_, _, single), (_, _, clean), (_, _, mixed) = steps
    dirty = {r[0] for r in db.execute(f"SELECT doc_id FROM ({HITS_SQL}) WHERE contaminated").fetchall()}
    assert ids(clean) == [i for i in ids(single) if i not in dirty]
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(clean).collect()}
    assert mixed.selectExpr("sum(n_words)").first()[0] == sum(taken.values())
    assert {i for r in mixed.select("doc_ids").collect() for i in r[0]} == {i for i, n in taken.items() if n}


def test_run_gives_the_last_stage(spark, data, steps):
    assert sorted(c.run(spark, data).collect()) == sorted(steps[-1][2].collect())


def test_stages_take_odd_tables(spark, data, odd_docs, no_docs):
    # Ten words or more and little repeated (4 repeats itself); then one of each group of copies.
    left = {"quality_rules": [1, 1, 2, 7], "toxicity": [1, 1, 2, 3, 3, 4, 5, 6, 7, None, None], "simhash_near_dedup": [1, 3, 4, 6, None], "decontamination": [1, 1, 2, 3, 3, 4, 5, 6, 7, None, None]}
    for name, stage in c.STAGES:
        assert stage(spark, no_docs, data).count() == 0
        done = stage(spark, odd_docs, data)
        if name in left:
            assert sorted((r[0] for r in done.select("doc_id").collect()), key=lambda i: (i is None, i)) == left[name], name
            assert done.columns == odd_docs.columns
        else:
            words = sum(len((r["text"] or "").replace("\x0b", " ").split()) for r in odd_docs.collect())
            assert 0 < done.selectExpr("sum(n_words)").first()[0] <= 2 * words
