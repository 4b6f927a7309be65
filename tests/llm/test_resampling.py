import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import resampling as r


@pytest.mark.parametrize("few", [3, 10_000])
def test_kth_greatest_by_sorting(spark, few):
    draw = random.Random(1)
    values = [draw.choice([draw.gauss(0, 1), 0.25, 1e9]) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "k double")
    for k in (1, 2, 100, 250, 499, 500):
        assert r.kth_greatest(rows, "k", k, few) == sorted(values, reverse=True)[k - 1]
    assert r.kth_greatest(rows, "k", 0) is None and r.kth_greatest(rows, "k", 501) is None


def test_draw_prefers_target_texts(spark, data):
    from cohortspark.llm.queries import QUERIES

    larger = data.replace("sf0.001", "sf0.1")
    drawn = QUERIES["op7_importance_resampling"](spark, larger).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id")
    by = {x[0]: x[1] for x in drawn.groupBy("quality").agg(F.avg(F.col("drawn").cast("int"))).collect()}
    assert by[1] > by[0] + 0.2


def test_noise_is_gumbel(spark):
    noise = [x[0] for x in spark.range(20_000).select(r.gumbel(F.col("id"))).collect()]
    assert sum(noise) / len(noise) == pytest.approx(0.5772, abs=0.03)


def test_odd_tables(spark, odd_docs, no_docs):
    targets = spark.createDataFrame([(1,), (1,), (None,)], "doc_id bigint")
    rows = r.resample(odd_docs, targets, 0.5)
    assert rows.count() == odd_docs.count() and rows.where("drawn IS NULL OR log_weight IS NULL").count() == 0
    assert r.resample(odd_docs, targets.limit(0), 0.5).where("log_weight != 0").count() == 0
    assert r.resample(odd_docs, targets, 0.0).where("drawn").count() == 0 and r.resample(odd_docs, targets, 1.0).where("NOT drawn").count() == 0
    assert r.resample(no_docs, targets, 0.5).count() == 0


def slow_buckets(text):
    """The bucket of every four bytes of a text, one after another."""
    plain = (text or "").encode()
    return [(int.from_bytes(plain[i : i + 4], "little") * 0x9E3779B97F4A7C15 % 2**64 >> 40) % 65_536 for i in range(len(plain) - 3)]


def test_query_by_brute_force(spark, data, db):
    from cohortspark.llm.queries import QUERIES

    rows = db.execute("SELECT doc_id, text FROM documents").fetchall()
    good = {r[0] for r in db.execute("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
    share = db.execute("SELECT avg(quality) FROM labels WHERE quality IS NOT NULL").fetchone()[0]
    raw, target = Counter(), Counter()
    for d, text in rows:
        raw.update(own := slow_buckets(text))
        target.update(own if d in good else [])
    n_raw, n_target = sum(raw.values()) + 65_536, sum(target.values()) + 65_536
    ratio = {b: math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in raw}
    weight = {d: 400 * sum(ratio[b] for b in own) / len(own) if (own := slow_buckets(t)) else 0.0 for d, t in rows}
    docs = spark.read.parquet(f"{data}/documents.parquet")
    noise = {r[0]: r[1] for r in docs.select("doc_id", r.gumbel(F.col("doc_id").cast("string"), F.xxhash64("text"))).collect()}
    order = sorted(weight, key=lambda d: -(weight[d] + noise[d]))
    drawn = set(order[: round(share * len(rows))])
    got = {x["doc_id"]: x for x in QUERIES["op7_importance_resampling"](spark, data).collect()}
    assert got.keys() == weight.keys() and 0 < len(drawn) < len(rows)
    for d, x in got.items():
        assert x["log_weight"] == pytest.approx(weight[d], rel=1e-9, abs=1e-9) and x["drawn"] == (d in drawn)
