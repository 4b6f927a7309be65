import math
import string
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import toxicity as t


def test_classifier_recovers_the_positives():
    draw = np.random.default_rng(0)
    truth = draw.random(4_000) < 0.2
    x = (draw.random((4_000, 30)) < 0.05).astype(np.float32)
    x[truth, :3] = (draw.random((truth.sum(), 3)) < 0.8).astype(np.float32)
    x[~truth, :3] = 0
    positive = x[truth][:300]
    w = t.fit_classifier(positive, x, 0.2, 1)
    found = x @ w[:-1] + w[-1] > 0
    told = x[:, :3].any(axis=1)
    assert (found == told).mean() > 0.98 and (w[:-1] >= 0).all()


def test_held_out_texts_are_told_apart(spark, data):
    from cohortspark.llm.queries import QUERIES

    larger = data.replace("sf0.001", "sf0.1")
    scored = QUERIES["op1_toxicity"](spark, larger)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{larger}/labels.parquet").where("toxic IS NOT NULL")
    held = scored.where("held_out").join(labels, "doc_id")
    right, n, caught, toxic = held.agg(
        F.count_if(F.col("predicted") == F.col("toxic")), F.count(F.lit(1)), F.count_if((F.col("predicted") == 1) & (F.col("toxic") == 1)), F.count_if(F.col("toxic") == 1),
    ).first()
    # Measured at this size, with some 350 confirmed examples: 807 of 825 right, 87 of 97 toxic ones caught.
    assert right / n > 0.96 and caught / toxic > 0.85
    low, high, rows = scored.agg(F.min("score"), F.max("score"), F.count("score")).first()
    assert 0 <= low <= high <= 1 and rows == spark.read.parquet(f"{larger}/documents.parquet").count()


def test_labels_of_the_held_out_fold_do_not_matter(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{x}.parquet") for x in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(t.fold(F.col("doc_id"), t.FOLDS) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = t.fit(docs, labels), t.fit(docs, turned)
    assert one.listed == other.listed and np.array_equal(one.weights, other.weights)


def test_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "doc_id bigint, toxic int")
    assert t.keep_harmless(odd_docs, labels).columns == odd_docs.columns
    assert t.keep_harmless(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert t.keep_harmless(no_docs, labels).count() == 0
    model = t.fit(odd_docs, labels)
    assert odd_docs.select(t.score(F.col("text"), model).alias("p")).where("p BETWEEN 0 AND 1").count() == odd_docs.count()


def test_all_telling_features_are_kept(spark):
    # More telling words than the former bounds let through, and 25,000 common words that were ahead of them.
    common = " ".join(f"c{i}x{i}" for i in range(25_000))
    telling = [f"{i:05d}t" for i in range(1_500)]
    toxic = [common + " " + " ".join(telling)] * 5 + [common]
    rows = spark.createDataFrame([(x, 1) for x in toxic] + [(common, 0)] * 60, "text string, toxic int")
    listed = t.choose_features(rows.where("toxic = 1").select("text"), rows.select("text"))
    assert {f for w in telling for f in t.word_features(w.encode())} <= set(listed)
    assert not set(listed) & {t.word_features(f"c{i}x{i}".encode())[0] for i in range(1_000)}


def test_sparse_rows_multiply_like_dense_ones():
    draw = np.random.default_rng(1)
    x = (draw.random((50, 9)) < 0.3).astype(np.float32)
    s = t._sparse([(np.flatnonzero(r).tolist(),) for r in x], 9)
    picked, w, v = draw.integers(0, 50, 70), draw.random(9), draw.random(70)
    assert np.allclose(s[picked] @ w, x[picked] @ w, rtol=1e-5) and np.allclose(v @ s[picked], v @ x[picked], rtol=1e-5)


def slow_features(text):
    """The features of a text by name: every word, and its first four and five bytes."""
    found = set()
    for word in (text or "").encode().lower().split():
        core = word.strip(string.punctuation.encode())
        found |= {b"w" + core, b"4" + core[:4], b"5" + core[:5]} if core else {b"w" + word}
    return {crc32(f) for f in found}


def test_features_and_scores_by_brute_force(spark, data):
    larger = data.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{larger}/{x}.parquet") for x in ("documents", "labels"))
    rows, known = docs.select("doc_id", "text").collect(), labels.where("toxic IS NOT NULL").select("doc_id", "toxic").collect()
    learned = [(d, slow_features(t)) for d, t in rows if crc32(str(d).encode()) % 5]
    bad = {d for d, toxic in known if toxic == 1 and crc32(str(d).encode()) % 5}
    in_all, in_toxic = Counter(f for _, own in learned for f in own), Counter(f for d, own in learned if d in bad for f in own)
    n_all, n_toxic = len(learned), sum(d in bad for d, _ in learned)
    wanted = set()
    for f, n in in_toxic.items():
        expected = (in_all[f] + 1) / (n_all + 2)
        if n >= 5 and (n / n_toxic - expected) / math.sqrt(expected * (1 - expected) / n_toxic) > 4:
            wanted.add(f)
    model = t.fit(docs, labels)
    assert set(model.listed) == wanted and len(wanted) > 3
    labelled = [toxic for d, toxic in known if crc32(str(d).encode()) % 5]
    assert model.prior == pytest.approx(sum(labelled) / len(labelled))
    mean = model.weights.mean(axis=0)
    got = {r["doc_id"]: r["p"] for r in docs.select("doc_id", t.score(F.col("text"), model).alias("p")).collect()}
    for d, text in rows:
        logit = mean[-1] + sum(mean[model.listed[f]] for f in slow_features(text) & wanted)
        assert got[d] == pytest.approx(1 / (1 + math.exp(-logit)), rel=1e-5)
