import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortspark.llm import ppm as p


def slow_model(texts):
    """Counts of every byte after every context of up to four bytes."""
    counts = defaultdict(Counter)
    for text in texts:
        plain = p.FILL + (text or "").encode() + b"\xff"
        for i in range(p.ORDER, len(plain)):
            for j in range(p.ORDER + 1):
                counts[plain[i - j : i]][plain[i]] += 1
    return counts


def slow_score(counts, text):
    plain, total = p.FILL + (text or "").encode() + b"\xff", 0.0
    for i in range(p.ORDER, len(plain)):
        chance, out = 1.0, set()
        for j in reversed(range(p.ORDER + 1)):
            seen = {s: c for s, c in counts.get(plain[i - j : i], {}).items() if s not in out}
            n, d = sum(seen.values()), len(seen)
            if plain[i] in seen:
                chance *= seen[plain[i]] / (n + d)
                break
            if d:
                chance *= d / (n + d)
                out |= set(seen)
        else:
            chance /= 256 - len(out)
        total += math.log10(chance)
    return total


TEXTS = ["abracadabra", "", None, "the cat the hat the bat", "ünï", "aaaaaaaaab", "cadabra the cat " * 20]


def test_scores_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(p, "PIECE", 64)
    model = p.train(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    counts = slow_model(TEXTS)
    draw = random.Random(0)
    for text in [*TEXTS, "zebra", "\U0001f600", "".join(draw.choice("abcdrt h") for _ in range(300))]:
        total = sum(float(model.log10(p.grams(group)[0]).astype(float).sum()) for group in p.pieces([text]))
        assert total == pytest.approx(slow_score(counts, text), rel=1e-5)


def test_kept_contexts_are_closed(spark):
    model = p.train(spark.createDataFrame([(t,) for t in TEXTS], "text string"), contexts=40)
    assert len(model.logs) == 40
    chances = 10.0 ** model.logs.astype(float)
    unseen = (model.column == len(set(model.column.tolist())) - 1).sum()
    assert chances[:, :-1].sum(axis=1) + chances[:, -1] * unseen == pytest.approx(np.ones(40), rel=1e-4)


def test_query_by_brute_force(spark, data, db):
    from zlib import crc32

    from cohortspark.llm.queries import QUERIES

    rows = db.execute("SELECT doc_id, text FROM documents").fetchall()
    learned = [t for d, t in rows if crc32(str(d).encode()) % 5 != 1]
    words = Counter(w for t in learned for w in (t or "").encode().lower().split())
    n, v = sum(words.values()) + len(learned), len(words) + 1
    counts = slow_model(learned)
    got = {r["doc_id"]: r for r in QUERIES["op4_ppm_scoring"](spark, data).collect()}
    assert len(got) == len(rows)
    for d, text in rows:
        own, r = (text or "").encode().lower().split(), got[d]
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own) + math.log10((len(learned) + 0.5) / (n + 0.5 * (v + 1)))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc32(str(d).encode()) % 5 == 1, len(own) + 1, sum(w in words for w in own) + 1, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(slow_score(counts, text), rel=1e-5)
    size = {d: len((t or "").encode()) + 1 for d, t in rows}
    assert sum(r["score"] for r in got.values() if r["held_out"]) > -sum(size[d] for d, r in got.items() if r["held_out"])  # under 3.4 bits a byte


def test_odd_tables(spark, odd_docs, no_docs):
    rows = p.score(odd_docs, head=3).collect()
    assert len(rows) == odd_docs.count()
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 5)} == {1}
    assert len({(r["score"], r["base_score"]) for r in rows if r["doc_id"] == 1}) == 1
    assert p.score(no_docs).count() == 0
    untrained = p.score(odd_docs, training=odd_docs["doc_id"].isNull() & odd_docs["doc_id"].isNotNull()).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in untrained)


@pytest.mark.parametrize("head", [1, 40])
def test_a_small_head_changes_no_score(spark, head):
    held = ["zebra the cat", "\U0001f600 hat bat", "cadabra abrab ünïx the cat the hot"]
    docs = spark.createDataFrame(list(enumerate([*TEXTS, *held])), "doc_id bigint, text string")
    counts = slow_model(TEXTS)
    got = {r["doc_id"]: r["score"] for r in p.score(docs, training=docs["doc_id"] < len(TEXTS), contexts=head).collect()}
    assert got == {i: pytest.approx(slow_score(counts, t), rel=1e-5) for i, t in enumerate([*TEXTS, *held])}
