import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortspark.llm import simhash as s
from cohortspark.llm.components import connected_components


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in combinations(sorted(set(values)), 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "A b\x0bc d", "É è ß " * 30, "x " * 70_000])
def test_fingerprint_by_brute_force(text):
    assert s.fingerprint_of(text) & (2**64 - 1) == slow_fingerprint(text)


def clustered(seed, n):
    """Fingerprints around a few centres, so that buckets are full."""
    draw = random.Random(seed)
    centres = [draw.getrandbits(64) for _ in range(4)]
    out = {0, 1, 2**64 - 1}
    while len(out) < n:
        v = draw.choice(centres) if draw.random() < 0.8 else draw.getrandbits(64)
        for _ in range(draw.randrange(7)):
            v ^= 1 << draw.randrange(64)
        out.add(v)
    return sorted(signed(v) for v in out)


@pytest.mark.parametrize("most", [1_000_000, 5])
@pytest.mark.parametrize("parts", [None, 2, 3, 4, 5, 8])
def test_links_connect_what_is_near(spark, most, parts, monkeypatch):
    if parts:
        plain = s.make_plan
        monkeypatch.setattr(s, "make_plan", lambda c, n, radius: plain(c, n, radius, part_choices=range(parts, parts + 1)))
    values = clustered(parts or 0, 250)
    classes = spark.createDataFrame([(v,) for v in values], "fp bigint")
    got = s.links(classes, len(values), most_in_bucket=most).collect()
    assert all(((u ^ v) & (2**64 - 1)).bit_count() <= 3 for u, v in got)
    if most > 5:
        assert {(u, v) for u, v in got} == {(a, b) for a, b in combinations(values, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    root = slow_components(values)
    edges = spark.createDataFrame([tuple(r) for r in got] or [(0, 0)], "u bigint, v bigint")
    found = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert {v: found.get(v, v) for v in values} == root


def test_units_are_dealt_at_least_cost():
    values = np.array(clustered(5, 60), np.int64)
    bits = s._bits(values)
    plan = s.Plan(s._group_bits(bits, 4), bits.mean(axis=0), [{}] * 4, 60)
    dealt, cost = plan.deal(values)
    costs = plan.costs(values)
    assert (dealt.sum(axis=1) == 4).all()
    for i in range(len(values)):
        ways = [(a, b, c, 4 - a - b - c) for a in range(5) for b in range(5 - a) for c in range(5 - a - b)]
        assert cost[i] == pytest.approx(min(sum(costs[i, p, t] for p, t in enumerate(w)) for w in ways))


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_query_by_brute_force(spark, data, db):
    from cohortspark.llm.queries import QUERIES

    rows = db.execute("SELECT doc_id, text FROM documents").fetchall()
    prints = {d: slow_fingerprint(t) for d, t in rows}
    root = slow_components(list(prints.values()))
    least = {}
    for d, v in prints.items():
        least[root[v]] = min(d, least.get(root[v], d))
    wanted = {(d, f"{v:016x}", least[root[v]]) for d, v in prints.items()}
    assert {tuple(r) for r in QUERIES["op10_simhash_near_dedup"](spark, data).collect()} == wanted


def test_odd_tables(spark, odd_docs, no_docs):
    judged = s.near_duplicates(odd_docs).collect()
    assert len(judged) == odd_docs.count()
    empty = [r for r in judged if r["fp"] == 0]
    assert len(empty) == 4 and {r["component_id"] for r in empty} == {3}
    kept = s.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    # One of the equal rows, of those that only differ in case, and of the empty ones.
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 4, 6]
    assert s.keep_one(no_docs).count() == 0 and s.near_duplicates(no_docs).count() == 0
    assert odd_docs.select(s.hexadecimal(F.lit(-1).cast("bigint"))).first()[0] == "f" * 16
