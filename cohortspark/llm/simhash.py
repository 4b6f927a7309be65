"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at ``radius`` or fewer differing bits.  The bits are split into
partitions, correlated bits together.  When radius + 1 units are dealt to the partitions of a
fingerprint in any way, every fingerprint within the radius differs in fewer bits than units in
at least one partition.  So each fingerprint deals its units where they cost least, by dynamic
programming on estimated candidate counts: a partition with t units probes all values within
t - 1 bits of its own, one without any is left out.  Every candidate is verified.

How many partitions there are, which bits they hold and how units are dealt only decides the
cost; no link is lost.  These estimates rest on a bounded sample of fingerprints (``SAMPLE``).

A value that more than ``MOST_IN_BUCKET`` fingerprints share is not answered by pairs.  Its
members and probers meet at centres instead: two fingerprints at 3 bits or fewer have a centre
within 1 bit of the member and 2 of the prober, everyone at a centre is linked to its least
member, and rows grow with the members, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.components import connected_components
from cohortspark.operators.joins import lookup_join
from cohortspark.session import materialise

RADIUS, SHINGLE = 3, 3
SAMPLE = 100_000
MOST_IN_BUCKET = 2_000
PROBE_COST, CANDIDATE_COST = 1.0, 0.25
AT_ONCE = 65_536  # shingles of one text hashed at a time


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - shingle + 1)
    to = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, last, AT_ONCE):
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at : min(at + AT_ONCE, last)].tolist(), to[at : at + AT_ONCE])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > last).view(">i8")[0])


def _fingerprints(texts: pa.Array, shingle: int) -> pa.Array:
    return pa.array([fingerprint_of(t, shingle) for t in texts.to_pylist()], pa.int64())


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint of the word shingles of a text, repeats included; null counts as empty."""
    return F.arrow_udf(lambda texts: _fingerprints(texts, shingle), "bigint").asNondeterministic()(text)


def hexadecimal(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _bits(values: np.ndarray) -> np.ndarray:
    """A row of 64 bits per value, the lowest first."""
    return np.unpackbits(np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Split the bit positions into groups of even size, each grown from its most correlated bits."""
    with np.errstate(invalid="ignore", divide="ignore"):
        related = np.abs(np.nan_to_num(np.corrcoef(bits.T.astype(np.float32)))) if len(bits) > 1 else np.zeros((64, 64))
    np.fill_diagonal(related, 0)
    left, groups = list(range(64)), []
    for size in [64 // parts + (i < 64 % parts) for i in range(parts)]:
        first = max(left, key=lambda b: (related[b, left].sum(), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            best = max(left, key=lambda b: (related[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


@dataclass(frozen=True)
class Plan:
    """The partitions, and what is needed to estimate the candidates of a value."""

    groups: list[list[int]]
    set_share: np.ndarray  # of each bit
    frequent: list[dict[int, float]]  # per partition: candidates of values that are frequent in the sample
    n: int
    radius: int = RADIUS

    def values(self, fingerprints: np.ndarray) -> list[np.ndarray]:
        """The value of every partition."""
        bits = _bits(fingerprints).astype(np.int64)
        return [bits[:, g] @ (1 << np.arange(len(g), dtype=np.int64)) for g in self.groups]

    def costs(self, fingerprints: np.ndarray) -> np.ndarray:
        """Cost of every fingerprint, partition and number of units (0 to radius + 1).

        Candidates within r bits are estimated from independent bits with the measured shares,
        plus what the sample says about a value that is frequent.
        """
        bits, values = _bits(fingerprints), self.values(fingerprints)
        out = np.zeros((len(bits), len(self.groups), self.radius + 2))
        for i, group in enumerate(self.groups):
            at = np.zeros((len(bits), self.radius + 1))  # probability of a distance
            at[:, 0] = 1
            for b in group:
                differs = np.where(bits[:, b] == 1, 1 - self.set_share[b], self.set_share[b])[:, None]
                at = at * (1 - differs) + np.pad(at, ((0, 0), (1, 0)))[:, :-1] * differs
            known = self.frequent[i]
            more = np.array([known.get(v, 0.0) for v in values[i].tolist()]) if known else np.zeros(len(bits))
            within = self.n * np.cumsum(at, axis=1) + more[:, None]
            probes = np.cumsum([comb(len(group), r) for r in range(self.radius + 1)])
            out[:, i, 1:] = PROBE_COST * probes + CANDIDATE_COST * within
        return out

    def deal(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cheapest units per partition for every fingerprint, and their cost."""
        costs, units = self.costs(fingerprints), self.radius + 1
        n, parts, _ = costs.shape
        best = np.full((n, units + 1), np.inf)
        best[:, 0] = 0
        taken = np.zeros((n, parts, units + 1), np.int8)
        for i in range(parts):
            options = np.stack([np.pad(best[:, : units + 1 - t], ((0, 0), (t, 0)), constant_values=np.inf) + costs[:, i, t, None] for t in range(units + 1)])
            taken[:, i], best = options.argmin(axis=0), options.min(axis=0)
        dealt, rest, rows = np.zeros((n, parts), np.int8), np.full(n, units), np.arange(n)
        for i in reversed(range(parts)):
            dealt[:, i] = taken[rows, i, rest]
            rest = rest - dealt[:, i]
        return dealt, best[:, units]


def make_plan(classes: DataFrame, n: int, radius: int = RADIUS, sample: int = SAMPLE, part_choices: range = range(2, 9)) -> Plan:
    """Choose the partitions by the mean cost that the sample's own fingerprints would have."""
    share = min(1.0, sample / max(1, n))
    picked = classes.where(F.pmod(F.xxhash64("fp"), F.lit(1_000_000)) < int(share * 1_000_000)).select("fp")
    known = np.array([r[0] for r in picked.collect()], np.int64)
    bits = _bits(known)
    shares = bits.mean(axis=0) if len(bits) else np.full(64, 0.5)
    best: tuple[float, Plan] | None = None
    for parts in part_choices:
        plan = Plan(_group_bits(bits, parts), shares, [{}] * parts, n, radius)
        frequent = []
        for values in plan.values(known):
            found, counts = np.unique(values, return_counts=True)
            frequent.append({int(v): c / share for v, c in zip(found[counts > 2], counts[counts > 2])})
        plan = Plan(plan.groups, shares, frequent, n, radius)
        cost = parts * PROBE_COST + (float(plan.deal(known[:5_000])[1].mean()) if len(known) else 0.0)
        if best is None or cost < best[0]:
            best = cost, plan
    assert best is not None
    return best[1]


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _rows(keys: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
    key, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, owners))
    return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(owner.astype(np.int64))], ["key", "fp"])


def _masks(width: int, distance: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``distance`` bits set."""
    every = [sum(1 << b for b in bits) for r in range(distance + 1) for bits in combinations(range(width), r)]
    return np.array(every, np.uint64).view(np.int64)


def _filed(plan: Plan) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            yield _rows([v | (i << 40) for i, v in enumerate(plan.values(own))], [own] * len(plan.groups))

    return run


def _probes(plan: Plan, rows_at_once: int = 2_000) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = {(len(g), t): _masks(len(g), t - 1) for g in plan.groups for t in range(1, plan.radius + 2) if len(g) <= 32}
        for batch in batches:
            every = batch.column(0).to_numpy()
            for at in range(0, len(every), rows_at_once):
                own = every[at : at + rows_at_once]
                dealt, _ = plan.deal(own)
                keys, owners = [], []
                for i, values in enumerate(plan.values(own)):
                    for t in range(1, plan.radius + 2):
                        chosen = dealt[:, i] == t
                        if chosen.any():
                            ball = masks[len(plan.groups[i]), t]
                            keys.append((values[chosen][:, None] ^ ball).ravel() | (i << 40))
                            owners.append(np.repeat(own[chosen], len(ball)))
                yield _rows(keys, owners)

    return run


def _centres(distance: int, rows_at_once: int = 500) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = _masks(64, distance)
        for batch in batches:
            every = batch.column(0).to_numpy()
            for at in range(0, len(every), rows_at_once):
                own = every[at : at + rows_at_once]
                yield _rows([(own[:, None] ^ ball).ravel()], [np.repeat(own, len(ball))])

    return run


KEYED = "key bigint, fp bigint"


def links(classes: DataFrame, n: int, radius: int = RADIUS, most_in_bucket: int = MOST_IN_BUCKET) -> DataFrame:
    """Links (u, v) that connect all fingerprints within ``radius`` bits, ``classes`` holding each fingerprint once.

    Outside full buckets every pair is listed; at full ones a star that connects the same fingerprints.
    """
    if radius > 3:
        raise ValueError("centres are laid out for a radius of at most 3")
    plan = make_plan(classes, n, radius)
    own = classes.select("fp")
    index, probes = own.mapInArrow(_filed(plan), KEYED), own.mapInArrow(_probes(plan), KEYED)
    full = materialise(index.groupBy("key").count().where(F.col("count") > most_in_bucket).select("key"))
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= radius
    crowded = not full.isEmpty()
    few_index, few_probes = (x.join(full, "key", "left_anti") if crowded else x for x in (index, probes))
    p, x = few_probes.alias("p"), few_index.alias("x")
    # Each side finds all its partners, so it is enough that the lesser one asks.
    met = (F.col("p.key") == F.col("x.key")) & (F.col("p.fp") < F.col("x.fp")) & near(F.col("p.fp"), F.col("x.fp"))
    found = p.join(x, met).select(F.col("p.fp").alias("u"), F.col("x.fp").alias("v"))
    if not crowded:
        return found
    members = index.join(full, "key", "left_semi").select("fp").distinct().mapInArrow(_centres(1), KEYED)
    probers = probes.join(full, "key", "left_semi").select("fp").distinct().mapInArrow(_centres(2), KEYED)
    least = materialise(members.groupBy("key").agg(F.min("fp").alias("u")))
    starred = members.unionByName(probers).join(least, "key").where(near(F.col("u"), F.col("fp")) & (F.col("u") != F.col("fp")))
    return found.unionByName(starred.select("u", F.col("fp").alias("v")))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, most_in_bucket: int = MOST_IN_BUCKET,
) -> DataFrame:
    """(doc_id, fp, component_id) for every row; the component is the least id that links reach.

    Texts link when their fingerprints differ in ``radius`` bits or fewer.  Copies share a fingerprint and
    are handled as one class.  Null and empty texts have fingerprint zero and are linked like any other; a null id is never the least unless alone;
    repeated rows stay and are judged alike; an empty table gives an empty result.
    """
    marked = materialise(docs.select(F.col(key).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")))
    classes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(links(classes, classes.count(), radius, most_in_bucket))
    rooted = materialise(found.join(classes, found["node"] == classes["fp"]).select("fp", "root", "least"))
    of_root = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    linked = rooted.join(of_root, "root").select("fp", "component_id")
    every = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # Kept as a table, so that the join reads two plain exchanges and many copies can be split over tasks.
    return marked.join(materialise(every), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of every group of near-duplicates, the one with the least id, with its own columns.

    Rows with equal id and fingerprint are copies of each other; one of them stays.  Null and empty texts are copies
    of each other too, a null id stays only where its group has no other, and an empty table stays empty.
    """
    judged = materialise(near_duplicates(docs, key, text, shingle, radius))
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = judged.where(~least).select(F.col("doc_id").alias("_key"), F.col("fp").alias("_of")).distinct()
    again = materialise(judged.where(least).groupBy(F.col("doc_id").alias("_key"), F.col("fp").alias("_of")).count().where("count > 1").select("_key", "_of"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).alias("_id"), fingerprint(F.col(text), shingle).alias("_fp"))
    on = [("_id", "_key"), ("_fp", "_of")]
    stay = lookup_join(rows, gone, on, "left_anti", null_safe=True)
    if again.isEmpty():
        return stay.select("_row.*")
    single = lookup_join(stay, again, on, "left_anti", null_safe=True, kept=True)
    alike = lookup_join(stay, again, on, "left_semi", null_safe=True, kept=True).dropDuplicates(["_id", "_fp"])
    return single.unionByName(alike).select("_row.*")
