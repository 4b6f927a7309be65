"""Quality by importance resampling.

Two generative models of hashed byte n-grams are counted, one over target texts and one over all
raw texts.  The log ratio of the two is the importance weight of a text, taken per n-gram and
scaled to ``LENGTH`` n-grams so that long texts are not judged by their length.  Adding Gumbel noise
that is a hash of the row and keeping the k greatest sums is a draw of k texts without replacement in
proportion to their weights.  The border is found from counts in ever smaller intervals, never by a
sort of all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.joins import lookup_join
from cohortspark.session import materialise

GRAM, BUCKETS, LENGTH = 4, 65_536, 400.0
INTERVALS, FEW = 1_024, 10_000
AT_ONCE = 1 << 20  # bytes of a text hashed at a time


def buckets_of(text: str | None, gram: int = GRAM, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Hashed n-grams of the bytes of a text, a bounded piece at a time."""
    plain = (text or "").encode()
    for at in range(0, max(0, len(plain) - gram + 1), AT_ONCE):
        part = plain[at : at + AT_ONCE + gram - 1]
        eight = np.ndarray((len(part) - gram + 1,), "<u8", buffer=part + b"\0" * 8, strides=(1,))
        own = eight & np.uint64((1 << (8 * gram)) - 1)
        yield ((own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)  # raw and target
    for batch in batches:
        for text, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for found in buckets_of(text):
                n = np.bincount(found, minlength=BUCKETS)
                counts[0] += n
                if target:
                    counts[1] += n
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(counts[0]), pa.array(counts[1])], ["bucket", "raw", "target"])


def fit(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Log ratio of target to raw probability of every bucket, each with one added to its counts.

    ``targets`` lists the ids of target texts.  Without any, all texts weigh the same.
    """
    wanted = targets.select(F.col(key).alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("target", F.lit(True))
    rows = lookup_join(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), wanted, ["doc_id"])
    marked = rows.select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = marked.mapInArrow(_count, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    held = {c: x.to_numpy() for c, x in zip(counts.columns, counts.toArrow().columns)}  # a row per bucket
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    raw[held["bucket"]] += held["raw"]
    target[held["bucket"]] += held["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum()) if target.sum() > BUCKETS else np.zeros(BUCKETS)


def _weights(ratios: np.ndarray, length: float) -> Callable[[pa.Array], pa.Array]:
    def weigh(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            total, n = 0.0, 0
            for found in buckets_of(text):
                total, n = total + float(ratios[found].sum()), n + len(found)
            out.append(length * total / n if n else 0.0)
        return pa.array(out, pa.float64())

    return weigh


def log_weight(text: Column, ratios: np.ndarray, length: float = LENGTH) -> Column:
    """Log importance weight of a text; texts shorter than an n-gram, empty and null ones weigh 0."""
    return F.arrow_udf(_weights(ratios, length), "double").asNondeterministic()(text)


def gumbel(*row: Column, seed: int = 0) -> Column:
    """Gumbel noise that depends on the seed and the row alone."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *row), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_greatest(rows: DataFrame, key: str, k: int, few: int = FEW) -> float | None:
    """The k-th greatest value of a column, exactly; null if there are fewer rows."""
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if k < 1 or n < k:
        return None
    inside, above = rows.where(F.col(key).isNotNull()), 0  # rows above the interval
    while n > few and low < high:
        width = (high - low) / INTERVALS
        place = F.least(F.floor((F.col(key) - low) / width), F.lit(INTERVALS - 1)).alias("place")
        counts = inside.groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy(F.desc("place")).collect()
        for r in counts:
            if above + r["n"] >= k:
                break
            above += r["n"]
        low, high, n = r["low"], r["high"], r["n"]
        inside = rows.where((F.col(key) >= low) & (F.col(key) <= high))
    if low == high:
        return low
    values = sorted((r[0] for r in inside.select(key).collect()), reverse=True)
    return values[k - above - 1]


def resample(docs: DataFrame, targets: DataFrame, share: float, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """(doc_id, log_weight, drawn) for every row; ``share`` of the rows are drawn.

    Equal rows have equal noise, so all of them are drawn or none, even at the border.
    An empty table gives an empty result.
    """
    ratios = fit(docs, targets, key, text)
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("digest"), log_weight(F.col(text), ratios).alias("log_weight"))
    keyed = materialise(rows.withColumn("_key", F.col("log_weight") + gumbel(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("digest"), seed=seed)))
    border = kth_greatest(keyed, "_key", round(share * keyed.count()))
    drawn = F.lit(False) if border is None else F.col("_key") >= border
    return keyed.select("doc_id", "log_weight", drawn.alias("drawn"))
