"""URL rules by a sort-merge range join.

A rule is a host and the start of a path.  Its canonical key is the reversed host, a slash and the
path, so the keys under a rule are one interval of the key order: all that start with the rule's
key.  A url asks once for every suffix of its host, with that suffix's key.

Rules and asked keys are sorted together by a range exchange.  Intervals of prefixes are nested or
apart, so a sweep needs a stack of the open ones; with rules of depth d (lying inside d others) the
stack's d-th place always holds the last rule of that depth, and it is open if the key starts
with it.  The sweep is a window over each range, with the places that earlier ranges left behind
carried in.  Only DataFrame functions are used, and no range holds more than its share of keys:
ties are cut by the url, and equal urls are asked once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.text import lower_ascii
from cohortspark.operators.joins import lookup_join
from cohortspark.session import materialise


def host_of(url: Column) -> Column:
    """The lower-case host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without one."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def canonical_rules(rules: DataFrame) -> DataFrame:
    """(key, rule, host, labels, verdict, depth) of rules given as host, path and verdict.

    Equal rules become one, which blocks if any of them does.  ``depth`` is the number of other
    rules whose key starts this one's.  Rules without a host are dropped.
    """
    known = rules.select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host != ''")
    labels = F.split("host", r"\.")
    known = known.withColumn("key", F.concat(reversed_host(labels), F.lit("/"), "path")).withColumn("labels", F.size(labels))
    one = known.groupBy("key").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.first("labels").alias("labels"), F.max("verdict").alias("verdict"))
    one = materialise(one.withColumn("rule", F.concat("host", "path")))
    inner = one.where(F.length("key") > 1).select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key") - 1), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("start"))
    depths = inner.join(one.select(F.col("key").alias("start")), "start").groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("depth"))
    return one.join(depths, "key", "left").select("key", "rule", "host", "labels", "verdict", F.coalesce("depth", F.lit(0)).alias("depth"))


def longest_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict) for every url that a rule fits; ``urls`` holds each url once, as ``url``.

    The longest rule wins, of equal ones the one with the longer host.
    """
    known = materialise(canonical_rules(rules))
    deepest, most_labels = known.agg(F.max("depth"), F.max("labels")).first()
    if deepest is None:
        return urls.select("url", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).limit(0)
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(most_labels))),
        lambda n: F.concat(reversed_host(F.slice("labels", F.size("labels") - n + 1, n)), F.lit("/"), F.col("path")),
    )
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host != ''").withColumn("labels", labels)
    asked = parts.select(F.explode(suffixes).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("depth"), "url")
    opened = known.select("key", F.lit(0).alias("kind"), "depth", F.lit(None).cast("string").alias("url"))
    ranges = asked.unionByName(opened).repartitionByRange("key", "kind", "url").withColumn("range", F.spark_partition_id())
    ranges = materialise(ranges)

    places = range(deepest + 1)
    last = [F.max(F.when((F.col("kind") == 0) & (F.col("depth") == d), F.col("key"))).alias(f"left_{d}") for d in places]
    by_range = ranges.groupBy("range").agg(*last)  # a row per range
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_range.select("range", *[F.max(f"left_{d}").over(earlier).alias(f"carried_{d}") for d in places])
    so_far = Window.partitionBy("range").orderBy("key", "kind", "url").rowsBetween(Window.unboundedPreceding, 0)
    stack = [F.last(F.when((F.col("kind") == 0) & (F.col("depth") == d), F.col("key")), ignorenulls=True).over(so_far).alias(f"own_{d}") for d in places]
    swept = lookup_join(ranges.select("url", "key", "kind", "range", *stack).where("kind = 1"), carried, ["range"], heavy_rows=None)
    at = [F.coalesce(f"own_{d}", f"carried_{d}") for d in places]
    innermost = F.coalesce(*[F.when(F.startswith("key", place), place) for place in reversed(at)])
    met = swept.select("url", innermost.alias("met")).where("met IS NOT NULL")
    named = lookup_join(met, known.select(F.col("key").alias("met"), "rule", "host", "verdict"), ["met"], "inner")
    best = F.max(F.struct(F.length("rule").alias("length"), F.length("host").alias("host_length"), "rule", "verdict")).alias("best")
    return named.groupBy("url").agg(best).select("url", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row.

    A null or malformed url has an empty host and path, which no rule fits; where none fits, the rule
    is null and the verdict is ``otherwise``.  Repeated rows are judged alike.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    judged = materialise(longest_rule(rows.select("url").distinct(), rules))
    met = rows.join(judged, "url", "left")
    return met.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))
