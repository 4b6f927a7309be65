"""Probe-by-sample matrices of any width.

Samples are numbered in their given order and cut into blocks of columns.  A first pass finds the
probes that every sample has, a second one files each value at its place: a row per probe and block
holds an array with a value for every sample of the block.  No plan has an expression per sample, and no row is
wider than a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.clean import column
from cohortspark.operators.joins import complete_keys, keep_keys, lookup_join
from cohortspark.session import materialise

BLOCK = 256


def _ordinals(df: DataFrame, member: str, samples: list) -> DataFrame:
    if len(set(samples)) < len(samples):
        raise ValueError("a sample is listed twice")
    kind = df.schema[member].dataType.simpleString()
    return df.sparkSession.createDataFrame(list(enumerate(samples)), f"_ordinal int, _member {kind}")


def assemble(
    readings: DataFrame, samples: list, key: str = "TargetID", member: str = "MET_ID", value: str = "AVG_Beta", block: int = BLOCK, unique: bool = False,
) -> DataFrame:
    """(key, block, values): the values of a probe in the samples of a block, in the order of ``samples``.

    Only probes with a value in every listed sample are kept; other samples are left out.  A listed
    sample without any reading raises.  Of several readings of a probe in a sample the least is
    taken; ``unique`` says that there are none.
    """
    if not samples:
        raise FileNotFoundError("no samples given")
    order = materialise(_ordinals(readings, member, samples))
    listed = lookup_join(readings.select(key, member, column(value).cast("double").alias(value)), order, [(member, "_member")], "inner", kept=True)
    listed = listed.where(column(value).isNotNull() & ~F.isnan(column(value)))
    met = listed.groupBy("_ordinal").agg(F.lit(True).alias("_met")).withColumnRenamed("_ordinal", "_o")
    lost = [r[0] for r in order.join(met, F.col("_ordinal") == F.col("_o"), "left_anti").select("_member").limit(5).collect()]
    if lost:
        raise ValueError(f"samples without readings: {', '.join(map(str, lost))}")
    kept = keep_keys(listed, complete_keys(listed, key, member, value, len(samples), unique), key)
    if not unique:
        kept = kept.groupBy(key, "_ordinal").agg(F.min(value).alias(value))
    cell = F.struct(F.col("_ordinal"), F.col(value).alias("_value"))
    filled = kept.groupBy(key, F.expr(f"_ordinal div {block}").cast("int").alias("block")).agg(F.sort_array(F.collect_list(cell)).alias("_cells"))  # a block of samples
    return filled.select(key, "block", F.transform("_cells", lambda c: c["_value"]).alias("values"))


def columns_of(blocks: DataFrame, samples: list, number: int, key: str = "TargetID", block: int = BLOCK) -> DataFrame:
    """One block with a column per sample, named by it."""
    names = samples[number * block : (number + 1) * block]
    return blocks.where(F.col("block") == number).select(key, *[F.col("values")[i].alias(str(s)) for i, s in enumerate(names)])


def in_long_form(blocks: DataFrame, samples: list, member: str, kind: str, key: str = "TargetID", value: str = "AVG_Beta", block: int = BLOCK) -> DataFrame:
    """(key, member, value) again, ``kind`` being the type of ``member``."""
    order = blocks.sparkSession.createDataFrame(list(enumerate(samples)), f"_number int, `{member}` {kind}")
    rows = blocks.select(key, "block", F.posexplode("values").alias("_at", value))
    return lookup_join(rows.withColumn("_number", F.col("block") * block + F.col("_at")), order, ["_number"], "inner").select(key, member, value)


def write_wide(blocks: DataFrame, path: str) -> str:
    """A folder per block, so that a reader of some samples opens their blocks alone."""
    blocks.repartition("block", F.pmod(F.xxhash64(*[c for c in blocks.columns if c not in ("block", "values")]), F.lit(64))).write.mode("overwrite").partitionBy("block").parquet(path)
    return path


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
