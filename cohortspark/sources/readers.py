"""Readers of cohort tables, manifests and per-sample reading files."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from cohortspark.operators.clean import (
    add_index_label, chain, column, complete_rows, eligible, long_enough, mean_pressure, nan_as_null, normalise_codes,
    padded_id, recompute_ldl, to_shared_schema, union_in_order,
)
from cohortspark.operators.joins import full_outer_all, lookup_join
from cohortspark.session import scratch_path, tidy
from cohortspark.sources.writers import FOLDERS_AT_ONCE

KEPT_SETTINGS = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.caseSensitive")
INPUTS = "mapreduce.input.fileinputformat.inputdir"
PLAIN_PATHS = {"__globPaths__": "false"}  # paths that were listed are taken as they are

# Variable codes of the two coded surveys and their shared names, the
# codes that changed between cycles, and the columns read from the plain tables.
CYCLE_CODES = {
    "SEQN": "Release_No", "DIQ010": "DIABETES", "RIAGENDR": "SEX", "RIDAGEYR": "AGE", "BMXBMI": "BMI",
    "BPXDI2": "SIT_1_DIASTOLIC_PRESSURE", "BPXSY2": "SIT_1_SYSTOLIC_PRESSURE",
    "BPXDI3": "SIT_2_DIASTOLIC_PRESSURE", "BPXSY3": "SIT_2_SYSTOLIC_PRESSURE",
    "LBXTR": "TG", "LBDLDL": "LDL_C", "LBXTC": "T_CHO", "LBXGLU": "FASTING_GLUCOSE", "LBXIN": "FASTING_INSULIN",
    "LBXGH": "HBA1C", "LBDHDD": "HDL_C", "BMXWAIST": "BODY_WAISTLINE", "LBXSATSI": "SGPT", "LBXSASSI": "SGOT",
    "LBXSBU": "BUN", "LBXSCR": "CREATININE", "LBXSUA": "URIC_ACID",
}
CYCLE_ALIASES = {"LBXHDD": "LBDHDD", "LBDHDL": "LBDHDD", "LBDSCR": "LBXSCR", "LBDSTB": "LBXSTB"}
YEARLY_CODES = {
    "ID": "Release_No", "DE1_dg": "DIABETES", "sex": "SEX", "age": "AGE", "HE_BMI": "BMI",
    "HE_dbp2": "SIT_1_DIASTOLIC_PRESSURE", "HE_sbp2": "SIT_1_SYSTOLIC_PRESSURE",
    "HE_dbp3": "SIT_2_DIASTOLIC_PRESSURE", "HE_sbp3": "SIT_2_SYSTOLIC_PRESSURE",
    "HE_TG": "TG", "HE_LDL_drct": "LDL_C", "HE_chol": "T_CHO", "HE_glu": "FASTING_GLUCOSE", "HE_insulin": "FASTING_INSULIN",
    "HE_HbA1c": "HBA1C", "HE_HDL_st2": "HDL_C", "HE_wc": "BODY_WAISTLINE", "HE_alt": "SGPT", "HE_ast": "SGOT",
    "HE_BUN": "BUN", "HE_crea": "CREATININE", "HE_Uacid": "URIC_ACID",
}
MEASURES = [
    "BODY_WAISTLINE", "BMI", "SIT_1_DIASTOLIC_PRESSURE", "SIT_1_SYSTOLIC_PRESSURE", "SIT_2_DIASTOLIC_PRESSURE",
    "SIT_2_SYSTOLIC_PRESSURE", "FASTING_GLUCOSE", "HBA1C", "HDL_C", "LDL_C", "T_CHO", "TG", "SGOT", "SGPT", "BUN",
    "CREATININE", "URIC_ACID",
]
DIASTOLIC = ["SIT_1_DIASTOLIC_PRESSURE", "SIT_2_DIASTOLIC_PRESSURE"]
SYSTOLIC = ["SIT_1_SYSTOLIC_PRESSURE", "SIT_2_SYSTOLIC_PRESSURE"]


def read_named(spark: SparkSession, path: str | list[str], schema: StructType | str, sep: str = ",", **options: str) -> DataFrame:
    """Delimited text with a header: the schema's columns by name, whatever else the files hold and in which order.

    A cell that does not fit its type is null; a missing column raises.  Files of one read must
    share a header, which is checked.
    """
    fields = schema.fields if isinstance(schema, StructType) else StructType.fromDDL(schema).fields
    rows = spark.read.options(header=True, sep=sep, inferSchema=False, enforceSchema=False, **options).csv(path)
    absent = [f.name for f in fields if f.name not in rows.columns]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    return rows.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in fields], "_metadata")


def _strings(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


LAB_SCHEMA = StructType(_strings("Release_No", "FOLLOW", "MET_ID"))
SURVEY_SCHEMA = StructType(_strings("Release_No", "FOLLOW") + [StructField(n, LongType()) for n in ("DIABETES", "AGE", "SEX")])
MEASURE_SCHEMA = StructType(_strings("Release_No", "FOLLOW") + [StructField(n, DoubleType()) for n in MEASURES] + _strings("FAST_TIME"))
READING_SCHEMA = StructType(_strings("TargetID", "AVG_Beta", "Detection Pval"))


def merge_components(frames: list[DataFrame], key: str = "SEQN", aliases: dict[str, str] | None = None) -> DataFrame:
    """Component tables of one cycle as one row per participant.

    Codes are normalised per component first; a code that several components carry
    under different names is coalesced after the full outer joins.
    """
    aliases = CYCLE_ALIASES if aliases is None else aliases
    renamed, origin = [], {}
    for i, frame in enumerate(frames):
        frame = normalise_codes(frame, aliases)
        names = {c: (c if c == key or c not in origin else f"{c}__{i}") for c in frame.columns}
        for c, shown in names.items():
            if c != key:
                origin.setdefault(c, []).append(shown)
        renamed.append(frame.withColumnsRenamed(names))
    merged = full_outer_all(renamed, key)
    return merged.select(key, *[F.coalesce(*[column(n) for n in names]).alias(c) for c, names in origin.items()])


def read_cycle(spark: SparkSession, paths: list[str], key: str = "SEQN", mapping: dict[str, str] | None = None) -> DataFrame:
    """Read and merge every component file (Parquet) of a cycle, mapped codes only."""
    merged = merge_components([spark.read.parquet(p) for p in paths], key)
    return to_shared_schema(merged, CYCLE_CODES if mapping is None else mapping)


def process_cycles(cycles: list[DataFrame]) -> DataFrame:
    """Cleaned cohort from the merged cycles (shared names)."""
    union = reduce(lambda a, b: a.unionByName(b), cycles)
    return chain(
        nan_as_null(union),
        lambda df: eligible(df, 18, diagnosis_range=(2, 3)),
        lambda df: mean_pressure(df, DIASTOLIC, SYSTOLIC),
        lambda df: padded_id(df, "Release_No"),
        lambda df: add_index_label(df, "FASTING_INSULIN", "FASTING_GLUCOSE"),
        complete_rows,
    )


def clean_year(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Cleaned rows of one yearly file, LDL recomputed."""
    return chain(
        nan_as_null(to_shared_schema(df, YEARLY_CODES if mapping is None else mapping)),
        recompute_ldl,
        lambda f: mean_pressure(f, DIASTOLIC, SYSTOLIC),
        lambda f: f.withColumn("Release_No", F.col("Release_No").cast("string")),
        lambda f: eligible(f, 18, diagnosis_range=(0, 0)),
        lambda f: add_index_label(f, "FASTING_INSULIN", "FASTING_GLUCOSE"),
        complete_rows,
    )


def process_years(files: list[DataFrame]) -> DataFrame:
    """Yearly files in listed order; (file_seq, Release_No) is the row order."""
    return union_in_order([clean_year(f) for f in files])


def read_baseline(spark: SparkSession, path: str, schema: StructType, columns: list[str], visit: str = "Baseline") -> DataFrame:
    """CSV read by column name: baseline visits, chosen columns, bad cells null."""
    rows = read_named(spark, path, schema)
    return rows.where(F.col("FOLLOW") == visit).select(*[column(c) for c in columns])


def process_external(survey: DataFrame, measure: DataFrame, lab: DataFrame) -> DataFrame:
    """Cohort without an index: survey and measures, array identifier when there is one."""
    merged = survey.join(measure, "Release_No").join(lab, "Release_No", "left").na.fill("", ["MET_ID"])
    return chain(
        merged.where(F.col("DIABETES") == 0).drop("DIABETES"),
        complete_rows,
        lambda df: mean_pressure(df, DIASTOLIC, SYSTOLIC),
        lambda df: long_enough(df, "FAST_TIME", on_bad="error"),
        complete_rows,
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated manifest, every column text."""
    return spark.read.option("header", True).option("sep", "\t").option("inferSchema", False).csv(path)


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, in order; none if it is a file or is not there.  Hidden files are left out, as Spark leaves them out."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    place = files.makeQualified(place)
    if not files.exists(place) or files.getFileStatus(place).isFile():
        return []
    # One text for all of them, as a job's input would be set: a call for each would take as long as reading it.
    paths = spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(files.listStatus(place))
    if not len(paths):
        return []
    job = spark._jvm.org.apache.hadoop.mapred.JobConf(spark._jsc.hadoopConfiguration())
    spark._jvm.org.apache.hadoop.mapred.FileInputFormat.setInputPaths(job, paths)
    listed = re.findall(r"(?:[^,\\]|\\.)+", job.getRaw(INPUTS))
    names = [re.sub(r"\\(.)", r"\1", p).rpartition("/")[2] for p in listed]
    return sorted(n for n in names if not n.startswith(".") and not (n.startswith("_") and "=" not in n))


def folder_batches(spark: SparkSession, path: str, at_once: int | None = None) -> Iterator[tuple[str, list[str]]]:
    """(Folder, names in it) for batches of at most ``at_once`` entries of ``path``, and of those of its groups that ``writers.write_folders`` made."""
    at_once, path = at_once or FOLDERS_AT_ONCE, path.rstrip("/")
    names = _children(spark, path)
    groups = [n for n in names if re.fullmatch(r"group_\d+", n)]
    own = [n for n in names if n not in set(groups)]
    for k in range(0, len(own), at_once):
        yield path, own[k : k + at_once]
    for group in groups:
        yield from folder_batches(spark, f"{path}/{group}", at_once)


def read_folders(spark: SparkSession, path: str, read: Callable[[SparkSession, str, list[str] | None], DataFrame], at_once: int | None = None) -> DataFrame:
    """The rows of a folder that may hold more entries than the driver can keep a record of.

    ``read`` makes a table of a folder, or of some names in it.  If it is all one batch, that table is the result.  Otherwise one batch after the other is
    read and kept as a few larger files, so that the driver knows the files of one batch at a time.
    """
    batches = list(itertools.islice(folder_batches(spark, path, at_once), 2))
    if len(batches) < 2:
        return read(spark, batches[0][0] if batches else path, None)
    kept, tasks = scratch_path(spark, "folders"), 2 * spark.sparkContext.defaultParallelism
    apart = spark.newSession()  # lists with few tasks instead of one a folder, without touching the caller's settings
    for name in KEPT_SETTINGS:
        apart.conf.set(name, spark.conf.get(name))
    apart.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(tasks))
    for k, (folder, names) in enumerate(folder_batches(spark, path, at_once)):
        table = read(apart, folder, names)
        table.coalesce(tasks).write.parquet(f"{kept}/{k:06d}")  # many small files to a task
        tidy(spark)
    return spark.read.schema(table.schema).option("recursiveFileLookup", "true").parquet(kept)


def read_sample_readings(spark: SparkSession, path: str, sample: str = r"([^/=]+)_nor\.txt", limit: float = 0.001, at_once: int | None = None) -> DataFrame:
    """Text files per sample below ``path``; ``sample`` finds the sample in a file's path."""

    def read(session: SparkSession, folder: str, names: list[str] | None) -> DataFrame:
        if names is None:
            rows = read_named(session, folder, READING_SCHEMA, "\t", recursiveFileLookup="true")
        else:
            rows = read_named(session, [f"{folder}/{n}" for n in names], READING_SCHEMA, "\t", recursiveFileLookup="true", **PLAIN_PATHS)
        beta, detection = F.expr("try_cast(AVG_Beta AS double)"), F.expr("try_cast(`Detection Pval` AS double)")
        return rows.select(
            "TargetID",
            beta.alias("AVG_Beta"),
            detection.alias("Detection Pval"),
            F.regexp_extract("_metadata.file_path", sample, 1).alias("MET_ID"),
        ).where(F.col("Detection Pval") < limit)

    return read_folders(spark, path, read, at_once)


def annotated_readings(readings: DataFrame, manifest: DataFrame, excluded: tuple[str, ...] = ("X", "Y")) -> DataFrame:
    """Readings of the manifest's autosomal probes with gene names attached."""
    genes = manifest.where(~F.col("CHR").isin(*excluded)).select(F.col("Probe_ID").alias("TargetID"), "UCSC_REFGENE_NAME")
    joined = lookup_join(readings, genes, ["TargetID"], "inner", max_rows=2_000_000)
    return joined.select("TargetID", "UCSC_REFGENE_NAME", "AVG_Beta", "Detection Pval", "MET_ID")


def read_samples(spark: SparkSession, path: str, columns: tuple[str, ...] = ("TargetID", "AVG_Beta", "MET_ID"), at_once: int | None = None) -> DataFrame:
    """Directory of Parquet sample tables; an absent or empty directory is an error.

    Samples in the names of folders are whole numbers if all are, as in any Parquet read; in a directory of more than one batch all others are text.
    """
    bits: dict[str, int] = {}  # that the names of folders need as numbers, by column
    types: list[StructType] = []

    def read(session: SparkSession, folder: str, names: list[str] | None) -> DataFrame:
        if names is None:
            return session.read.parquet(folder).select(*columns)
        paths = [f"{folder}/{n}" for n in names]
        for column_, _, value in (n.partition("=") for n in names if "=" in n):
            bits[column_] = max(bits.get(column_, 0), _bits(value))
        if not types:
            types.append(_schema_of_first(session, folder, paths))
        schema = StructType([StructField(f.name, StringType()) if f.name in bits else f for f in types[0]])
        return session.read.options(basePath=folder, **PLAIN_PATHS).schema(schema).parquet(*paths).select(*columns)

    try:
        rows = read_folders(spark, path, read, at_once)
    except AnalysisException as error:
        raise FileNotFoundError(f"no sample tables in {path}") from error
    kinds = {c: {32: "int", 64: "bigint"}.get(n, "string") for c, n in bits.items()}
    return rows.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in columns])


def _schema_of_first(spark: SparkSession, folder: str, paths: list[str]) -> StructType:
    """Columns of the first of some folders that holds a table."""
    for path in paths[:-1]:
        try:
            return spark.read.options(basePath=folder, **PLAIN_PATHS).parquet(path).schema
        except AnalysisException:
            continue
    return spark.read.options(basePath=folder, **PLAIN_PATHS).parquet(paths[-1]).schema


def _bits(name: str) -> int:
    if name == "__HIVE_DEFAULT_PARTITION__":
        return 32
    size = abs(int(name)) if re.fullmatch(r"[+-]?[0-9]{1,19}", name) else 2**64
    return 32 if size < 2**31 else 64 if size < 2**63 else 128


def read_csv_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return read_named(spark, path, schema).drop("_metadata")
