"""Session settings and the shared folder for materialised intermediates."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cohortspark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for name, value in SESSION_SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    On a cluster this is ``spark.checkpoint.dir``.  Only a local master may fall
    back to a folder of this machine; executors elsewhere could not read it.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if not current:
            context.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="cohortspark-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(own)
    return context.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for a driver whose folder they do not have on their path."""
    top = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        archive = Path(folder, f"{top.name}.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(top.rglob("*.py")):
                out.write(source, source.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(archive))


_WRITTEN: list[str] = []


def clear_scratch(spark: SparkSession) -> None:
    """Remove every folder that :func:`scratch_path` named in this process; tables read from them are gone."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    while _WRITTEN:
        path = paths(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed by :func:`clear_scratch`."""
    _WRITTEN.append(f"{scratch_dir(spark).rstrip('/')}/cohortspark-{name}-{uuid4().hex}")
    return _WRITTEN[-1]


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it on shared storage, lineage cut.

    Used where two branches must see the very same rows, or where a small result
    of a large aggregation is both measured and joined.
    """
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


TIDY_SECONDS = 15.0
_TIDIED = [0.0]


def tidy(spark: SparkSession) -> None:
    """Have the driver collect its garbage, at most once in ``TIDY_SECONDS``.

    Only then does Spark drop the broadcasts, cached blocks and checkpoints of jobs that are over;
    an operator that runs hundreds of small jobs would else fill the driver's memory with them.
    """
    if time.monotonic() - _TIDIED[0] > TIDY_SECONDS:
        _TIDIED[0] = time.monotonic()
        gc.collect()
        spark._jvm.System.gc()
