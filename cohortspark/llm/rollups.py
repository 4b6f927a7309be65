"""Token counts as delta-maintained rollups.

Totals of documents and tokens per source, language and tokenizer version are sums of signed
changes: an insert adds a document and its tokens, a delete takes them away, a revision takes the
old count away and adds the new one, which may belong to another source, language or version.
A batch is reduced to one row per group and committed under its id by a rename; a batch whose id is
there already changes nothing, so a batch may be sent again after any failure.  One writer commits a
given id at a time.  Totals add up the batches; ``compact`` folds them into one snapshot.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.text import LETTER_WORD, SPACED_WORD, lower_ascii

GROUP = ["source", "lang", "tokenizer_version"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint"
TOKENIZERS = {
    "spaced-1": lambda text: F.regexp_count(text, F.lit(SPACED_WORD)),
    "letters-1": lambda text: F.regexp_count(lower_ascii(text), F.lit(LETTER_WORD)),
}


def token_count(text: Column, version: str) -> Column:
    """Tokens of a text under a tokenizer version; null has none."""
    return F.coalesce(TOKENIZERS[version](text), F.lit(0)).cast("bigint")


def inserts(rows: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    """Signed changes for new documents with the columns of ``GROUP``."""
    return rows.select(*GROUP, F.lit(1).cast("bigint").alias("n_docs"), F.col(n_tokens).cast("bigint").alias("n_tokens"))


def deletes(rows: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    """Signed changes for documents that go, with the count they were inserted with."""
    return inserts(rows, n_tokens).withColumns({"n_docs": -F.col("n_docs"), "n_tokens": -F.col("n_tokens")})


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed changes for documents whose group or count changed: the old rows go, the new ones come."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.paths = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.paths(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        """Names of the committed folders of a kind, oldest name first."""
        top = self.paths(f"{self.folder}/{kind}")
        return sorted(x.getPath().getName() for x in self.files.listStatus(top)) if self.files.exists(top) else []

    def _put(self, tables: dict[str, DataFrame], kind: str, name: str) -> None:
        """Write tables aside, then rename their folder: under its final name it is complete."""
        aside = f"{self.folder}/pending/{uuid4().hex}"
        for table, rows in tables.items():
            rows.write.parquet(f"{aside}/{table}")
        self.files.mkdirs(self.paths(f"{self.folder}/{kind}"))
        if not self.files.rename(self.paths(aside), self.paths(f"{self.folder}/{kind}/{name}")):
            raise RuntimeError(f"could not commit {kind}/{name}")

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """Path of the newest snapshot and the batches folded into it."""
        names = self._names("snapshots")
        if not names:
            return None, set()
        path = f"{self.folder}/snapshots/{names[-1]}"
        return f"{path}/totals", {r[0] for r in self.spark.read.parquet(f"{path}/batches").collect()}

    def committed(self) -> set[str]:
        """Ids of all batches that count."""
        return self._snapshot()[1] | set(self._names("batches"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes; false if its id was committed before.  Null group values are groups of their own."""
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"a batch id is made of letters, digits, - and _: {batch_id!r}")
        if batch_id in self.committed():
            return False
        summed = changes.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        self._put({"totals": summed}, "batches", batch_id)
        return True

    def _tables(self) -> list[DataFrame]:
        snapshot, folded = self._snapshot()
        paths = [f"{self.folder}/batches/{b}/totals" for b in self._names("batches") if b not in folded]
        paths += [snapshot] if snapshot else []
        return [self.spark.read.schema(SCHEMA).parquet(*paths)] if paths else []

    def totals(self) -> DataFrame:
        """Documents and tokens per group; groups in which nothing is left are not listed."""
        tables = self._tables() or [self.spark.createDataFrame([], SCHEMA)]
        summed = tables[0].groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs != 0 OR n_tokens != 0")

    def compact(self) -> None:
        """Fold all committed batches into one snapshot that also lists them; both appear by one rename."""
        listed = self.spark.createDataFrame([(x,) for x in sorted(self.committed())], "batch string")
        self._put({"totals": self.totals(), "batches": listed}, "snapshots", f"{len(self._names('snapshots')):08d}")
