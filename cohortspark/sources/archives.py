"""Text members of ZIP archives as a table, without unpacking them to disk.

The driver reads the directory at the end of each archive and deals its members out by their compressed
bytes; a task reads the byte ranges of its members, inflates them piece by piece and hands on lines in Arrow
batches.  Nothing holds a whole member.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from cohortspark.operators.clean import column

GROUP_BYTES = 32 * 1024 * 1024  # compressed bytes of the members that a task reads
PIECE_BYTES, LINES_AT_ONCE = 1024 * 1024, 10_000
LOCAL_HEADER, STORED, DEFLATED = 30, 0, 8  # fixed values of the format
LINES = "archive string, member string, line bigint, text string"


def _open(path: str):
    """A seekable file of any file system that Arrow knows; a plain path is a local one."""
    files, inside = pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return files.open_input_file(inside)


@dataclass(frozen=True)
class Members(InputPartition):
    """Some members of an archive: name, offset of the local header, compressed size, method, checksum."""

    archive: str
    members: tuple[tuple[str, int, int, int, int], ...]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"])
        self.pattern = options.get("members")
        self.group_bytes = int(options.get("group_bytes", GROUP_BYTES))
        self.names: set[str] | None = None
        self.prefixes: list[str] = []

    def _wanted(self, name: str) -> bool:
        if name.endswith("/") or (self.names is not None and name not in self.names) or not all(name.startswith(p) for p in self.prefixes):
            return False
        return self.pattern is None or re.fullmatch(self.pattern, name) is not None

    def partitions(self) -> Sequence[InputPartition]:
        dealt = []
        for path in self.paths:
            with _open(path) as file, zipfile.ZipFile(file) as archive:
                group, size = [], 0
                for m in sorted(archive.infolist(), key=lambda m: m.header_offset):
                    if not self._wanted(m.filename):
                        continue
                    if m.flag_bits & 1 or m.compress_type not in (STORED, DEFLATED):
                        raise ValueError(f"{m.filename} in {path} is encrypted or packed in another way")
                    group.append((m.filename, m.header_offset, m.compress_size, m.compress_type, m.CRC))
                    size += m.compress_size
                    if size >= self.group_bytes:
                        dealt.append(Members(path, tuple(group)))
                        group, size = [], 0
                if group:
                    dealt.append(Members(path, tuple(group)))
        return dealt or [Members("", ())]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if not partition.members:
            return
        with _open(partition.archive) as file:
            for name, offset, size, method, checksum in partition.members:
                number, lines = 0, []
                for line in _lines(_inflated(file, offset, size, method, checksum, name)):
                    lines.append(line)
                    if len(lines) >= LINES_AT_ONCE:
                        yield _batch(partition.archive, name, number, lines)
                        number, lines = number + len(lines), []
                if lines:
                    yield _batch(partition.archive, name, number, lines)


class _PushingReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the names of members choose what is read; Spark keeps the others."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("member",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = wanted if self.names is None else self.names & wanted
            elif isinstance(f, StringStartsWith) and f.attribute == ("member",):
                self.prefixes.append(f.value)
            else:
                yield f


def _batch(archive: str, name: str, number: int, lines: list[str]) -> pa.RecordBatch:
    columns = [pa.array([archive] * len(lines)), pa.array([name] * len(lines)), pa.array(range(number, number + len(lines)), pa.int64()), pa.array(lines, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["archive", "member", "line", "text"])


def _inflated(file, offset: int, size: int, method: int, checksum: int, name: str) -> Iterator[bytes]:
    """The bytes of a member; damage raises."""
    head = file.read_at(LOCAL_HEADER, offset)
    start = offset + LOCAL_HEADER + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
    unpack, crc = zlib.decompressobj(-15), 0
    for at in range(0, size, PIECE_BYTES):
        piece = file.read_at(min(PIECE_BYTES, size - at), start + at)
        while piece:
            out = unpack.decompress(piece, PIECE_BYTES) if method == DEFLATED else piece
            piece = unpack.unconsumed_tail if method == DEFLATED else b""
            crc = zlib.crc32(out, crc)
            yield out
    if method == DEFLATED:
        rest = unpack.flush()
        crc = zlib.crc32(rest, crc)
        yield rest
    if crc != checksum:
        raise ValueError(f"{name} is damaged")


def _lines(pieces: Iterator[bytes]) -> Iterator[str]:
    """Lines without their ends; the last one need not have one."""
    rest = b""
    for piece in pieces:
        *whole, rest = (rest + piece).split(b"\n")
        for line in whole:
            yield line.removesuffix(b"\r").decode("utf-8", "replace")
    if rest:
        yield rest.removesuffix(b"\r").decode("utf-8", "replace")


class ZipMembers(DataSource):
    """Format ``zip_members``: options ``paths`` (a JSON list), ``members`` (a pattern for whole names), ``group_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        del schema
        return (_PushingReader if self.options.get("push") == "true" else _Reader)(self.options)


def read_members(spark: SparkSession, paths: list[str], members: str | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Lines of the text members of archives (``LINES``); an archive without members has none.

    ``members`` is a pattern of whole names.  Where the session lets Python sources take filters, filters on ``member``
    choose what is read too.
    """
    spark.dataSource.register(ZipMembers)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("zip_members").option("paths", json.dumps(paths)).option("group_bytes", str(group_bytes)).option("push", push)
    return (reader.option("members", members) if members else reader).load()


def read_archived_samples(spark: SparkSession, paths: list[str], limit: float | None = None, columns: tuple[str, str, str] = ("TargetID", "AVG_Beta", "det_p")) -> DataFrame:
    """Readings (TargetID, AVG_Beta, det_p, MET_ID) of archives with a tab-separated ``<sample>.txt`` per sample.

    Columns are found by the name in each member's first line, others may be there; a member without one of
    them raises.  Cells that are no number are null; with ``limit`` only readings with a lower detection p-value stay.
    """
    lines = read_members(spark, paths, r"(?s).*\.txt").where(F.length("text") > 0)
    cells = F.split("text", "\t")
    heads = lines.where("line = 0").select(F.col("archive").alias("_a"), F.col("member").alias("_m"), cells.alias("_head"))
    rows = lines.where("line > 0").join(heads, (F.col("archive") == F.col("_a")) & (F.col("member") == F.col("_m")))

    def cell(name: str):
        at = F.array_position("_head", name)
        missing = F.raise_error(F.concat(F.col("member"), F.lit(f" has no column {name}"))).cast("string")
        return F.when(at > 0, F.try_element_at(cells, at.cast("int"))).otherwise(missing)

    sample = F.regexp_extract("member", r"([^/]*)\.txt$", 1)
    got = rows.select(cell(columns[0]).alias("TargetID"), *[cell(c).try_cast("double").alias(n) for c, n in zip(columns[1:], ("AVG_Beta", "det_p"))], sample.alias("MET_ID"))
    return got if limit is None else got.where(column("det_p") < limit)


def write_archives(readings: DataFrame, folder: str, archives: int = 4, columns: tuple[str, str, str] = ("TargetID", "AVG_Beta", "det_p")) -> DataFrame:
    """Archives of ``<sample>.txt`` members below ``folder``; returns (archive, members), stored, so that a task that runs again adds no archive to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        first = next(rows, None)
        if first is None:
            return
        path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.zip"
        files, inside = pa.fs.FileSystem.from_uri(path)
        files.create_dir(inside.rsplit("/", 1)[0], recursive=True)
        count, now, member = 0, None, None
        with files.open_output_stream(inside) as stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as archive:
            for sample, *values in (r for part in ([first], rows) for r in part):
                if sample != now:
                    if member:
                        member.close()
                    now, count, member = sample, count + 1, archive.open(f"{sample}.txt", "w", force_zip64=True)
                    member.write(("\t".join(columns) + "\n").encode())
                member.write(("\t".join("" if v is None else str(v) for v in values) + "\n").encode())
            member.close()
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], ["archive", "members"])

    rows = readings.select(F.col("MET_ID").cast("string").alias("MET_ID"), *[column(c) for c in columns])
    index = rows.repartition(archives, "MET_ID").sortWithinPartitions("MET_ID", columns[0]).mapInArrow(run, "archive string, members bigint")
    index.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/index")
    return readings.sparkSession.read.parquet(f"{folder.rstrip('/')}/index")
