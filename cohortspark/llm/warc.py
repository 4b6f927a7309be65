"""WARC archives with an index first.

Writing puts every record into an archive as a gzip member of its own and notes offset, length, url
and digest; the index is a table.  Reading selects index rows, sorts them by archive and offset,
joins neighbouring ranges into few reads, and parses and verifies each record.

Payloads that are equal are stored once: the page with the greatest id holds the response, the
others are revisit records that refer to it.

Archives and index lie in a folder that all executors share, reached through ``pyarrow.fs``.  Every
attempt of a task writes files of its own name, and only the attempts whose index rows are committed
count, so a lost executor leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.joins import lookup_join

ARCHIVE_BYTES = 256 * 1024 * 1024
READ_BYTES, GAP_BYTES, UNIT_BYTES = 8 * 1024 * 1024, 64 * 1024, 16 * 1024 * 1024
LEVEL = 4
INDEX = "path string, offset bigint, length bigint, url string, digest string, record_type string"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _number(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[bytes, str, str]:
    """One record as a gzip member, with its digest and type; a revisit has no payload of its own."""
    digest, kind = digest_of(payload), "response" if refers_to is None else "revisit"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload))]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    if kind == "revisit":
        fields += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", PROFILE)]
        block = b""
    else:
        fields.append(("Content-Type", "application/http; msgtype=response"))
        block = HTTP.format(len(payload)).encode() + payload
    fields.append(("Content-Length", len(block)))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush(), digest, kind


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record; raises when the payload does not fit its digest."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else b""
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{digest_of(payload)}":
        raise ValueError(f"record {fields['WARC-Record-ID']} does not fit its digest")
    return fields, payload


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _writer(folder: str, date: str, archive_bytes: int) -> Batches:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        out, path, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name = f"{uuid4().hex}.warc.gz"
                    out, path, at = files.open_output_stream(f"{root}/{name}", compression=None), f"{folder}/{name}", 0
                member, digest, kind = record(page_id, url, (html or "").encode(), refers_to, date)
                out.write(member)
                rows.append((path, at, len(member), url, digest, kind))
                at += len(member)
            if out is not None:
                out.flush()
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "offset", "length", "url", "digest", "record_type"])
        if out is not None:
            out.close()

    return write


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): null for the response of each payload and for payloads under ``least_bytes``.

    A null html is an empty payload.  Rows that share the greatest id are all responses; a null id
    is never the greatest, and a payload seen only without ids has no revisits.
    """
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("_sha", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= least_bytes
    repeated = rows.where(large).groupBy("_sha").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 AND keeper IS NOT NULL")
    met = lookup_join(rows, repeated.select("_sha", "keeper"), ["_sha"])
    refers = F.when(large & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return met.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row of (page_id, url, html, refers_to) below ``folder``; returns the stored index."""
    files, root = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    records.select("page_id", "url", "html", "refers_to").mapInArrow(_writer(folder, date, archive_bytes), INDEX).write.parquet(f"{folder}/index")
    return records.sparkSession.read.parquet(f"{folder}/index")


def _reader(read_bytes: int, gap_bytes: int, payloads: bool) -> Batches:
    def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
        """Neighbouring records of an archive as one range: path, start, end, members."""
        path, start, end, members = "", 0, 0, []
        for p, offset, length in rows:
            if members and (p != path or offset - end > gap_bytes or offset + length - start > read_bytes):
                yield path, start, end, members
                members = []
            if not members:
                path, start, end = p, offset, offset
            members.append((offset, length))
            end = max(end, offset + length)
        if members:
            yield path, start, end, members

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = "", None
        for batch in batches:
            for path, start, end, members in ranges(list(zip(*[c.to_pylist() for c in batch.columns]))):
                if path != opened:
                    files, inside = pyarrow.fs.FileSystem.from_uri(path)
                    opened, source = path, files.open_input_file(inside)
                data = source.read_at(end - start, start)
                rows = []
                for offset, length in members:
                    fields, payload = parse(data[offset - start : offset - start + length])
                    url = fields.get("WARC-Target-URI")
                    size = len(payload) if fields["WARC-Type"] == "response" else int(fields["X-Payload-Length"])
                    rows.append((
                        _number(fields["WARC-Record-ID"]), url if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
                        size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], _number(fields.get("WARC-Refers-To")),
                        payload.decode() if payloads else None,
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return read


def read_records(selected: DataFrame, read_bytes: int = READ_BYTES, gap_bytes: int = GAP_BYTES, unit_bytes: int = UNIT_BYTES, payloads: bool = False) -> DataFrame:
    """The records of the selected index rows, with their payload if wanted.

    An archive is dealt out in units of ``unit_bytes``; within a task the rows are sorted by archive
    and offset, and ranges at most ``gap_bytes`` apart are read at once, up to ``read_bytes``.
    A record selected twice is read twice; an empty selection has no records.
    """
    units = selected.select("path", "offset", "length", F.expr(f"offset div {unit_bytes}").alias("_unit"))
    # As many tasks as there are units, by the bytes of the archives; those of the index say nothing about the work.
    tasks = units.groupBy("path", "_unit").agg(F.lit(1)).count()
    in_order = units.repartition(max(1, tasks), "path", "_unit").sortWithinPartitions("path", "offset").select("path", "offset", "length")
    schema = RECORD + ", payload string"
    found = in_order.mapInArrow(_reader(read_bytes, gap_bytes, payloads), schema)
    return found if payloads else found.drop("payload")


def archive(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages below ``folder`` and read all records back."""
    return read_records(write_archives(with_revisits(pages), folder))
