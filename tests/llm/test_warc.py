import gzip
import hashlib
from base64 import b32encode
from pathlib import Path

import pytest

from cohortspark.llm import warc as w


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


PAGES = [
    (1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "http://a/4\r\nX: y%0A", ""), (5, "http://a/5", "long " * 60_000),
    (6, "http://a/6", "a\r\n\r\nb"), (6, "http://a/6", "a\r\n\r\nb"), (None, "http://a/7", "a\r\n\r\nb"), (None, "http://a/8", "alone"), (-9, "u", "<p>é</p>"),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload_bytes string").repartition(3)


def test_round_trip(spark, pages, tmp_path):
    index = w.write_archives(w.with_revisits(pages), f"file://{tmp_path}/one", archive_bytes=2_000)
    found = w.read_records(index, read_bytes=3_000, gap_bytes=10, unit_bytes=500, payloads=True)
    digest = lambda t: b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    keeper = {"<p>é</p>": 2, "": 4, "a\r\n\r\nb": 6}
    wanted = []
    for page, url, html in PAGES:
        of = keeper.get(html or "")
        refers = of if of is not None and of != page else None
        wanted.append((page, url, len((html or "").encode()), digest(html), "revisit" if refers is not None else "response", refers, "" if refers is not None else html or ""))
    assert rows_of(found) == sorted(wanted, key=str)


def test_archives_are_plain_warc(spark, pages, tmp_path):
    w.write_archives(w.with_revisits(pages), f"file://{tmp_path}/two")
    members = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "two").glob("*.warc.gz"))
    assert members.count(b"WARC/1.1\r\nWARC-Type: ") == len(PAGES) and members.endswith(b"\r\n\r\n")


def test_selected_records_only(spark, pages, tmp_path):
    index = w.write_archives(w.with_revisits(pages), f"file://{tmp_path}/three")
    assert [r[0] for r in w.read_records(index.where("url = 'http://a/5'")).collect()] == [5]
    assert w.read_records(index.limit(0)).count() == 0


def test_small_payloads_are_all_responses(pages):
    assert w.with_revisits(pages, least_bytes=1_000_000).where("refers_to IS NOT NULL").count() == 0


def test_damage_is_noticed():
    member, _, _ = w.record(1, "u", b"payload", None, "2024-01-01T00:00:00Z")
    plain = gzip.decompress(member).replace(b"payload", b"payl0ad")
    with pytest.raises(ValueError):
        w.parse(gzip.compress(plain))


def test_no_pages(spark, pages, tmp_path):
    assert w.archive(spark, pages.limit(0), f"file://{tmp_path}/four").count() == 0


def test_a_task_reads_a_unit(spark, pages, tmp_path):
    index = w.write_archives(w.with_revisits(pages), f"file://{tmp_path}/four", archive_bytes=1_000_000)
    units = index.selectExpr("path", "offset div 300 AS unit").distinct().count()
    assert units > 3 and w.read_records(index, unit_bytes=300).rdd.getNumPartitions() == units
