"""Members of archives against what was packed."""

import zipfile

import pytest

from cohortspark.sources import archives


@pytest.fixture
def packed(tmp_path):
    members = {"a/s1.txt": "x\ty\n1\té\r\n\n3\t4", "s2.txt": "", "long.txt": "\n".join(f"line {i}" for i in range(30_000)), "notes.md": "no"}
    for name, method in (("one.zip", zipfile.ZIP_DEFLATED), ("two.zip", zipfile.ZIP_STORED)):
        with zipfile.ZipFile(tmp_path / name, "w", method) as z:
            z.mkdir("a")
            for m, text in members.items():
                z.writestr(m, text)
    return [f"file://{tmp_path}/{n}" for n in ("one.zip", "two.zip")], members


@pytest.mark.parametrize("group_bytes", [archives.GROUP_BYTES, 1])
def test_lines_of_all_members(spark, packed, group_bytes):
    paths, members = packed
    got = {}
    for r in archives.read_members(spark, paths, group_bytes=group_bytes).orderBy("archive", "member", "line").collect():
        got.setdefault((r["archive"], r["member"]), []).append((r["line"], r["text"]))
    wanted = {(p, m): list(enumerate(text.removesuffix("\n").replace("\r\n", "\n").split("\n"))) for p in paths for m, text in members.items() if text}
    assert got == wanted


def test_filters_reach_the_archives(spark, packed):
    paths, _ = packed
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = archives.read_members(spark, paths[:1], group_bytes=1).where("member = 'a/s1.txt' AND line > 0")
        assert [r["text"] for r in found.orderBy("line").collect()] == ["1\té", "", "3\t4"] and found.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_only_wanted_members_are_dealt_out(packed):
    paths, _ = packed
    reader = archives._PushingReader({"paths": f'["{paths[0]}"]', "members": r".*\.txt", "group_bytes": "1"})
    left = list(reader.pushFilters([archives.In(("member",), ("a/s1.txt", "notes.md")), archives.StringStartsWith(("member",), "a/"), archives.EqualTo(("line",), 1)]))
    assert len(left) == 1 and [m[0] for p in reader.partitions() for m in p.members] == ["a/s1.txt"]
    assert [len(p.members) for p in archives._Reader({"paths": "[]"}).partitions()] == [0]


def test_damage_raises(tmp_path):
    with zipfile.ZipFile(tmp_path / "bad.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("m.txt", "some words")
    data = (tmp_path / "bad.zip").read_bytes()
    (tmp_path / "bad.zip").write_bytes(data.replace(b"some words", b"same words"))
    reader = archives._Reader({"paths": f'["file://{tmp_path}/bad.zip"]'})
    with pytest.raises(ValueError):
        list(reader.read(reader.partitions()[0]))


def test_samples_by_column_name(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "s.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x/m1.txt", "det_p\tother\tTargetID\tAVG_Beta\n0.1\t?\tcg1\t0.5\n0.9\t?\tcg2\t0.6\nbad\t?\tcg3\tnone\n0.2\t?\tcg4\n")
        z.writestr("m2.txt", "TargetID\tAVG_Beta\tdet_p\ncg1\t0.25\t0.0\n")
    path = f"file://{tmp_path}/s.zip"
    got = sorted((tuple(r) for r in archives.read_archived_samples(spark, [path]).collect()), key=str)
    assert got == sorted([("cg1", 0.5, 0.1, "m1"), ("cg2", 0.6, 0.9, "m1"), ("cg3", None, None, "m1"), ("cg4", None, 0.2, "m1"), ("cg1", 0.25, 0.0, "m2")], key=str)
    assert archives.read_archived_samples(spark, [path], 0.15).count() == 2
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("m3.txt", "TargetID\tvalue\ncg1\t1\n")
    with pytest.raises(Exception, match="no column"):
        archives.read_archived_samples(spark, [f"file://{tmp_path}/t.zip"]).collect()


def test_written_archives_are_read_back(spark, tmp_path):
    rows = [(f"cg{i}", f"m{i % 5}", i / 7, i / 100) for i in range(60)] + [("cg0", "m9", None, 0.5)]
    index = archives.write_archives(spark.createDataFrame(rows, "TargetID string, MET_ID string, AVG_Beta double, det_p double"), f"file://{tmp_path}/z", 3)
    paths = [r["archive"] for r in index.collect()]
    assert index.selectExpr("sum(members)").first()[0] == 6
    got = archives.read_archived_samples(spark, paths).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(t, b, d, m) for t, m, b, d in rows], key=str)
    assert archives.write_archives(spark.createDataFrame([], "TargetID string, MET_ID string, AVG_Beta double, det_p double"), f"file://{tmp_path}/none").count() == 0
