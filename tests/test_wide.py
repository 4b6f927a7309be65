"""Wide matrices in blocks against the long rows they come from."""

import math

import pytest

from cohortspark.operators import wide

SAMPLES = [f"s{i}" for i in (3, 1, 2, 0, 6, 5, 4)]
SCHEMA = "TargetID string, MET_ID string, AVG_Beta double"


def rows_of(probes):
    return [(p, s, i + 10 * k) for k, p in enumerate(probes) for i, s in enumerate(sorted(SAMPLES))]


def test_blocks_hold_every_value_at_its_place(spark, tmp_path):
    rows = rows_of(["a", "b", "c", "d"])
    rows = [r for r in rows if r[:2] != ("b", "s4")]  # b is not complete
    rows = [(p, s, math.nan if (p, s) == ("d", "s0") else float(v)) for p, s, v in rows] + [("a", "other", 1.0), ("a", "s1", 99.0), ("c", "s2", None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    blocks = wide.read_wide(spark, wide.write_wide(wide.assemble(df, SAMPLES, block=3), f"file://{tmp_path}/m"))
    got = {(r["TargetID"], r["block"]): list(r["values"]) for r in blocks.collect()}
    value = {(p, s): v for p, s, v in rows_of(["a", "b", "c", "d"])}
    assert got == {(p, b): [value[p, s] for s in SAMPLES[3 * b : 3 * b + 3]] for p in "ac" for b in range(3)}
    first = wide.columns_of(blocks, SAMPLES, 2, block=3)
    assert first.columns == ["TargetID", "s4"] and sorted(map(tuple, first.collect())) == [("a", 4.0), ("c", 24.0)]
    back = wide.in_long_form(blocks, SAMPLES, "MET_ID", "string", block=3)
    assert {(r["TargetID"], r["MET_ID"]): r["AVG_Beta"] for r in back.collect()} == {(p, s): value[p, s] for p in "ac" for s in SAMPLES}


def test_a_sample_without_readings_raises(spark):
    df = spark.createDataFrame([(p, s, float(v)) for p, s, v in rows_of(["a"])], SCHEMA)
    with pytest.raises(ValueError, match="s9"):
        wide.assemble(df, [*SAMPLES, "s9"])
    with pytest.raises(ValueError):
        wide.assemble(df, ["s1", "s1"])
    with pytest.raises(FileNotFoundError):
        wide.assemble(df, [])
    assert wide.assemble(df.where("MET_ID != 's1' OR TargetID = 'none'"), ["s0", "s2"], unique=True).count() == 1
