"""Cleaning, features, joins, sources, annotation, enrichment."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortspark.functions import text
from cohortspark.operators import annotate, clean, describe, enrich, features, joins, matrix
from cohortspark.sources import readers, writers

VARIABLES_17 = [
    "AGE", "BMI", "BODY_WAISTLINE", "BUN", "CREATININE", "FASTING_GLUCOSE", "HBA1C", "HDL_C", "LDL_C", "MAP", "SEX", "SGOT", "SGPT", "TG",
    "T_CHO", "URIC_ACID",
]


def test_index_formula_and_strict_label(spark):
    df = spark.createDataFrame([(10.0, 101.0), (10.0, 101.25), (10.0, 102.0)], "FASTING_INSULIN double, FASTING_GLUCOSE double")
    got = clean.add_index_label(df, "FASTING_INSULIN", "FASTING_GLUCOSE").collect()
    assert [r["HOMA-IR"] for r in got] == pytest.approx([10 * g / 405 for g in (101.0, 101.25, 102.0)])
    assert got[1]["HOMA-IR"] == clean.INDEX_CUTOFF
    assert [r["IR"] for r in got] == [False, False, True]


def test_interaction_columns(spark):
    df = spark.createDataFrame([(40.0, 22.0, 90.0), (50.0, 27.0, 150.0)], "AGE double, BMI double, TG double")
    made = features.generate_interactions(df, code=2)
    assert len(made.columns) == 3 + 1 + 2 + 3 * 2 and made.columns == sorted(made.columns)
    rows = made.collect()
    assert [r["RACE"] for r in rows] == [2, 2]
    assert rows[0]["BMI_mul_TG"] == 22 * 90 and rows[0]["BMI_div_TG"] == 22 / 90 and rows[0]["TG_log"] == pytest.approx(math.log10(90))
    assert "TG_div_BMI" not in made.columns


@pytest.mark.parametrize("values,kept", [((1.0, 2.0), 1), ((0.0, 2.0), 0), ((-1.0, 2.0), 0), ((None, 2.0), 0), ((float("nan"), 2.0), 0),
                                         ((1e200, 2.0), 0), ((1e-200, 1e150), 1), ((1e150, 1e-200), 0), ((1e154, 1.0), 1)])
def test_rows_with_a_non_finite_feature_go(spark, values, kept):
    df = spark.createDataFrame([values], "B double, T double")
    made = features.generate_interactions(df)
    assert made.count() == kept
    # The short test equals testing every generated column.
    full = features.feature_expressions(["B", "T"])
    slow = df.select(*[c.alias(n) for n, c in full.items()])
    finite = [F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")) for n in full]
    assert slow.where(F.expr("true") if not finite else finite[0] & finite[1] & finite[2] & finite[3] & finite[4] & finite[5] & finite[6] & finite[7]).count() == kept


def test_full_schema_and_feature_sets(spark):
    row = tuple([1] + [float(i + 2) for i in range(len(VARIABLES_17))] + [8.0, 2.0, True, 0])
    schema = "Release_No int, " + ", ".join(f"{v} double" for v in VARIABLES_17) + ", FASTING_INSULIN double, `HOMA-IR` double, IR boolean, DIABETES int"
    labelled = features.generate_interactions(spark.createDataFrame([row], schema))
    # 16 bases: 48 transforms and 240 pairs beside 22 plain columns.
    assert len(labelled.columns) == 48 + 240 + 22
    training = features.drop_target_derived(labelled)
    sets = features.ablation_feature_sets(training.columns)
    assert {n: len(c) for n, c in sets.items()} == {
        "baseline": 9, "baseline + interactions": 57, "extended": 17, "extended + interactions": 241
    }
    assert set(sets["baseline"]) <= set(sets["extended"]) <= set(sets["extended + interactions"])
    unlabelled = features.generate_interactions(spark.createDataFrame([row[: len(VARIABLES_17) + 1]], schema.split(", FASTING_INSULIN")[0]))
    assert len(unlabelled.columns) == 3 * 14 + 14 * 13 + 18


def test_leaks_are_dropped(spark):
    df = spark.createDataFrame(
        [(1, 40.0, 3.0, 1.1, 4.0, 0, True)],
        "Release_No int, AGE double, `HOMA-IR` double, `log(HOMA-IR)` double, FASTING_INSULIN_mul_AGE double, DIABETES int, IR boolean",
    )
    assert features.drop_target_derived(df).columns == ["AGE", "IR"]


def test_text_functions(spark):
    df = spark.createDataFrame(
        [("8 hr 30 min", 42.0, "Regulation of p27 Phosphorylation during Cell Cycle Progression Homo sapiens h p27Pathway", "a;b"),
         ("none", 1234567.0, "duringx y", None)],
        "d string, n double, t string, l string",
    )
    got = df.select(
        text.duration_minutes(F.col("d")).alias("m"), text.zero_padded(F.col("n")).alias("z"), text.wrap_term(F.col("t")).alias("w"),
        text.first_item(F.col("l")).alias("f"),
    ).collect()
    assert [r["m"] for r in got] == [510, None]
    assert [r["z"] for r in got] == ["000042", "1234567"]
    assert got[0]["w"] == "Regulation of p27 Phosphorylation\nduring Cell Cycle Progression\nHomo sapiens h p27Pathway"
    assert got[1]["w"] == "duringx y" and [r["f"] for r in got] == ["a", ""]
    with pytest.raises(Exception):
        df.select(text.duration_minutes(F.col("d"), on_bad="error")).collect()
    names = spark.createDataFrame([("BMI_mul_TG",), ("TG_div_T_CHO",), ("FASTING_GLUCOSE_log",), ("TG_square",)], "n string")
    shown = [r[0] for r in names.select(text.pretty_feature(F.col("n"))).collect()]
    assert shown == ["BMI×TG", "TG/T_CHO", "log(FASTING_GLUCOSE)", "square(TG)"]
    p = spark.createDataFrame([(0.009,), (0.01,)], "p double").select(text.reported_p(F.col("p")).alias("r"), text.reported_p(F.col("p"), None).alias("a"))
    assert [tuple(r) for r in p.collect()] == [("< 0.01", "0.009"), ("0.01", "0.01")]


def test_cycle_components(spark, tmp_path):
    survey = spark.createDataFrame([(1.0, 2.0, 30.0), (2.0, 1.0, 40.0), (3.0, 3.0, 18.0)], "SEQN double, DIQ010 double, RIDAGEYR double")
    old = spark.createDataFrame([(1.0, 50.0)], "SEQN double, LBDHDL double")
    new = spark.createDataFrame([(2.0, 60.0), (4.0, 70.0)], "SEQN double, LBXHDD double")
    paths = []
    for i, frame in enumerate((survey, old, new)):
        paths.append(writers.write_parquet(frame, str(tmp_path / f"c{i}")))
    codes = {c: readers.CYCLE_CODES[c] for c in ("SEQN", "DIQ010", "RIDAGEYR", "LBDHDD")}
    got = {r["Release_No"]: tuple(r)[1:] for r in readers.read_cycle(spark, paths, mapping=codes).collect()}
    assert got == {1.0: (2.0, 30.0, 50.0), 2.0: (1.0, 40.0, 60.0), 3.0: (3.0, 18.0, None), 4.0: (None, None, 70.0)}


def coded(spark, codes, **changes):
    base = {name: 10.0 for name in codes}
    return spark.createDataFrame([tuple((base | c).values()) for c in changes["rows"]], ", ".join(f"`{n}` double" for n in codes))


def test_cycle_cohort(spark):
    codes = readers.CYCLE_CODES
    ok = {"SEQN": 42.0, "DIQ010": 2.0, "RIDAGEYR": 19.0, "BPXDI2": 60.0, "BPXDI3": 80.0, "BPXSY2": 110.0, "BPXSY3": 130.0}
    rows = [ok, ok | {"RIDAGEYR": 18.0}, ok | {"DIQ010": 1.0}, ok | {"LBXIN": float("nan")}, ok | {"DIQ010": 3.0, "SEQN": 7.0}]
    cohort = readers.process_cycles([readers.to_shared_schema(coded(spark, codes, rows=rows), codes)])
    got = {r["Release_No"]: r for r in cohort.collect()}
    assert set(got) == {"000042", "000007"}
    assert got["000042"]["MAP"] == pytest.approx((2 * 70 + 120) / 3) and len(cohort.columns) == 21
    assert not any(c.endswith("PRESSURE") for c in cohort.columns)


def test_yearly_cohort(spark):
    codes = readers.YEARLY_CODES
    ok = {"ID": 1.0, "DE1_dg": 0.0, "age": 30.0, "HE_chol": 200.0, "HE_HDL_st2": 50.0, "HE_TG": 100.0}
    first = coded(spark, codes, rows=[ok, ok | {"HE_TG": 800.0}, ok | {"HE_LDL_drct": float("nan"), "ID": 2.0}])
    second = coded(spark, codes, rows=[ok | {"ID": 3.0}])
    got = readers.process_years([first, second]).select("Release_No", "LDL_C", "file_seq").orderBy("file_seq", "Release_No").collect()
    assert [(r["LDL_C"], r["file_seq"]) for r in got] == [(130.0, 0), (130.0, 0), (130.0, 1)]


def test_external_cohort(spark, tmp_path):
    names = readers.MEASURES
    (tmp_path / "survey.csv").write_text("Release_No,FOLLOW,DIABETES,AGE,SEX\na,Baseline,0,17,1\nb,Baseline,1,40,2\nc,Follow1,0,40,2\nd,Baseline,x,40,2\ne,Baseline,0,50,1\n")
    head = "Release_No,FOLLOW," + ",".join(names) + ",FAST_TIME\n"
    line = lambda k, t: f"{k},Baseline," + ",".join("10" for _ in names) + f",{t}\n"
    (tmp_path / "measure.csv").write_text(head + line("a", "10 h 5 m") + line("b", "9:00") + line("d", "9:00") + line("e", "7 h 59 m"))
    (tmp_path / "lab.csv").write_text("Release_No,FOLLOW,MET_ID\na,Baseline,m1\na,Baseline,m2\n")
    survey = readers.read_baseline(spark, str(tmp_path / "survey.csv"), readers.SURVEY_SCHEMA, ["Release_No", "DIABETES", "AGE", "SEX"])
    measure = readers.read_baseline(spark, str(tmp_path / "measure.csv"), readers.MEASURE_SCHEMA, ["Release_No", *names, "FAST_TIME"])
    lab = readers.read_baseline(spark, str(tmp_path / "lab.csv"), readers.LAB_SCHEMA, ["Release_No", "MET_ID"])
    cohort = readers.process_external(survey, measure, lab)
    # No age filter here; two laboratory rows give two rows.
    assert sorted((r["Release_No"], r["MET_ID"], r["AGE"]) for r in cohort.collect()) == [("a", "m1", 17), ("a", "m2", 17)]
    assert len(cohort.columns) == 18


def test_sample_files_and_matrix(spark, tmp_path):
    for sample, lines in {"s1": ["cg1\t0.5\t0.0001", "cg2\t0.4\t0.01", "rs1\t0.1\t0"], "s2": ["cg1\t0.7\t0", "cg2\tbad\t0", "cg3\t0.2\t0"]}.items():
        folder = tmp_path / "MET" / sample
        folder.mkdir(parents=True)
        (folder / f"{sample}_nor.txt").write_text("TargetID\tAVG_Beta\tDetection Pval\n" + "\n".join(lines) + "\n")
    (tmp_path / "manifest.tsv").write_text("Probe_ID\tCHR\tUCSC_REFGENE_NAME\ncg1\t1\tA;B\ncg2\t2\t\ncg3\tX\tC\nrs1\t4\t\ncg4\t\tD\n")
    manifest = readers.read_manifest(spark, str(tmp_path / "manifest.tsv"))
    eligible = matrix.eligible_probes(manifest)
    assert sorted(r[0] for r in eligible.collect()) == ["cg1", "cg2"]
    read = readers.read_sample_readings(spark, str(tmp_path / "MET"))
    got = {(r["TargetID"], r["MET_ID"]): r["AVG_Beta"] for r in readers.annotated_readings(read, manifest).collect()}
    assert got == {("cg1", "s1"): 0.5, ("rs1", "s1"): 0.1, ("cg1", "s2"): 0.7, ("cg2", "s2"): None}
    path = writers.write_samples(read.select("TargetID", "AVG_Beta", "MET_ID"), str(tmp_path / "parquet"))
    kept = matrix.complete_readings(readers.read_samples(spark, path), eligible, 2)
    assert sorted((r["TargetID"], r["MET_ID"]) for r in kept.collect()) == [("cg1", "s1"), ("cg1", "s2")]
    wide = matrix.wide_matrix(kept, ["s1", "s2"]).first()
    assert (wide["TargetID"], wide["s1"], wide["s2"]) == ("cg1", 0.5, 0.7)
    # A sample without any reading makes every probe incomplete.
    assert matrix.complete_readings(readers.read_samples(spark, path), eligible, 3).count() == 0
    with pytest.raises(FileNotFoundError):
        readers.read_samples(spark, str(tmp_path / "nothing"))
    with pytest.raises(FileNotFoundError):
        matrix.complete_readings(read, None, 0)


def test_sheets_and_csv(spark, tmp_path):
    a, b = spark.createDataFrame([("x", 1)], "k string, n int"), spark.createDataFrame([("y", 2.5)], "k string, v double")
    path = writers.write_sheets({"one": a, "two": b}, str(tmp_path / "sheets"))
    assert [tuple(r) for r in readers.read_csv_table(spark, writers.write_csv(a, str(tmp_path / "csv"), single=True), "k string, n int").collect()] == [("x", 1)]
    assert writers.read_sheet(spark, path, "two").select("k", "v").first() == ("y", 2.5)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_ways_agree(spark, how):
    draw = random.Random(2)
    big = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{draw.randint(0, 9)}") for i in range(90)] + [(99, None)], "i int, k string")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), ("none", 5), (None, 6)], "key string, v int")
    plain = joins.lookup_join(big, small, [("k", "key")], how)
    shuffled = joins.lookup_join(big, small, [("k", "key")], how, max_rows=0)
    salted = joins.lookup_join(big, small, [("k", "key")], how, max_rows=0, heavy_rows=10)
    def sort(df):
        return sorted(map(tuple, df.collect()), key=str)
    assert sort(plain) == sort(shuffled) == sort(salted)
    assert plain.columns == shuffled.columns == salted.columns


@pytest.mark.parametrize("max_rows", [1000, 0])
def test_points_in_intervals(spark, max_rows):
    draw = random.Random(4)
    points = [(i, draw.randint(0, 2), draw.randint(0, 2000)) for i in range(120)] + [(500, None, 3), (501, 1, None)]
    intervals = []
    for j in range(80):
        start = draw.randint(0, 1900)
        intervals.append((j, draw.randint(0, 2), start, start + draw.choice([0, 1, 2, 7, 64, 300, 2000])))
    got = joins.points_in_intervals(
        spark.createDataFrame(points, "id int, chrom int, pos int"), spark.createDataFrame(intervals, "j int, chrom int, tx_start int, tx_end int"), "id",
        max_rows=max_rows,
    )
    wanted = []
    for i, c, p in points:
        hits = [j for j, d, s, e in intervals if c is not None and p is not None and d == c and s < p <= e]
        wanted += [(i, j) for j in hits] or [(i, None)]
    assert sorted(((r["id"], r["j"]) for r in got.collect()), key=str) == sorted(wanted, key=str)


def test_alignment_is_checked(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(2, 5), (1, 4)], "k int, b int")
    assert sorted(map(tuple, joins.attach_checked(a, b, "k").collect())) == [(1, "x", 4), (2, "y", 5)]
    for other in ([(1, 4)], [(1, 4), (2, 5), (3, 6)], [(1, 4), (2, 5), (2, 6)]):
        with pytest.raises(Exception, match="not aligned"):
            joins.attach_checked(a, spark.createDataFrame(other, "k int, b int"), "k").collect()


def test_region_classes(spark):
    rows = [
        ("inside", 50, 10, 90, "cmpl", "cmpl"), ("inside", 50, 60, 90, "incmpl", "incmpl"), ("edge", 10, 10, 90, "cmpl", "cmpl"),
        ("incomplete", 50, 10, 90, "incmpl", "incmpl"), ("incomplete", 50, 60, 90, "cmpl", "cmpl"), ("unknown", 5, 1, 9, "none", "none"),
        ("alone", 5, None, None, None, None), ("outside", 50, 60, 90, "cmpl", "cmpl"), ("half", 50, 10, 90, "cmpl", "incmpl"),
    ]
    df = spark.createDataFrame(rows, "TargetID string, Position int, cdsStart int, cdsEnd int, cdsStartStat string, cdsEndStat string")
    got = {r["TargetID"]: r["coding"] for r in annotate.classify_region(df).collect()}
    assert got == {
        "inside": "coding", "edge": "coding", "incomplete": "non_coding", "unknown": "non_coding", "alone": "no_annotate", "outside": None, "half": None
    }
    assert {r["TargetID"]: r["coding"] for r in annotate.classify_region(df, outside_label="outside_cds").collect()}["outside"] == "outside_cds"
    assert {r["TargetID"]: r["coding"] for r in annotate.classify_region(df, zero_based_start=True).collect()}["edge"] is None


def test_gene_list(spark):
    df = spark.createDataFrame([("A;A;B",), ("",), (None,), ("OLD;B",)], "g string")
    aliases = spark.createDataFrame([("OLD", "NEW")], "alias string, official string")
    assert sorted(r[0] for r in annotate.gene_list(df, "g").collect()) == ["A", "B", "OLD"]
    assert sorted(r[0] for r in annotate.gene_list(df, "g", aliases=aliases).collect()) == ["A", "B", "NEW"]


def test_enrichment(spark):
    sets = {("L", "t1"): "abcd", ("L", "t2"): "cdefg", ("L", "t3"): "hij", ("M", "u"): "ax"}
    df = spark.createDataFrame([(l, t, g) for (l, t), genes in sets.items() for g in genes], "library string, term string, gene string")
    query = spark.createDataFrame([(g,) for g in "abcz"], "gene string")
    got = {(r["library"], r["term"]): r for r in enrich.over_representation(query, df, alpha=None).collect()}
    assert set(got) == {("L", "t1"), ("L", "t2"), ("M", "u")}
    r = got["L", "t1"]
    assert (r["n_overlap"], r["n_term"], r["n_query"], r["n_background"]) == (3, 4, 3, 10)
    assert r["p"] == pytest.approx(math.comb(4, 3) / math.comb(10, 3))
    other = 1 - math.comb(5, 3) / math.comb(10, 3)
    assert got["L", "t2"]["p"] == pytest.approx(other)
    assert r["adj_p"] == pytest.approx(min(2 * r["p"], other))
    assert r["combined"] == pytest.approx(-math.log(r["p"]) * (3.5 * 6.5) / (1.5 * 0.5))
    assert enrich.over_representation(query, df, alpha=0.1).count() == 1
    top = enrich.top_terms(enrich.over_representation(query, df, alpha=None), 1)
    lists = {(r["library"], r["term"]): r["genes"] for r in enrich.overlap_genes(query, df, top).collect()}
    assert lists == {("L", "t1"): "a;b;c", ("M", "u"): "a"}


def test_volcano_keeps_extreme_probes(spark):
    rows = [("zero_q", 0.0, 0.5, 0.8), ("zero_med", 0.001, 0.0, 0.8), ("both_zero", 0.001, 0.0, 0.0), ("weak", 0.5, 0.5, 0.8), ("none", None, 0.5, 0.8)]
    df = spark.createDataFrame(rows, "TargetID string, adj_u_p double, med_neg double, med_pos double")
    df = df.withColumns({"sum_neg": F.lit(1.0), "n_neg": F.lit(2), "sum_pos": F.lit(3.0), "n_pos": F.lit(4)})
    got = {r["TargetID"]: r for r in matrix.volcano(df).collect()}
    assert [k for k, r in got.items() if r["significant"]] == ["zero_q", "zero_med"]
    assert got["zero_q"]["neg_log10_p"] == math.inf and got["both_zero"]["log2_fc"] is None and got["weak"]["mean_pos"] == 0.75


def test_descriptive_tables(spark):
    rows = [(1, True, 1.0), (1, False, 2.0), (2, True, 3.0), (2, False, 5.0), (2, False, 8.0), (1, False, 4.0)]
    df = spark.createDataFrame(rows, "SEX int, IR boolean, x double")
    block = {r["level"]: r for r in describe.count_block(df, "SEX", "IR").collect()}
    assert (block["total"]["n_all"], block["total"]["n_neg"], block["total"]["n_pos"]) == (6, 4, 2)
    assert block["1"]["share_neg"] == 0.5 and block["2"]["share_pos"] == 0.5
    cells = {r["level"]: r["cell_all"] for r in describe.count_cells(describe.count_block(df, "SEX", "IR")).collect()}
    assert cells == {"total": "6", "1": "3(50.0%)", "2": "3(50.0%)"}
    r = describe.descriptive_statistics(df, ["x"], "IR").first()
    assert r["mean_all"] == pytest.approx(23 / 6) and r["cell_pos"] == "2.0±1.4" and 0 < r["u_p"] <= 1
    weights = describe.class_weights(df, "IR").first()
    assert (weights["positive_weight"], weights["balanced_neg"], weights["balanced_pos"]) == (2.0, 0.75, 1.5)


def test_cascade_never_grows(spark):
    df = spark.createDataFrame([(None,), (1,), (5,), (9,)], "x int")
    got = [tuple(r) for r in clean.cascade(df, {"known": F.col("x").isNotNull(), "big": F.col("x") > 1, "huge": F.col("x") > 6}).orderBy("step").collect()]
    assert got == [(0, "read", 4), (1, "known", 3), (2, "big", 2), (3, "huge", 1)]


def test_correlation_is_pairwise_complete(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, 6.0, 0.0), (None, 1.0, 5.0)], "a double, b double, c double")
    got = {(r["x"], r["y"]): r["r"] for r in describe.correlation_long(df, ["a", "b", "c"]).collect()}
    assert set(got) == set(itertools.combinations("cba", 2)) and got["b", "a"] == pytest.approx(1)


def test_text_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "lab.csv").write_text("NOTE,MET_ID,FOLLOW,AGE,Release_No\nx,m1,Baseline,41,007\ny,m2,Later,42,008\nz,,Baseline,old,009\n")
    schema = "Release_No string, FOLLOW string, AGE bigint, MET_ID string"
    read = readers.read_baseline(spark, str(tmp_path / "lab.csv"), StructType.fromDDL(schema), ["Release_No", "AGE", "MET_ID"])
    assert sorted(tuple(r) for r in read.collect()) == [("007", 41, "m1"), ("009", None, None)]
    with pytest.raises(ValueError, match="HEIGHT"):
        readers.read_csv_table(spark, str(tmp_path / "lab.csv"), "Release_No string, HEIGHT double")
    folder = tmp_path / "MET"
    folder.mkdir()
    (folder / "s1_nor.txt").write_text("Index\tDetection Pval\tTargetID\tAVG_Beta\n1\t0.0001\tcg1\t0.5\n2\t0.2\tcg2\t0.6\n")
    assert [(r["TargetID"], r["AVG_Beta"], r["MET_ID"]) for r in readers.read_sample_readings(spark, str(folder)).collect()] == [("cg1", 0.5, "s1")]


def test_lookups_keep_no_lonely_rows(spark):
    rows = spark.createDataFrame([(1,)], "k int")
    for how in ("right", "full_outer"):
        with pytest.raises(ValueError):
            joins.lookup_join(rows, rows, ["k"], how)


def test_generated_names_in_lower_case():
    names = ["qty", "total", "logo", "qty_square", "qty_log", "qty_mul_total", "logo_div_qty", "multi_mul_x"]
    assert features.ablation_feature_sets([*names, "IR"], base=["qty"])["extended"] == ["qty", "total", "logo", "multi_mul_x"]


def test_a_missing_label_has_no_sign(spark):
    shown = spark.createDataFrame([(True,), (False,), (None,)], "l boolean").select(text.signed_label(F.col("l"))).collect()
    assert [r[0] for r in shown] == ["IR+", "IR-", None]


@pytest.mark.parametrize("names", [["1", "007", "3", "12"], ["1", "2", "9876543210", "4"], ["1", "02", "s3", "a b[1],c%d"]])
def test_many_samples_are_written_and_read_in_batches(spark, tmp_path, names):
    rows = spark.createDataFrame([(f"cg{i}", i / 10 + k, n) for k, n in enumerate(names) for i in range(3)], "TargetID string, AVG_Beta double, MET_ID string")
    for folder in ("flat", "groups"):
        save = lambda df, to: writers.write_parquet(df, to, ["MET_ID"])
        path = writers.write_folders(rows, str(tmp_path / folder), "MET_ID", save, at_once=1 if folder == "groups" else None)
        assert (tmp_path / folder / "MET_ID=1").exists() == (folder == "flat") and len(list((tmp_path / folder).glob("**/MET_ID=*"))) == 4
        whole, batches = readers.read_samples(spark, str(tmp_path / "flat")), readers.read_samples(spark, path, at_once=1)
        assert batches.schema == whole.schema and sorted(map(tuple, batches.collect())) == sorted(map(tuple, whole.collect()))
        assert len(list(readers.folder_batches(spark, path, 1))) == 4
        # A batch keeps no record of the others' files: the result reads the kept copy alone.
        assert not any(str(tmp_path) in f for f in batches.inputFiles())


def test_text_samples_are_read_in_batches(spark, tmp_path):
    for k in range(5):
        folder = tmp_path / "MET" / f"s{k}"
        folder.mkdir(parents=True)
        (folder / f"s{k}_nor.txt").write_text(f"TargetID\tAVG_Beta\tDetection Pval\ncg1\t0.{k}\t0\ncg2\t0.5\t0.4\n")
    whole = readers.read_sample_readings(spark, str(tmp_path / "MET"))
    batches = readers.read_sample_readings(spark, str(tmp_path / "MET"), at_once=2)
    assert sorted(map(tuple, batches.collect())) == sorted(map(tuple, whole.collect())) and batches.count() == 5
    assert not any(str(tmp_path) in f for f in batches.inputFiles())
    (tmp_path / "MET" / "s4" / "s4_nor.txt").write_text("TargetID\tAVG_Beta\ncg1\t0.5\n")
    with pytest.raises(ValueError, match="Detection Pval"):
        readers.read_sample_readings(spark, str(tmp_path / "MET"), at_once=2)
