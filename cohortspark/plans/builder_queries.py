"""The cohort builders themselves, over stand-ins that carry the surveys' own codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.plans.registry import query
from cohortspark.plans.stand_ins import subject, table, with_tables
from cohortspark.sources import readers

# Shared name: an expression over ``subject`` that both engines read alike.
MEASURED = {
    "DIABETES": "custkey % 5", "SEX": "CASE WHEN sex = 'F' THEN 1 ELSE 2 END", "AGE": "qty / 4", "BMI": "CASE WHEN id % 97 = 0 THEN cast('NaN' AS double) ELSE qty + 1 END",
    "SIT_1_DIASTOLIC_PRESSURE": "disc * 100", "SIT_1_SYSTOLIC_PRESSURE": "tax * 100", "SIT_2_DIASTOLIC_PRESSURE": "disc * 50", "SIT_2_SYSTOLIC_PRESSURE": "tax * 50",
    "TG": "total / 1000", "LDL_C": "price / 1000", "T_CHO": "price / 500", "FASTING_GLUCOSE": "total / 1000", "FASTING_INSULIN": "qty / 3", "HBA1C": "disc", "HDL_C": "tax * 10",
    "BODY_WAISTLINE": "qty * 2", "SGPT": "disc * 3", "SGOT": "tax * 3", "BUN": "custkey % 7", "CREATININE": "tax", "URIC_ACID": "disc + tax",
}
PRESSURE = [n for n in MEASURED if n.endswith("PRESSURE")]
KEPT = [n for n in MEASURED if n not in PRESSURE]
MAP = "(2 * ((disc * 100 + disc * 50) / 2) + (tax * 100 + tax * 50) / 2) / 3"


def _coded(spark, sf_dir, codes: dict[str, str]) -> DataFrame:
    """Subjects with a survey's codes as column names, numbers as its files have them."""
    rows = subject(spark, sf_dir)
    return rows.select(*[F.expr("cast(id AS double)" if name == "Release_No" else f"cast({MEASURED[name]} AS double)").alias(code) for code, name in codes.items()], F.col("id").alias("_id"))


def _expected(columns: list[str], changed: dict[str, str]) -> str:
    shown = MEASURED | changed
    return ", ".join(f'round(({shown[c]})::DOUBLE, 6) AS "{c}"' for c in columns)


def _rounded(df: DataFrame, whole: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") if c in whole else F.round(F.col(f"`{c}`").cast("double"), 6).alias(c) for c in df.columns])


_INDEX = "(qty / 3) * (total / 1000) / 405"
_WHOLE = "qty IS NOT NULL AND price IS NOT NULL AND disc IS NOT NULL AND tax IS NOT NULL AND total IS NOT NULL AND id % 97 <> 0"


@query(with_tables("subject", f"""SELECT CASE WHEN id < 100000 THEN lpad(id::VARCHAR, 6, '0') ELSE id::VARCHAR END AS Release_No, {_expected(KEPT, {})},
    round({MAP}, 6) AS "MAP", round({_INDEX}, 6) AS "HOMA-IR", {_INDEX} > 2.5 AS "IR" FROM subject WHERE {_WHOLE} AND qty / 4 > 18 AND custkey % 5 IN (2, 3)"""))
def cohort_cycles(spark, sf_dir):
    """Two cycles, each of two component files that do not cover the same people."""
    rows = _coded(spark, sf_dir, readers.CYCLE_CODES)
    blood = ["LBXTR", "LBDLDL", "LBXTC", "LBXGLU", "LBXIN", "LBXGH", "LBDHDD"]
    cycles = []
    for half in (0, 1):
        part = rows.where(f"_id % 2 = {half}").drop("_id")
        # The second cycle carries one measurement under its other code.
        lab = part.select("SEQN", *blood).withColumnRenamed("LBDHDD", "LBDHDL" if half else "LBDHDD")
        merged = readers.merge_components([part.drop(*blood), lab.where("LBXTR IS NOT NULL")])
        cycles.append(readers.to_shared_schema(merged, readers.CYCLE_CODES))
    return _rounded(readers.process_cycles(cycles), ["Release_No", "IR"])


_LDL = "price / 500 - tax * 10 - total / 1000 / 5"


@query(with_tables("subject", f"""SELECT (id::DOUBLE)::VARCHAR AS Release_No, {_expected(KEPT, {"LDL_C": _LDL})}, round({MAP}, 6) AS "MAP", round({_INDEX}, 6) AS "HOMA-IR",
    {_INDEX} > 2.5 AS "IR", (2 - id % 3)::INT AS file_seq FROM subject WHERE {_WHOLE} AND qty / 4 > 18 AND custkey % 5 = 0 AND {_LDL} > 0"""))
def cohort_years(spark, sf_dir):
    """Three yearly files, listed out of order."""
    rows = _coded(spark, sf_dir, readers.YEARLY_CODES)
    files = [rows.where(f"_id % 3 = {2 - i}").drop("_id") for i in range(3)]
    return _rounded(readers.process_years(files), ["Release_No", "IR", "file_seq"])


_EXTERNAL = [c for c in KEPT if c in readers.MEASURES]


@query(with_tables("subject", f"""SELECT id::VARCHAR AS Release_No, round((qty / 4)::DOUBLE, 6) AS "AGE", CASE WHEN sex = 'F' THEN 1 ELSE 2 END::DOUBLE AS "SEX", {_expected(_EXTERNAL, {})},
    coalesce(m.MET_ID, '') AS "MET_ID", round({MAP}, 6) AS "MAP" FROM subject LEFT JOIN (
    SELECT vec_id, 'm' || vec_id AS MET_ID FROM embeddings UNION ALL SELECT vec_id, 'again' || vec_id FROM embeddings WHERE vec_id % 10 = 0) m ON vec_id = id
    WHERE {_WHOLE} AND custkey % 5 = 0 AND (id % 13) * 60 + id % 60 >= 480"""))
def cohort_external(spark, sf_dir):
    """Survey, measures and lab table, the last with some people twice; a fast of eight hours at least."""
    rows = subject(spark, sf_dir)
    key = F.col("id").cast("string").alias("Release_No")
    survey = rows.select(key, F.expr(MEASURED["DIABETES"]).alias("DIABETES"), F.expr(MEASURED["AGE"]).alias("AGE"), F.expr(MEASURED["SEX"]).alias("SEX"))
    fast = F.concat((F.col("id") % 13).cast("string"), F.lit(" hr "), (F.col("id") % 60).cast("string"), F.lit(" min"))
    measured = [F.expr(f"nanvl(cast({MEASURED[c]} AS double), null)").alias(c) for c in readers.MEASURES]
    measure = rows.select(key, *measured, fast.alias("FAST_TIME"))
    arrays = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("Release_No"), "vec_id")
    lab = arrays.select("Release_No", F.concat(F.lit("m"), "Release_No").alias("MET_ID"))
    lab = lab.unionByName(arrays.where("vec_id % 10 = 0").select("Release_No", F.concat(F.lit("again"), "Release_No").alias("MET_ID")))
    return _rounded(readers.process_external(survey, measure, lab), ["Release_No", "MET_ID"])


@query(with_tables("subject", """WITH d AS (SELECT custkey, total, label, row_number() OVER (PARTITION BY custkey ORDER BY total) AS rk, count(*) OVER (PARTITION BY custkey) AS n,
    count(*) OVER (PARTITION BY custkey, total) AS t FROM subject WHERE label IS NOT NULL),
    g AS (SELECT custkey, count(*) FILTER (NOT label) AS n1, count(*) FILTER (label) AS n2, sum(rk) FILTER (NOT label) AS r1, max(t) AS t FROM d GROUP BY custkey),
    s AS (SELECT *, (r1 - n1 * (n1 + 1) // 2)::INT AS u FROM g WHERE n1 BETWEEN 1 AND 4 AND n2 BETWEEN 1 AND 12 AND t = 1),
    w AS (SELECT n1, n2, u, count(*) AS ways FROM (
        SELECT a.n1, a.n2, (len(list_filter(range(a.n1 + a.n2), lambda i: (m >> i) & 1 = 1)) * 0
            + list_sum(list_transform(list_filter(range(a.n1 + a.n2), lambda i: (m >> i) & 1 = 1), lambda i: i + 1)) - a.n1 * (a.n1 + 1) // 2)::INT AS u
        FROM (SELECT DISTINCT n1, n2 FROM s) a, LATERAL (SELECT unnest(range(1, (1 << (a.n1 + a.n2)::INT))) AS m) WHERE bit_count(m::BIGINT) = a.n1) GROUP BY ALL),
    c AS (SELECT s.custkey, s.n1, s.n2, s.u, least(1.0, 2 * sum(ways) FILTER (w.u <= least(s.u, s.n1 * s.n2 - s.u)) / sum(ways)) AS p
        FROM s JOIN w ON w.n1 = s.n1 AND w.n2 = s.n2 GROUP BY ALL)
    SELECT custkey, n1 AS n_neg, n2 AS n_pos, u::DOUBLE AS u_stat, round(p, 9) AS u_p FROM c"""))
def mannwhitney_small(spark, sf_dir):
    """Exact rank-sum p-values of small groups, against a count of all choices of ranks."""
    from cohortspark.operators import hypothesis

    tested = hypothesis.mann_whitney(subject(spark, sf_dir), ["custkey"], "total", F.col("label"))
    return tested.where("n_neg BETWEEN 1 AND 4 AND n_pos BETWEEN 1 AND 12").select("custkey", "n_neg", "n_pos", "u_stat", F.round("u_p", 9).alias("u_p"))
