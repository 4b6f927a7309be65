"""Two-group tests, corrections, probes, annotation, enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions.numeric import uniform
from cohortspark.operators import annotate, describe, enrich, hypothesis, joins, matrix, multiple
from cohortspark.plans.cohort_queries import VARIABLES
from cohortspark.plans.registry import query
from cohortspark.plans.stand_ins import (
    SEED, complete_subject, gene_sets, kept_readings, manifest, probe_positions, query_genes, readings, sql_normal_two_sided,
    sql_student_two_sided, sql_uniform, subject, table, transcripts, with_tables,
)


def _rounded(df, whole: list[str], digits: int = 6):
    return df.select(*whole, *[F.round(c, digits).alias(c) for c in df.columns if c not in whole])


@query(with_tables("kept_readings", "SELECT DISTINCT TargetID FROM kept_readings"))
def complete_probes(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").count()
    return joins.complete_keys(readings(spark, sf_dir), "TargetID", "MET_ID", "AVG_Beta", n)


@query(with_tables("readings", """SELECT TargetID, MET_ID, AVG_Beta FROM readings WHERE TargetID IN (
    SELECT TargetID FROM readings WHERE det_p < 0.001)"""))
def semi_probes(spark, sf_dir):
    rows = readings(spark, sf_dir)
    listed = matrix.usable_readings(rows).select("TargetID").distinct()
    return joins.keep_keys(rows.select("TargetID", "MET_ID", "AVG_Beta"), listed, "TargetID")


@query(with_tables("readings", """SELECT TargetID, MET_ID, AVG_Beta FROM readings WHERE TargetID NOT IN (
    SELECT TargetID FROM readings WHERE det_p < 0.001)"""))
def anti_probes(spark, sf_dir):
    rows = readings(spark, sf_dir)
    listed = matrix.usable_readings(rows).select("TargetID").distinct()
    return joins.drop_keys(rows.select("TargetID", "MET_ID", "AVG_Beta"), listed, "TargetID")


@query(with_tables("kept_readings", """SELECT TargetID, count(*) FILTER (NOT positive) AS n_neg, count(*) FILTER (positive) AS n_pos,
    round(sum(AVG_Beta) FILTER (NOT positive), 6) AS sum_neg, round(sum(AVG_Beta) FILTER (positive), 6) AS sum_pos,
    round(avg(AVG_Beta) FILTER (NOT positive), 6) AS mean_neg, round(avg(AVG_Beta) FILTER (positive), 6) AS mean_pos,
    round(stddev_samp(AVG_Beta) FILTER (NOT positive), 6) AS sd_neg, round(stddev_samp(AVG_Beta) FILTER (positive), 6) AS sd_pos,
    round(quantile_cont(AVG_Beta, 0.5) FILTER (NOT positive), 6) AS med_neg, round(quantile_cont(AVG_Beta, 0.5) FILTER (positive), 6) AS med_pos
    FROM kept_readings GROUP BY TargetID"""))
def probe_group_stats(spark, sf_dir):
    stats = matrix.probe_statistics(kept_readings(spark, sf_dir), F.col("positive"), tests=())
    return _rounded(stats, ["TargetID", "n_neg", "n_pos"])


_RANKED = """r AS (SELECT {key} AS k, {pos} AS g, rank() OVER (PARTITION BY {key} ORDER BY {v}) + (count(*) OVER (PARTITION BY {key}, {v}) - 1) / 2.0 AS rk,
    count(*) OVER (PARTITION BY {key}, {v}) AS t FROM {source}),
u AS (SELECT k, count(*) FILTER (NOT g) AS n1, count(*) FILTER (g) AS n2, count(*)::DOUBLE AS n, sum(rk) FILTER (NOT g) AS r1,
    sum(t::DOUBLE * t - 1) AS ties FROM r GROUP BY k),
z AS (SELECT k, n1, n2, r1 - n1 * (n1 + 1) / 2 AS u1,
    (greatest(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2)) - n1 * n2 / 2 - 0.5)
    / sqrt(n1::DOUBLE * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) AS zz FROM u)"""


def _ranked(key: str, v: str, pos: str, source: str) -> str:
    return _RANKED.format(key=key, v=v, pos=pos, source=source)


@query(with_tables("kept_readings", f"""WITH {_ranked('TargetID', 'AVG_Beta', 'positive', 'kept_readings')}
    SELECT k AS TargetID, n1 AS n_neg, n2 AS n_pos, u1::DOUBLE AS u_stat, round({sql_normal_two_sided('zz')}, 6) AS u_p FROM z"""))
def mannwhitney_probe(spark, sf_dir):
    tested = hypothesis.mann_whitney(kept_readings(spark, sf_dir), ["TargetID"], "AVG_Beta", F.col("positive"))
    return tested.withColumn("u_p", F.round("u_p", 6))


@query(with_tables("predictions", f"""WITH {_ranked('cohort', 'p', 'y = 1', 'predictions')}
    SELECT k AS cohort, n1 AS n_neg, n2 AS n_pos, u1::DOUBLE AS u_stat, round(u1 / (n1::DOUBLE * n2), 6) AS below, round({sql_normal_two_sided('zz')}, 6) AS u_p FROM z"""))
def mannwhitney_ties(spark, sf_dir):
    from cohortspark.plans.stand_ins import predictions

    tested = hypothesis.mann_whitney(predictions(spark, sf_dir), ["cohort"], "p", F.col("y") == 1)
    below = F.round(F.col("u_stat") / (F.col("n_neg").cast("double") * F.col("n_pos")), 6)
    return tested.select("cohort", "n_neg", "n_pos", "u_stat", below.alias("below"), F.round("u_p", 6).alias("u_p"))


@query(with_tables("kept_readings", f"""WITH m AS (SELECT TargetID, count(*) FILTER (NOT positive) AS n1, count(*) FILTER (positive) AS n2,
    avg(AVG_Beta) FILTER (NOT positive) AS m1, avg(AVG_Beta) FILTER (positive) AS m2,
    var_samp(AVG_Beta) FILTER (NOT positive) / count(*) FILTER (NOT positive) AS a, var_samp(AVG_Beta) FILTER (positive) / count(*) FILTER (positive) AS b
    FROM kept_readings GROUP BY TargetID),
    t AS (SELECT *, (m1 - m2) / sqrt(a + b) AS t, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)) AS df FROM m)
    SELECT TargetID, n1 AS n_neg, n2 AS n_pos, round(t, 6) AS t_stat, round(df, 4) AS t_df, round({sql_student_two_sided('t', 'df')}, 6) AS t_p FROM t"""))
def welch_probe(spark, sf_dir):
    tested = hypothesis.welch(kept_readings(spark, sf_dir), ["TargetID"], "AVG_Beta", F.col("positive"))
    return tested.select(
        "TargetID", "n_neg", "n_pos", F.round("t_stat", 6).alias("t_stat"), F.round("t_df", 4).alias("t_df"), F.round("t_p", 6).alias("t_p")
    )


@query(with_tables("subject", """WITH s AS (SELECT cohort, sex = 'F' AS g, total AS v FROM subject),
    c AS (SELECT cohort, v, count(*) FILTER (NOT g) AS a, count(*) FILTER (g) AS b FROM s GROUP BY cohort, v),
    e AS (SELECT cohort, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY cohort) AS ta, sum(b) OVER (PARTITION BY cohort) AS tb
          FROM c WINDOW w AS (PARTITION BY cohort ORDER BY v))
    SELECT cohort, max(ta)::BIGINT AS n_neg, max(tb)::BIGINT AS n_pos, round(max(abs(ca / ta - cb / tb)), 6) AS ks_d FROM e GROUP BY cohort"""))
def ks_two_sample(spark, sf_dir):
    tested = hypothesis.ks_two_sample(subject(spark, sf_dir), ["cohort"], "total", F.col("sex") == "F")
    return tested.select("cohort", "n_neg", "n_pos", F.round("ks_d", 6).alias("ks_d"))


def _near_limit(d: str, n, p: str):
    """Whether a p-value is within 0.03 of the limiting distribution, with its usual correction for small n."""
    scaled = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * F.col(d)
    series = sum((2 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * scaled * scaled) for k in range(1, 30)), F.lit(0.0))
    limit = F.when(scaled < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
    return (F.abs(F.col(p) - limit) < 0.03) & F.col(p).between(0, 1)


@query(with_tables("subject", """SELECT cohort, count(*) FILTER (sex <> 'F') AS n_neg, count(*) FILTER (sex = 'F') AS n_pos, TRUE AS near_limit
    FROM subject WHERE total IS NOT NULL AND sex IS NOT NULL GROUP BY cohort"""))
def ks_two_sample_p(spark, sf_dir):
    """Exact p-values beside the limiting distribution; the exact values are enumerated in the unit tests."""
    tested = hypothesis.ks_two_sample(subject(spark, sf_dir), ["cohort"], "total", F.col("sex") == "F")
    n = F.col("n_neg") * F.col("n_pos") / (F.col("n_neg") + F.col("n_pos"))
    return tested.select("cohort", "n_neg", "n_pos", _near_limit("ks_d", n, "ks_p").alias("near_limit"))


def _phi(z: str) -> str:
    return f"(CASE WHEN {z} >= 0 THEN 1 - {sql_normal_two_sided(z)} / 2 ELSE {sql_normal_two_sided(f'abs({z})')} / 2 END)"


@query(with_tables("kept_readings", f"""WITH m AS (SELECT TargetID, positive, AVG_Beta AS v, count(*) OVER g AS n,
    (AVG_Beta - avg(AVG_Beta) OVER g) / stddev_pop(AVG_Beta) OVER g AS z, row_number() OVER (PARTITION BY TargetID, positive ORDER BY AVG_Beta) AS i
    FROM kept_readings WINDOW g AS (PARTITION BY TargetID, positive)),
    f AS (SELECT *, {_phi('z')} AS phi FROM m),
    d AS (SELECT TargetID, positive, max(greatest(i / n - phi, phi - (i - 1) / n)) AS d FROM f GROUP BY TargetID, positive)
    SELECT TargetID, round(max(d) FILTER (NOT positive), 6) AS ks_d_neg, round(max(d) FILTER (positive), 6) AS ks_d_pos FROM d GROUP BY TargetID"""))
def ks_one_sample(spark, sf_dir):
    tested = matrix.probe_statistics(kept_readings(spark, sf_dir), F.col("positive"), tests=("ks1",))
    return tested.select("TargetID", F.round("ks_d_neg", 6).alias("ks_d_neg"), F.round("ks_d_pos", 6).alias("ks_d_pos"))


@query(with_tables("kept_readings", """SELECT TargetID, count(*) FILTER (NOT positive) AS n_neg, count(*) FILTER (positive) AS n_pos, TRUE AS near_limit_neg, TRUE AS near_limit_pos
    FROM kept_readings GROUP BY TargetID"""))
def ks_one_sample_p(spark, sf_dir):
    tested = matrix.probe_statistics(kept_readings(spark, sf_dir), F.col("positive"), tests=("ks1",))
    near = [_near_limit(f"ks_d_{g}", F.col(f"n_{g}"), f"ks_p_{g}").alias(f"near_limit_{g}") for g in ("neg", "pos")]
    return tested.select("TargetID", "n_neg", "n_pos", *near)


def _tests(spark, sf_dir):
    """Many p-values with ties and gaps: a function of the order key."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("family"),
        F.round(uniform(SEED, "o_orderkey") * uniform(SEED, "o_custkey"), 4).alias("p1"),
        F.when(F.col("o_orderstatus") != "P", uniform(SEED, "o_orderkey", "o_custkey")).alias("p2"),
    )


_TESTS_SQL = f"""t AS (SELECT o_orderkey AS id, o_orderpriority AS family, round({sql_uniform('o_orderkey')} * {sql_uniform('o_custkey')}, 4) AS p1,
    CASE WHEN o_orderstatus <> 'P' THEN {sql_uniform('o_orderkey', 'o_custkey')} END AS p2 FROM orders)"""


def _bh_sql(p: str, by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""(SELECT id, least(1.0, min(w) OVER ({part}ORDER BY {p} DESC, rk DESC ROWS UNBOUNDED PRECEDING)) AS q FROM (
        SELECT id, {by or "''"} AS fam_, {by + ',' if by else ''} {p}, row_number() OVER ({part}ORDER BY {p}, id) AS rk,
        {p} * count(*) OVER ({part}) / row_number() OVER ({part}ORDER BY {p}, id) AS w FROM t WHERE {p} IS NOT NULL))"""


@query(f"""WITH {_TESTS_SQL}, a AS {_bh_sql('p1', '')}, b AS {_bh_sql('p2', '')}
    SELECT t.id AS id, p1, p2, round(a.q, 6) AS adj_p1, round(b.q, 6) AS adj_p2 FROM t LEFT JOIN a ON a.id = t.id LEFT JOIN b ON b.id = t.id""")
def bh_adjust(spark, sf_dir):
    adjusted = multiple.adjust_pvalues(_tests(spark, sf_dir), ["p1", "p2"])
    return adjusted.select("id", "p1", "p2", F.round("adj_p1", 6).alias("adj_p1"), F.round("adj_p2", 6).alias("adj_p2"))


@query(f"""WITH {_TESTS_SQL}, a AS {_bh_sql('p1', 'family')}
    SELECT t.id AS id, family, p1, round(a.q, 6) AS adj_p1 FROM t LEFT JOIN a ON a.id = t.id""")
def bh_adjust_by_family(spark, sf_dir):
    adjusted = multiple.adjust_pvalues(_tests(spark, sf_dir), ["p1"], by=["family"])
    return adjusted.select("id", "family", "p1", F.round("adj_p1", 6).alias("adj_p1"))


@query(f"""WITH {_TESTS_SQL} SELECT id, round(least(1.0, p1 * n), 6) AS bonferroni
    FROM t JOIN (SELECT family, count(p1) AS n FROM t GROUP BY family) USING (family)""")
def bonferroni_adjust(spark, sf_dir):
    adjusted = multiple.adjust_pvalues(_tests(spark, sf_dir), ["p1"], by=["family"], method="bonferroni", prefix="b_")
    return adjusted.select("id", F.round("b_p1", 6).alias("bonferroni"))


@query(f"""WITH {_TESTS_SQL}, r AS (SELECT id, family, p2, p2 * (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p2) + 1) AS w
    FROM t WHERE p2 IS NOT NULL)
    SELECT t.id AS id, t.family AS family, round(q, 6) AS holm FROM t LEFT JOIN (
    SELECT id, least(1.0, max(w) OVER (PARTITION BY family ORDER BY p2 ROWS UNBOUNDED PRECEDING)) AS q FROM r) h ON h.id = t.id""")
def holm_adjust(spark, sf_dir):
    adjusted = multiple.adjust_pvalues(_tests(spark, sf_dir), ["p2"], by=["family"], method="holm")
    return adjusted.select("id", "family", F.round("adj_p2", 6).alias("holm"))


@query(f"""WITH {_TESTS_SQL}, y AS (SELECT sum(1.0 / i) AS c FROM (SELECT unnest(range(1, n + 1)) AS i FROM (SELECT count(p2) AS n FROM t))),
    r AS (SELECT id, p2, row_number() OVER (ORDER BY p2) AS rk, p2 * count(*) OVER () * (SELECT c FROM y) / row_number() OVER (ORDER BY p2) AS w FROM t WHERE p2 IS NOT NULL)
    SELECT t.id AS id, round(q, 6) AS fdr_by FROM t LEFT JOIN (
    SELECT id, least(1.0, min(w) OVER (ORDER BY p2 DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r) b ON b.id = t.id""")
def by_adjust(spark, sf_dir):
    adjusted = multiple.adjust_pvalues(_tests(spark, sf_dir), ["p2"], method="fdr_by")
    return adjusted.select("id", F.round("adj_p2", 6).alias("fdr_by"))


_VOLCANO_SQL = f"""WITH {_ranked('TargetID', 'AVG_Beta', 'positive', 'kept_readings')},
    p AS (SELECT k AS TargetID, {sql_normal_two_sided('zz')} AS u_p FROM z),
    q AS (SELECT TargetID, u_p, least(1.0, min(w) OVER (ORDER BY u_p DESC, rk DESC ROWS UNBOUNDED PRECEDING)) AS q FROM (
        SELECT *, row_number() OVER (ORDER BY u_p, TargetID) AS rk, u_p * count(*) OVER () / row_number() OVER (ORDER BY u_p, TargetID) AS w FROM p)),
    s AS (SELECT TargetID, avg(AVG_Beta) FILTER (NOT positive) AS m1, avg(AVG_Beta) FILTER (positive) AS m2,
        quantile_cont(AVG_Beta, 0.5) FILTER (NOT positive) AS d1, quantile_cont(AVG_Beta, 0.5) FILTER (positive) AS d2 FROM kept_readings GROUP BY TargetID),
    v AS (SELECT TargetID, m1 AS mean_neg, m2 AS mean_pos, u_p, q AS adj_u_p, -log10(q) AS neg_log10_p, log2(d2 / d1) AS log2_fc,
        -log10(q) > -log10(0.95) AND abs(log2(d2 / d1)) > 0.02 AS significant FROM q JOIN s USING (TargetID))"""


def _volcano(spark, sf_dir):
    """Thresholds that some of the random readings pass."""
    n_samples = table(spark, sf_dir, "embeddings").count()
    return matrix.differential_table(readings(spark, sf_dir), F.col("positive"), log2fc_threshold=0.02, q_threshold=0.95, n_samples=n_samples)


@query(with_tables("kept_readings", _VOLCANO_SQL + """ SELECT TargetID, round(mean_neg, 6) AS mean_neg, round(mean_pos, 6) AS mean_pos, round(u_p, 6) AS u_p,
    round(adj_u_p, 6) AS adj_u_p, round(neg_log10_p, 5) AS neg_log10_p, round(log2_fc, 6) AS log2_fc, significant FROM v"""))
def volcano(spark, sf_dir):
    table_ = _volcano(spark, sf_dir)
    return table_.select(
        "TargetID", *[F.round(c, 6).alias(c) for c in ("mean_neg", "mean_pos", "u_p", "adj_u_p")],
        F.round("neg_log10_p", 5).alias("neg_log10_p"), F.round("log2_fc", 6).alias("log2_fc"), "significant",
    )


@query(with_tables("kept_readings, manifest", _VOLCANO_SQL + """ SELECT v.TargetID AS TargetID, CHR, MAPINFO, round(neg_log10_p, 3) AS neg_log10_p,
    round(log2_fc, 3) AS log2_fc, split_part(UCSC_REFGENE_NAME, ';', 1) AS UCSC_REFGENE_NAME, split_part(UCSC_REFGENE_GROUP, ';', 1) AS UCSC_REFGENE_GROUP,
    coalesce(RELATION_TO_UCSC_CPG_ISLAND, '') AS RELATION_TO_UCSC_CPG_ISLAND
    FROM v JOIN manifest ON substr(Probe_ID, 3)::BIGINT = TargetID WHERE significant"""))
def manifest_join(spark, sf_dir):
    probes = manifest(spark, sf_dir).withColumn("number", F.substring("Probe_ID", 3, 8).cast("bigint")).drop("Probe_ID")
    return matrix.significant_points(_volcano(spark, sf_dir), probes, "number")


@query(with_tables("kept_readings", _VOLCANO_SQL + """ SELECT TargetID, round(neg_log10_p, 5) AS neg_log10_p FROM v WHERE significant
    ORDER BY round(neg_log10_p, 5) DESC, TargetID LIMIT 10"""))
def ranked_points(spark, sf_dir):
    hits = _volcano(spark, sf_dir).where("significant")
    return matrix.ranked_points(hits.select("TargetID", F.round("neg_log10_p", 5).alias("neg_log10_p")), 10)


@query(with_tables("kept_readings, manifest", _VOLCANO_SQL + """ SELECT substr(Probe_ID, 3)::BIGINT AS number, CHR, MAPINFO, UCSC_REFGENE_NAME, UCSC_REFGENE_GROUP,
    RELATION_TO_UCSC_CPG_ISLAND FROM v JOIN manifest ON substr(Probe_ID, 3)::BIGINT = TargetID WHERE significant"""))
def candidate_table(spark, sf_dir):
    probes = manifest(spark, sf_dir).withColumn("number", F.substring("Probe_ID", 3, 8).cast("bigint")).drop("Probe_ID")
    return matrix.candidate_table(_volcano(spark, sf_dir).where("significant"), probes, "number")


@query(with_tables("kept_readings", _VOLCANO_SQL + " SELECT count(*) - count(DISTINCT round(neg_log10_p, 3)) AS ties FROM v WHERE significant"))
def score_ties(spark, sf_dir):
    hits = _volcano(spark, sf_dir).where("significant").withColumn("neg_log10_p", F.round("neg_log10_p", 3))
    return matrix.score_ties(hits)


@query(with_tables("subject", " UNION ALL ".join(
    f"""SELECT * FROM (WITH src AS (SELECT '{v}' AS variable, {v} AS v, label FROM subject WHERE label IS NOT NULL AND {v} IS NOT NULL),
    {_ranked('variable', 'v', 'label', 'src')} SELECT k AS variable, n1 AS n_neg, n2 AS n_pos, u1::DOUBLE AS u_stat, round({sql_normal_two_sided('zz')}, 6) AS u_p FROM z)""" for v in VARIABLES)))
def descriptive_tests(spark, sf_dir):
    rows = subject(spark, sf_dir).where("label IS NOT NULL")
    long = describe.long_values(rows, VARIABLES, ["label"])
    tested = hypothesis.mann_whitney(long, ["variable_no"], "value", F.col("label"))
    return describe.named_variables(tested, VARIABLES).withColumn("u_p", F.round("u_p", 6))


@query(with_tables("complete_subject", " UNION ALL ".join(
    f"""SELECT * FROM (WITH src AS (SELECT '{v}' AS variable, {v}::DOUBLE AS v, label FROM complete_subject WHERE label IS NOT NULL AND {v} IS NOT NULL),
    {_ranked('variable', 'v', 'label', 'src')}, c AS (SELECT avg(v) AS m, stddev_samp(v) AS s, avg(v) FILTER (NOT label) AS m0, stddev_samp(v) FILTER (NOT label) AS s0,
        avg(v) FILTER (label) AS m1, stddev_samp(v) FILTER (label) AS s1, var_samp(v) FILTER (NOT label) / count(*) FILTER (NOT label) AS a, var_samp(v) FILTER (label) / count(*) FILTER (label) AS b FROM src)
    SELECT k AS variable, round(m, 5) AS mean_all, round(s, 5) AS sd_all, round(m0, 5) AS mean_neg, round(s0, 5) AS sd_neg, round(m1, 5) AS mean_pos, round(s1, 5) AS sd_pos,
    printf('%.1f±%.1f', m, s) AS cell_all, round({sql_normal_two_sided('zz')}, 6) AS u_p FROM z, c)""" for v in VARIABLES)))
def descriptive_table(spark, sf_dir):
    table_ = describe.descriptive_statistics(complete_subject(spark, sf_dir), VARIABLES, "label")
    moments = [F.round(f"{m}_{s}", 5).alias(f"{m}_{s}") for s in ("all", "neg", "pos") for m in ("mean", "sd")]
    return table_.select("variable", *moments, "cell_all", F.round("u_p", 6).alias("u_p"))


@query(with_tables("probe_positions, transcripts", """SELECT p.TargetID AS TargetID, "Position", transcript, cdsStart, cdsEnd, cdsStartStat
    FROM probe_positions p LEFT JOIN transcripts t ON p.chrom = t.chrom AND txStart < "Position" AND txEnd >= "Position" """))
def range_join_intervals(spark, sf_dir):
    hits = _overlaps(spark, sf_dir)
    return hits.select("TargetID", "Position", "transcript", "cdsStart", "cdsEnd", "cdsStartStat")


def _overlaps(spark, sf_dir):
    return joins.points_in_intervals(
        probe_positions(spark, sf_dir), transcripts(spark, sf_dir), "TargetID", "chrom", "Position", "txStart", "txEnd"
    )


_REGION_SQL = with_tables("probe_positions, transcripts", """WITH h AS (SELECT p.TargetID AS TargetID, "Position", cdsStart, cdsEnd, cdsStartStat, cdsEndStat
    FROM probe_positions p LEFT JOIN transcripts t ON p.chrom = t.chrom AND txStart < "Position" AND txEnd >= "Position"),
    l AS (SELECT TargetID, CASE WHEN bool_or(coalesce(cdsStartStat = 'cmpl' AND cdsEndStat = 'cmpl' AND "Position" BETWEEN cdsStart AND cdsEnd, false)) THEN 'coding'
    WHEN bool_or(coalesce(cdsStartStat <> 'cmpl' AND cdsEndStat <> 'cmpl', false)) THEN 'non_coding'
    WHEN bool_or(cdsStartStat IS NULL AND cdsEndStat IS NULL) THEN 'no_annotate' END AS coding FROM h GROUP BY TargetID)""")


@query(_REGION_SQL + " SELECT * FROM l")
def region_class(spark, sf_dir):
    return annotate.classify_region(_overlaps(spark, sf_dir))


@query(_REGION_SQL + " SELECT coalesce(coding, 'unlabelled') AS coding, count(*) AS n FROM l GROUP BY ALL")
def region_tally(spark, sf_dir):
    return annotate.region_tally(annotate.classify_region(_overlaps(spark, sf_dir)))


@query(with_tables("manifest", """SELECT DISTINCT CASE WHEN g = 'red' THEN 'crimson' ELSE g END AS gene FROM (
    SELECT unnest(string_split(UCSC_REFGENE_NAME, ';')) AS g FROM manifest) WHERE g <> ''"""))
def gene_list(spark, sf_dir):
    colours = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit("red").alias("alias"), F.lit("crimson").alias("official"))
    return annotate.gene_list(manifest(spark, sf_dir), "UCSC_REFGENE_NAME", aliases=colours)


_ENRICH_SQL = """WITH b AS (SELECT library, count(DISTINCT gene) AS n_background, count(DISTINCT gene) FILTER (gene IN (SELECT gene FROM query_genes)) AS n_query
    FROM gene_sets GROUP BY library),
    o AS (SELECT library, term, count(*) AS n_term, count(*) FILTER (gene IN (SELECT gene FROM query_genes)) AS n_overlap FROM gene_sets GROUP BY library, term),
    h AS (SELECT o.*, n_background, n_query, (SELECT sum(exp(lgamma(n_term + 1) - lgamma(i + 1) - lgamma(n_term - i + 1)
        + lgamma(n_background - n_term + 1) - lgamma(n_query - i + 1) - lgamma(n_background - n_term - n_query + i + 1)
        - lgamma(n_background + 1) + lgamma(n_query + 1) + lgamma(n_background - n_query + 1)))
        FROM range(n_overlap, least(n_term, n_query) + 1) r(i) WHERE n_background - n_term - n_query + i >= 0) AS p0 FROM o JOIN b USING (library) WHERE n_overlap > 0),
    p AS (SELECT *, least(1.0, p0) AS p, ((n_overlap + 0.5) * (n_background - n_term - n_query + n_overlap + 0.5)) / ((n_term - n_overlap + 0.5) * (n_query - n_overlap + 0.5)) AS odds FROM h),
    q AS (SELECT *, -ln(p) * odds AS combined, least(1.0, min(w) OVER (PARTITION BY library ORDER BY p DESC, rk DESC ROWS UNBOUNDED PRECEDING)) AS adj_p FROM (
        SELECT *, row_number() OVER (PARTITION BY library ORDER BY p, term) AS rk,
        p * count(*) OVER (PARTITION BY library) / row_number() OVER (PARTITION BY library ORDER BY p, term) AS w FROM p))"""


@query(with_tables("gene_sets, query_genes", _ENRICH_SQL + """ SELECT library, term, n_overlap, n_term, n_query, n_background, round(p, 6) AS p, round(adj_p, 6) AS adj_p,
    round(odds, 6) AS odds, round(combined, 5) AS combined FROM q"""))
def enrichment(spark, sf_dir):
    tested = enrich.over_representation(query_genes(spark, sf_dir), gene_sets(spark, sf_dir), alpha=None)
    return tested.select(
        "library", "term", "n_overlap", "n_term", "n_query", "n_background", *[F.round(c, 6).alias(c) for c in ("p", "adj_p", "odds")],
        F.round("combined", 5).alias("combined"),
    )


@query(with_tables("gene_sets, query_genes", _ENRICH_SQL + """, k AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY round(combined, 5) DESC, term) AS rank FROM q)
    SELECT library, term, rank, round(combined, 5) AS combined,
    (SELECT string_agg(gene, ';' ORDER BY gene) FROM gene_sets s WHERE s.library = k.library AND s.term = k.term AND gene IN (SELECT gene FROM query_genes)) AS genes
    FROM k WHERE rank <= 3"""))
def top_terms_per_library(spark, sf_dir):
    genes, sets = query_genes(spark, sf_dir), gene_sets(spark, sf_dir)
    tested = enrich.over_representation(genes, sets, alpha=None).withColumn("combined", F.round("combined", 5))
    top = enrich.top_terms(tested, 3, wrap=False).select("library", "term", F.col("rank").cast("bigint").alias("rank"), "combined")
    return enrich.overlap_genes(genes, sets, top)


@query(with_tables("subject", """WITH s AS (SELECT * FROM subject WHERE label IS NOT NULL AND sex IS NOT NULL),
    c AS (SELECT coalesce(sex, 'total') AS level, count(*) AS a, count(*) FILTER (NOT label) AS b, count(*) FILTER (label) AS c FROM s GROUP BY GROUPING SETS ((sex), ())),
    t AS (SELECT a AS ta, b AS tb, c AS tc FROM c WHERE level = 'total'),
    x AS (SELECT CASE level WHEN 'total' THEN 0 ELSE 1 END AS block, level AS variable,
        CASE level WHEN 'total' THEN format('{:,}', a) ELSE format('{:,}', a) || printf('(%.1f%%)', 100.0 * a / ta) END AS cell_all,
        CASE level WHEN 'total' THEN format('{:,}', b) ELSE format('{:,}', b) || printf('(%.1f%%)', 100.0 * b / tb) END AS cell_neg,
        CASE level WHEN 'total' THEN format('{:,}', c) ELSE format('{:,}', c) || printf('(%.1f%%)', 100.0 * c / tc) END AS cell_pos FROM c, t UNION ALL """
    + " UNION ALL ".join(f"""SELECT 2, '{v}', printf('%.1f±%.1f', avg({v}), stddev_samp({v})), printf('%.1f±%.1f', avg({v}) FILTER (NOT label), stddev_samp({v}) FILTER (NOT label)),
        printf('%.1f±%.1f', avg({v}) FILTER (label), stddev_samp({v}) FILTER (label)) FROM subject""" for v in ("qty", "total", "price"))
    + ") SELECT variable, cell_all, cell_neg, cell_pos, row_number() OVER (ORDER BY block, variable)::INT AS row FROM x"))
def descriptive_sheet(spark, sf_dir):
    return describe.descriptive_sheet(subject(spark, sf_dir), ["qty", "total", "price"], "sex", "label")


@query(with_tables("kept_readings, manifest, probe_positions, transcripts", _VOLCANO_SQL + """, h AS (SELECT p.TargetID AS TargetID, "Position", cdsStart, cdsEnd, cdsStartStat, cdsEndStat
    FROM probe_positions p LEFT JOIN transcripts t ON p.chrom = t.chrom AND txStart < "Position" AND txEnd >= "Position"),
    l AS (SELECT TargetID, CASE WHEN bool_or(coalesce(cdsStartStat = 'cmpl' AND cdsEndStat = 'cmpl' AND "Position" BETWEEN cdsStart AND cdsEnd, false)) THEN 'coding'
    WHEN bool_or(coalesce(cdsStartStat <> 'cmpl' AND cdsEndStat <> 'cmpl', false)) THEN 'non_coding'
    WHEN bool_or(cdsStartStat IS NULL AND cdsEndStat IS NULL) THEN 'no_annotate' END AS coding FROM h GROUP BY TargetID)
    SELECT v.TargetID AS TargetID, CHR, round(log2_fc, 3) AS log2_fc, coding
    FROM v JOIN manifest ON substr(Probe_ID, 3)::BIGINT = v.TargetID LEFT JOIN l ON l.TargetID = v.TargetID WHERE significant"""))
def candidate_regions(spark, sf_dir):
    """Significant probes with their annotation and the class of the region they lie in."""
    probes = manifest(spark, sf_dir).withColumn("number", F.substring("Probe_ID", 3, 8).cast("bigint")).drop("Probe_ID")
    regions = annotate.classify_region(_overlaps(spark, sf_dir))
    return matrix.significant_points(_volcano(spark, sf_dir), probes, "number", regions).select("TargetID", "CHR", "log2_fc", "coding")


@query(with_tables("gene_sets, query_genes", _ENRICH_SQL + """ SELECT library, term, round(combined, 5) AS combined,
    (SELECT string_agg(gene, ';' ORDER BY gene) FROM gene_sets s WHERE s.library = q.library AND s.term = q.term AND gene IN (SELECT gene FROM query_genes)) AS genes
    FROM q"""))
def enrichment_report(spark, sf_dir):
    """Every tested term with its shared genes; the order is tested where rounding cannot disturb it."""
    report = enrich.reported_terms(query_genes(spark, sf_dir), gene_sets(spark, sf_dir), alpha=None)
    return report.select("library", "term", F.round("combined", 5).alias("combined"), "genes")


@query(with_tables("predictions", """SELECT p > 0.5 AS predicted, count(*) AS n, count(vec_id) AS n_on_array
    FROM predictions LEFT JOIN embeddings ON vec_id = id GROUP BY ALL"""))
def array_subset_counts(spark, sf_dir):
    """Predicted labels of everyone, and of those who have an array identifier."""
    from cohortspark.plans.stand_ins import predictions

    lab = table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("MET_ID"))
    linked = joins.lookup_join(predictions(spark, sf_dir), lab, [("id", "vec_id")], "left").na.fill("", ["MET_ID"])
    return linked.groupBy((F.col("p") > 0.5).alias("predicted")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("MET_ID") != "").alias("n_on_array"))
