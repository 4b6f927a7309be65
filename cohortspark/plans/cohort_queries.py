"""Cleaning, joins, features, descriptive tables, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from cohortspark.functions import text
from cohortspark.operators import clean, describe, features, joins, quantiles, wide
from cohortspark.operators.hypothesis import cohens_d as effect_size
from cohortspark.plans.registry import query
from cohortspark.plans.stand_ins import manifest, readings, subject, table, with_tables
from cohortspark.session import scratch_path
from cohortspark.sources import archives, readers, writers


def components(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three component tables per participant; customers without orders and users without events leave gaps.

    Two of them carry the same measurement under different codes.
    """
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("SEQN"), F.col("c_nationkey").alias("RIAGENDR"), F.col("c_acctbal").alias("LBXTC")
    )
    bought = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("SEQN")).agg(
        F.count(F.lit(1)).alias("LBXGH"), F.round(F.max("o_totalprice"), 2).alias("LBXHDD")
    )
    seen = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("SEQN")).agg(
        F.count(F.lit(1)).alias("LBXIN"), F.round(F.max("value"), 2).alias("LBDHDL")
    )
    return [customers, bought, seen]


COMPONENTS_SQL = """
WITH a AS (SELECT c_custkey AS SEQN, c_nationkey AS RIAGENDR, c_acctbal AS LBXTC FROM customer),
b AS (SELECT o_custkey AS SEQN, count(*) AS LBXGH, round(max(o_totalprice), 2) AS h1 FROM orders GROUP BY o_custkey),
c AS (SELECT user_id AS SEQN, count(*) AS LBXIN, round(max(value), 2) AS h2 FROM events GROUP BY user_id)
SELECT SEQN, RIAGENDR, LBXTC, LBXGH, coalesce(h1, h2) AS LBDHDD, LBXIN
FROM a FULL JOIN b USING (SEQN) FULL JOIN c USING (SEQN)
"""


@query(COMPONENTS_SQL)
def cohort_full_outer(spark, sf_dir):
    return readers.merge_components(components(spark, sf_dir), "SEQN")


@query(
    f"""SELECT lpad(SEQN::VARCHAR, 6, '0') AS Release_No, LBXTC AS T_CHO, LBDHDD AS HDL_C, LBXIN AS FASTING_INSULIN
    FROM ({COMPONENTS_SQL}) WHERE LBXTC IS NOT NULL AND LBDHDD IS NOT NULL AND LBXIN IS NOT NULL"""
)
def schema_mapping(spark, sf_dir):
    codes = {c: readers.CYCLE_CODES[c] for c in ("SEQN", "LBXTC", "LBDHDD", "LBXIN")}
    merged = readers.merge_components(components(spark, sf_dir), "SEQN")
    return clean.chain(
        clean.to_shared_schema(merged, codes), lambda df: clean.padded_id(df, "Release_No"), clean.complete_rows
    )


@query(
    """WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), s AS (SELECT y, row_number() OVER (ORDER BY y % 3, y) - 1 AS file_seq FROM y)
       SELECT o_orderkey AS id, o_totalprice AS total, file_seq::INT AS file_seq FROM orders JOIN s ON year(o_orderdate) = y"""
)
def cohort_yearly_union(spark, sf_dir):
    """A file per year, all years, listed out of order."""
    orders = table(spark, sf_dir, "orders")
    years = sorted((r[0] for r in orders.select(F.year("o_orderdate")).distinct().collect()), key=lambda y: (y % 3, y))
    listed = [
        orders.where(F.year("o_orderdate") == year).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"))
        for year in years
    ]
    return clean.union_in_order(listed)


@query(
    """SELECT c_custkey AS Release_No, c_nationkey AS SEX, n_orders, max_total, coalesce(vec_id::VARCHAR, '') AS MET_ID
    FROM customer JOIN (SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS max_total FROM orders GROUP BY o_custkey)
    ON c_custkey = o_custkey LEFT JOIN embeddings ON c_custkey = vec_id WHERE c_mktsegment <> 'MACHINERY'"""
)
def cohort_three_way(spark, sf_dir):
    survey = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") != "MACHINERY")
    survey = survey.select(F.col("c_custkey").alias("Release_No"), F.col("c_nationkey").alias("SEX"))
    measure = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("Release_No")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("max_total")
    )
    lab = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("Release_No"), F.col("vec_id").cast("string").alias("MET_ID"))
    return survey.join(measure, "Release_No").join(lab, "Release_No", "left").na.fill("", ["MET_ID"])


@query("SELECT c_custkey, coalesce(vec_id::VARCHAR, '') AS MET_ID FROM customer LEFT JOIN embeddings ON c_custkey = vec_id")
def lab_link_left(spark, sf_dir):
    lab = table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("MET_ID"))
    linked = joins.lookup_join(table(spark, sf_dir, "customer").select("c_custkey"), lab, [("c_custkey", "vec_id")], "left")
    return linked.na.fill("", ["MET_ID"])


@query(with_tables("subject", """SELECT id, (2 * ((qty + tax) / 2) + (disc + price) / 2) / 3 AS "MAP", idx AS "HOMA-IR", label AS IR FROM subject"""))
def derived_index_label(spark, sf_dir):
    rows = subject(spark, sf_dir).select(
        "id", "qty", "total", F.col("qty").alias("D1_PRESSURE"), F.col("tax").alias("D2_PRESSURE"),
        F.col("disc").alias("S1_PRESSURE"), F.col("price").alias("S2_PRESSURE"),
    )
    rows = clean.mean_pressure(rows, ["D1_PRESSURE", "D2_PRESSURE"], ["S1_PRESSURE", "S2_PRESSURE"])
    rows = clean.add_index_label(rows, "qty", "total", cutoff=70000)
    return rows.select("id", "MAP", "`HOMA-IR`", "IR")


@query(with_tables("subject", "SELECT id, round(total - price - qty / 5, 4) AS LDL_C FROM subject WHERE total - price - qty / 5 > 0"))
def friedewald_filter(spark, sf_dir):
    rows = subject(spark, sf_dir).select("id", "total", "price", "qty", F.lit(None).cast("double").alias("LDL_C"))
    kept = clean.recompute_ldl(rows, "total", "price", "qty")
    return kept.select("id", F.round("LDL_C", 4).alias("LDL_C"))


@query(
    """SELECT event_id, (hour(ts) * 60 + minute(ts))::BIGINT AS minutes FROM events WHERE hour(ts) * 60 + minute(ts) >= 480"""
)
def duration_minutes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.hour("ts"), F.lit(" hr "), F.minute("ts"), F.lit(" min")).alias("FAST_TIME")
    )
    rows = rows.withColumn("minutes", text.duration_minutes(F.col("FAST_TIME")))
    return clean.long_enough(rows, "FAST_TIME")


@query("SELECT o_orderkey AS k, CASE WHEN len((o_orderkey * 97)::VARCHAR) >= 6 THEN (o_orderkey * 97)::VARCHAR ELSE lpad((o_orderkey * 97)::VARCHAR, 6, '0') END AS Release_No FROM orders")
def zero_padded_id(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 97.0).alias("Release_No"))
    return clean.padded_id(rows, "Release_No")


@query(with_tables("subject", "SELECT id, qty, total FROM subject WHERE id IS NOT NULL AND qty IS NOT NULL AND price IS NOT NULL AND disc IS NOT NULL AND tax IS NOT NULL AND total IS NOT NULL"))
def complete_rows(spark, sf_dir):
    return clean.complete_rows(subject(spark, sf_dir)).select("id", "qty", "total")


@query(with_tables("subject", """SELECT id, qty, (custkey % 5)::DOUBLE AS diagnosis, total FROM subject
    WHERE qty > 18 AND custkey % 5 BETWEEN 2 AND 3 AND total < 400000 AND price < 300000"""))
def eligibility_filters(spark, sf_dir):
    rows = subject(spark, sf_dir).withColumn("diagnosis", F.col("custkey") % 5)
    kept = clean.eligible(rows, 18, "qty", "diagnosis", (2, 3))
    kept = clean.plausible(kept, {"total": 400000, "price": 300000})
    return clean.integers_as_double(kept.select("id", "qty", "diagnosis", "total"), ["diagnosis"])


@query(with_tables("subject", """SELECT * FROM (
    SELECT 0 AS step, 'read' AS stage, count(*) AS n FROM subject UNION ALL
    SELECT 1, 'complete', count(*) FROM subject WHERE qty IS NOT NULL UNION ALL
    SELECT 2, 'adult', count(*) FROM subject WHERE qty > 18 UNION ALL
    SELECT 3, 'eligible', count(*) FROM subject WHERE qty > 18 AND sex <> 'P')"""))
def cascade_counts(spark, sf_dir):
    steps = {"complete": F.col("qty").isNotNull(), "adult": F.col("qty") > 18, "eligible": F.col("sex") != "P"}
    return clean.cascade(subject(spark, sf_dir), steps)


@query(
    """SELECT 1 AS RACE, s_suppkey AS key, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier
    UNION ALL SELECT 2, c_custkey, c_acctbal, c_mktsegment FROM customer"""
)
def union_relaxed(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    return clean.union_cohorts({1: suppliers, 2: customers}, relaxed=True)


@query(with_tables("subject", """SELECT id, qty, total, y FROM (SELECT id, qty, total FROM subject) JOIN (SELECT id, label::INT AS y FROM subject) USING (id)"""))
def aligned_labels(spark, sf_dir):
    rows = subject(spark, sf_dir)
    return joins.attach_checked(rows.select("id", "qty", "total"), rows.select("id", F.col("label").cast("int").alias("y")), "id")


@query(with_tables("subject", "SELECT sex AS code, total, disc FROM subject"))
def matching_columns(spark, sf_dir):
    rows = subject(spark, sf_dir).withColumnRenamed("sex", "code")
    return clean.select_matching(clean.select_matching(rows, exclude="^.*(id|key|x)$|qty|price|cohort"), exclude=["label", "tax"])


INTERACTIONS_SQL = with_tables("subject", """SELECT id, sex, 2 AS RACE,
    qty, qty * qty AS qty_square, sqrt(qty) AS qty_sqrt, round(log10(qty), 6) AS qty_log,
    total, total * total AS total_square, sqrt(total) AS total_sqrt, round(log10(total), 6) AS total_log,
    tax, tax * tax AS tax_square, sqrt(tax) AS tax_sqrt, round(log10(tax), 6) AS tax_log,
    qty * tax AS qty_mul_tax, qty / tax AS qty_div_tax, qty * total AS qty_mul_total, qty / total AS qty_div_total,
    tax * total AS tax_mul_total, tax / total AS tax_div_total
    FROM subject WHERE qty > 0 AND total > 0 AND tax > 0""")


@query(INTERACTIONS_SQL)
def interactions(spark, sf_dir):
    rows = subject(spark, sf_dir).select("id", "sex", "qty", "total", "tax")
    made = features.generate_interactions(rows, code=2, exclude=["id", "sex", "RACE"])
    # Products, ratios and roots agree to the last bit; logarithms need not.
    return made.select(*[F.round(c, 6).alias(c) if c.endswith("_log") else c for c in made.columns])


@query(with_tables("subject", """SELECT label, count(*) AS n_rows, count(*) FILTER (qty > 0 AND total > 0 AND disc > 0 AND tax > 0) AS n_finite
    FROM subject GROUP BY label"""))
def finite_filter(spark, sf_dir):
    rows = subject(spark, sf_dir).select("id", "label", "qty", "total", "disc", "tax")
    made = features.generate_interactions(rows, exclude=["id", "label", "RACE"])
    kept = made.groupBy("label").agg(F.count(F.lit(1)).alias("n_finite"))
    read = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    joined = read.alias("r").join(F.broadcast(kept.alias("k")), F.col("r.label").eqNullSafe(F.col("k.label")), "left")
    return joined.select("r.label", "n_rows", F.coalesce("n_finite", F.lit(0)).alias("n_finite"))


def _set_sql() -> str:
    """RACE and the label aside, bases price (extra), qty and total (baseline)."""

    def unary(x):
        return f"sqrt({x}) + log10({x})"

    base = "a + t + 1"
    base_all = f"{base} + {unary('a')} + {unary('t')} + a / t"
    full = f"{base_all} + p + {unary('p')} + p / a + p / t"
    parts = [
        ("baseline", 3, base), ("baseline + interactions", 11, base_all), ("extended", 4, f"{base} + p"),
        ("extended + interactions", 19, full),
    ]
    # Squares and products are left out of the sums: they would drown the rest.
    queries = [f"SELECT '{n}' AS feature_set, {k} AS n_features, count(*) AS n_rows, round(avg({e}), 4) AS mean_sum FROM f" for n, k, e in parts]
    return with_tables("subject", """WITH f AS (SELECT qty AS a, total AS t, price AS p FROM subject
        WHERE qty > 0 AND total > 0 AND price > 0 AND idx > 0) """ + " UNION ALL ".join(queries))


@query(_set_sql())
def feature_set_sizes(spark, sf_dir):
    rows = subject(spark, sf_dir).select(
        F.col("id").alias("Release_No"), F.col("label").alias("IR"), "qty", "total", "price", F.col("idx").alias("HOMA-IR"),
    )
    made = features.drop_target_derived(features.generate_interactions(rows))
    sets = features.ablation_feature_sets(made.columns, "IR", base=["RACE", "qty", "total"])
    sums = []
    for name, columns in sets.items():
        light = [F.col(c) for c in columns if "_mul_" not in c and not c.endswith("_square")]
        sums.append((name, len(columns), sum(light[1:], light[0])))
    counted = made.agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(s).alias(f"s{i}") for i, (_, _, s) in enumerate(sums)])
    cells = [F.struct(F.lit(n).alias("feature_set"), F.lit(k).alias("n_features"), F.col("n_rows"), F.round(f"s{i}", 4).alias("mean_sum")) for i, (n, k, _) in enumerate(sums)]
    return counted.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


VARIABLES = ["qty", "price", "disc", "tax", "total"]


@query(with_tables("subject", " UNION ALL ".join(
    f"""SELECT '{v}' AS variable, round(avg({v}), 5) AS mean_all, round(stddev_samp({v}), 5) AS sd_all,
    round(avg({v}) FILTER (NOT label), 5) AS mean_neg, round(stddev_samp({v}) FILTER (NOT label), 5) AS sd_neg,
    round(avg({v}) FILTER (label), 5) AS mean_pos, round(stddev_samp({v}) FILTER (label), 5) AS sd_pos FROM subject""" for v in VARIABLES)))
def descriptive_by_label(spark, sf_dir):
    table_ = describe.variable_moments(subject(spark, sf_dir), VARIABLES, "label")
    return table_.select("variable", *[F.round(c, 5).alias(c) for c in table_.columns if c != "variable"])


@query(with_tables("subject", """WITH c AS (SELECT coalesce(sex, 'total') AS level, count(*) AS n_all,
    count(*) FILTER (NOT label) AS n_neg, count(*) FILTER (label) AS n_pos
    FROM subject WHERE label IS NOT NULL GROUP BY GROUPING SETS ((sex), ()))
    SELECT level, n_all, n_neg, n_pos, round(n_all / (SELECT n_all FROM c WHERE level = 'total'), 6) AS share_all,
    round(n_neg / (SELECT n_neg FROM c WHERE level = 'total'), 6) AS share_neg,
    round(n_pos / (SELECT n_pos FROM c WHERE level = 'total'), 6) AS share_pos FROM c"""))
def sex_label_grouping_sets(spark, sf_dir):
    block = describe.count_block(subject(spark, sf_dir), "sex", "label")
    return block.select("level", "n_all", "n_neg", "n_pos", *[F.round(f"share_{s}", 6).alias(f"share_{s}") for s in ("all", "neg", "pos")])


_PAIRS = [(b, a) for i, a in enumerate(sorted(VARIABLES)) for b in sorted(VARIABLES)[i + 1 :]]


@query(with_tables("subject", " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS r FROM subject" for x, y in _PAIRS)))
def correlation_long(spark, sf_dir):
    return describe.correlation_long(subject(spark, sf_dir), VARIABLES).select("x", "y", F.round("r", 6).alias("r"))


@query(with_tables("subject", """WITH l AS (SELECT cohort, CASE WHEN label THEN 'IR+' ELSE 'IR-' END AS side, v.variable AS variable, v.value AS value
    FROM subject, LATERAL (VALUES ('price', ln(price)), ('total', total), ('tax', tax)) v(variable, value) WHERE label IS NOT NULL AND v.value IS NOT NULL),
    q AS (SELECT cohort, side, variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3,
          count(*) AS n FROM l GROUP BY ALL)
    SELECT cohort, side, variable, q.n AS n, round(q1, 5) AS q1, round(median, 5) AS median, round(q3, 5) AS q3,
    round(min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 5) AS whisker_low,
    round(max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 5) AS whisker_high,
    count(*) FILTER (NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers,
    round(1.57 * (q3 - q1) / sqrt(q.n), 5) AS notch
    FROM l JOIN q USING (cohort, side, variable) GROUP BY cohort, side, variable, q.n, q1, median, q3"""))
def boxplot_summary(spark, sf_dir):
    rows = subject(spark, sf_dir).where("label IS NOT NULL").withColumns(
        {"side": text.signed_label(F.col("label")), "price": F.log("price")}
    )
    variables = ["price", "total", "tax"]
    long = describe.long_values(rows, variables, ["cohort", "side"])
    boxes = describe.named_variables(quantiles.boxplot_summary(long, ["cohort", "side", "variable_no"], "value"), variables)
    whole = {"cohort", "side", "variable", "n", "n_outliers"}
    return boxes.select(*[c if c in whole else F.round(c, 5).alias(c) for c in boxes.columns])


@query(with_tables("subject", """WITH x AS (SELECT cohort, ln(idx) AS v FROM subject WHERE idx > 0)
    SELECT cohort, bin, count(*) AS n, (4 + (bin - 1) * 0.25)::DOUBLE AS bin_low, 4 + (bin - 1) * 0.25 >= ln(70000) AS above_cutoff FROM (
    SELECT cohort, CASE WHEN v < 4 THEN 0 WHEN v > 14 THEN 41 ELSE least(floor((v - 4) / 0.25)::INT + 1, 40) END AS bin FROM x) GROUP BY ALL"""))
def index_histogram(spark, sf_dir):
    return quantiles.log_histogram(subject(spark, sf_dir), ["cohort"], "idx", 4.0, 14.0, 40, cutoff=70000)


@query(with_tables("subject", """WITH v AS (SELECT cohort, ln(idx) AS v FROM subject WHERE idx > 0),
    s AS (SELECT cohort, count(*) AS n, stddev_samp(v) / pow(count(*), 0.2) AS b, min(v) AS lo, max(v) AS hi FROM v GROUP BY cohort),
    g AS (SELECT *, lo - 3 * b AS low, (hi - lo + 6 * b) / 39 AS step FROM s),
    p AS (SELECT cohort, (v - low) / step AS pl FROM v JOIN g USING (cohort)),
    m AS (SELECT cohort, i, sum(m) AS m FROM (SELECT cohort, floor(pl) AS i, 1 - pl + floor(pl) AS m FROM p UNION ALL SELECT cohort, floor(pl) + 1, pl - floor(pl) FROM p) GROUP BY ALL)
    SELECT cohort, point::INT AS point, round(any_value(low + point * step), 6) AS x, any_value(n) AS n,
           round(sum(m * exp(-0.5 * pow((point - i) * step / b, 2))) / any_value(n * b * sqrt(2 * pi())), 8) AS density
    FROM g JOIN m USING (cohort), range(40) r(point) GROUP BY cohort, point"""))
def index_density(spark, sf_dir):
    """The smooth curve over the histogram of the index."""
    rows = subject(spark, sf_dir).where("idx > 0").select("cohort", F.log("idx").alias("v"))
    curve = quantiles.density(rows, ["cohort"], "v", points=40)
    return curve.select("cohort", "point", F.round("x", 6).alias("x"), "n", F.round("density", 8).alias("density"))


@query(with_tables("subject", """SELECT count(*) FILTER (NOT label) AS n_neg, count(*) FILTER (label) AS n_pos,
    round(count(*) FILTER (label) / count(label), 6) AS prevalence,
    round(count(*) FILTER (NOT label) / count(*) FILTER (label), 6) AS positive_weight,
    round(count(label) / (2 * count(*) FILTER (NOT label)), 6) AS balanced_neg,
    round(count(label) / (2 * count(*) FILTER (label)), 6) AS balanced_pos FROM subject"""))
def class_weights(spark, sf_dir):
    weights = describe.class_weights(subject(spark, sf_dir), "label")
    return weights.select("n_neg", "n_pos", *[F.round(c, 6).alias(c) for c in ("prevalence", "positive_weight", "balanced_neg", "balanced_pos")])


@query(with_tables("subject", """WITH m AS (SELECT cohort, sex = 'F' AS f, price / total AS r FROM subject WHERE price IS NOT NULL),
    s AS (SELECT cohort, count(*) FILTER (f) AS n_x, count(*) FILTER (NOT f) AS n_y, avg(r) FILTER (f) AS mx, avg(r) FILTER (NOT f) AS my,
          var_samp(r) FILTER (f) AS vx, var_samp(r) FILTER (NOT f) AS vy FROM m GROUP BY cohort)
    SELECT cohort, n_x, n_y, round(mx, 6) AS mean_x, round(my, 6) AS mean_y,
    round((mx - my) / sqrt(((n_x - 1) * vx + (n_y - 1) * vy) / (n_x + n_y - 2)), 6) AS cohens_d FROM s"""))
def cohens_d(spark, sf_dir):
    rows = features.log_ratio(subject(spark, sf_dir), "price", "total", "ratio", log=False).where("ratio IS NOT NULL")
    sized = effect_size(rows, ["cohort"], "ratio", F.col("sex") == "F")
    return sized.select("cohort", "n_x", "n_y", *[F.round(c, 6).alias(c) for c in ("mean_x", "mean_y", "cohens_d")])


@query("""SELECT p_partkey, replace(replace(p_type, '_mul_', '×'), '_div_', '/') AS plain, 'log(' || p_brand || ')' AS logged,
    'sqrt(' || p_brand || ')' AS rooted, p_brand || '×' || p_type AS product, p_brand || '/' || p_type AS quotient FROM part""")
def pretty_features(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    brand = F.col("p_brand")
    return rows.select(
        "p_partkey", text.pretty_feature(F.col("p_type")).alias("plain"), text.pretty_feature(F.concat(brand, F.lit("_log"))).alias("logged"),
        text.pretty_feature(F.concat(brand, F.lit("_sqrt"))).alias("rooted"),
        text.pretty_feature(F.concat(brand, F.lit("_mul_"), "p_type")).alias("product"),
        text.pretty_feature(F.concat(brand, F.lit("_div_"), "p_type")).alias("quotient"),
    )


@query("""SELECT p_partkey, p_name || chr(10) || 'during ' || p_brand || chr(10) || 'Homo ' || p_type AS both_markers, p_name AS neither,
    'during ' || p_name AS at_start FROM part""")
def wrapped_terms(spark, sf_dir):
    name = F.col("p_name")
    both = F.concat(name, F.lit(" during "), "p_brand", F.lit(" Homo "), "p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.wrap_term(both).alias("both_markers"), text.wrap_term(name).alias("neither"),
        text.wrap_term(F.concat(F.lit("during "), name)).alias("at_start"),
    )


@query("SELECT event_id, CASE WHEN round(value / 1000, 3) < 0.01 THEN '< 0.01' ELSE 'shown' END AS reported FROM events")
def reported_p(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", text.reported_p(F.round(F.col("value") / 1000, 3)).alias("r"))
    return rows.select("event_id", F.when(F.col("r").startswith("<"), F.col("r")).otherwise("shown").alias("reported"))


# Sources and sinks: each writes a table to the shared folder and reads it back.


@query("""SELECT c_custkey::VARCHAR AS Release_No, c_nationkey::BIGINT AS SEX, c_acctbal AS BMI FROM customer WHERE c_mktsegment = 'BUILDING'""")
def baseline_csv_scan(spark, sf_dir):
    path = scratch_path(spark, "baseline")
    customer = table(spark, sf_dir, "customer")
    follow = F.when(F.col("c_mktsegment") == "BUILDING", "Baseline").otherwise("Later")
    # As real files are: other columns too, in another order than the schema's.
    writers.write_csv(customer.select(F.col("c_name").alias("NOTE"), F.col("c_acctbal").alias("BMI"), follow.alias("FOLLOW"), F.col("c_nationkey").alias("SEX"), F.col("c_custkey").alias("Release_No")), path)
    schema = StructType([StructField("Release_No", StringType()), StructField("FOLLOW", StringType()), StructField("SEX", LongType()), StructField("BMI", DoubleType())])
    return readers.read_baseline(spark, path, schema, ["Release_No", "SEX", "BMI"])


@query(with_tables("manifest", "SELECT Probe_ID AS TargetID FROM manifest WHERE CHR NOT IN ('X', 'Y') AND starts_with(Probe_ID, 'cg')"))
def manifest_tsv_scan(spark, sf_dir):
    from cohortspark.operators.matrix import eligible_probes

    path = scratch_path(spark, "manifest")
    manifest(spark, sf_dir).write.option("header", True).option("sep", "\t").csv(path)
    return eligible_probes(readers.read_manifest(spark, path))


@query(with_tables("readings", """SELECT TargetID::VARCHAR AS TargetID, round(AVG_Beta, 6) AS AVG_Beta, MET_ID::VARCHAR AS MET_ID, 'gene;' || (TargetID % 7) AS UCSC_REFGENE_NAME
    FROM readings WHERE det_p < 0.5 AND TargetID % 24 NOT IN (0, 23)"""))
def sample_files(spark, sf_dir):
    path = scratch_path(spark, "samples")
    long = readings(spark, sf_dir)
    # One text folder per sample, named like the vendor's files.
    export = long.select(
        F.lit("x").alias("Index"), F.col("det_p").cast("string").alias("Detection Pval"), F.col("AVG_Beta").cast("string").alias("AVG_Beta"),
        F.lit(1).alias("NBEADS"), F.col("TargetID").cast("string").alias("TargetID"), F.concat(F.col("MET_ID").cast("string"), F.lit("_nor.txt")).alias("file"),
    )
    writers.write_folders(export, path, "file", lambda rows, to: rows.write.partitionBy("file").option("header", True).option("sep", "\t").csv(to))
    usable = readers.read_sample_readings(spark, path, limit=0.5)
    probes = long.select("TargetID").distinct().select(
        F.col("TargetID").cast("string").alias("Probe_ID"),
        F.expr("CASE TargetID % 24 WHEN 0 THEN 'X' WHEN 23 THEN 'Y' ELSE string(TargetID % 24) END").alias("CHR"),
        F.concat(F.lit("gene;"), F.col("TargetID") % 7).alias("UCSC_REFGENE_NAME"),
    )
    joined = readers.annotated_readings(usable, probes)
    return joined.select("TargetID", F.round("AVG_Beta", 6).alias("AVG_Beta"), "MET_ID", "UCSC_REFGENE_NAME")


@query(with_tables("readings", "SELECT TargetID, MET_ID, round(AVG_Beta, 6) AS AVG_Beta FROM readings"))
def sample_tables(spark, sf_dir):
    path = writers.write_samples(readings(spark, sf_dir).select("TargetID", "AVG_Beta", "MET_ID"), scratch_path(spark, "met"))
    read = readers.read_samples(spark, path)
    return read.select("TargetID", F.col("MET_ID").cast("bigint").alias("MET_ID"), F.round("AVG_Beta", 6).alias("AVG_Beta"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def csv_roundtrip(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    path = writers.write_csv(joined, scratch_path(spark, "csv"), single=True)
    return readers.read_csv_table(spark, path, "n_nationkey int, n_name string, r_name string")


@query(with_tables("subject", """SELECT 'status' AS sheet, sex AS level, count(*) AS n FROM subject GROUP BY sex
    UNION ALL SELECT 'priority', cohort, count(*) FROM subject GROUP BY cohort"""))
def result_sheets(spark, sf_dir):
    rows = subject(spark, sf_dir)
    count = lambda c: rows.groupBy(F.col(c).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    path = writers.write_sheets({"status": count("sex"), "priority": count("cohort")}, scratch_path(spark, "sheets"))
    return spark.read.parquet(path).select("sheet", "level", "n")


@query("SELECT count(*) AS n, 0::BIGINT AS n_out_of_order, (SELECT arg_max(o_orderkey, o_totalprice) FROM orders) AS first_id FROM orders")
def sorted_export(spark, sf_dir):
    """A sink in falling order, read back file by file."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    path = writers.write_parquet(rows, scratch_path(spark, "sorted"), order_by=[F.desc("o_totalprice"), "o_orderkey"])
    read = spark.read.parquet(path).select("o_orderkey", "o_totalprice", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    # Within a file each row is at most the one before; between files, the least of one is at least the greatest of the next.
    inside = read.withColumn("before", F.lag("o_totalprice").over(Window.partitionBy("file").orderBy("at")))
    by_file = inside.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") < F.col("o_totalprice")).alias("wrong"), F.min("o_totalprice").alias("low"),
        F.max("o_totalprice").alias("high"), F.min_by("o_orderkey", "at").alias("first"),
    )
    follows = by_file.withColumn("last_low", F.lag("low").over(Window.orderBy("file")))  # a row per file
    return follows.agg(
        F.sum("n").alias("n"), F.sum(F.col("wrong") + F.coalesce((F.col("last_low") < F.col("high")).cast("int"), F.lit(0))).alias("n_out_of_order"),
        F.min_by("first", "file").alias("first_id"),
    )


@query(with_tables("kept_readings", "SELECT TargetID, MET_ID, round(AVG_Beta, 6) AS AVG_Beta FROM kept_readings"))
def wide_assembly(spark, sf_dir):
    """The complete probes as a matrix in blocks of 100 samples, written, read and unfolded again."""
    long = readings(spark, sf_dir)
    samples = [r[0] for r in table(spark, sf_dir, "embeddings").select("vec_id").orderBy("vec_id").collect()]  # names of columns
    path = wide.write_wide(wide.assemble(long, samples, block=100), scratch_path(spark, "wide"))
    kind = long.schema["MET_ID"].dataType.simpleString()
    back = wide.in_long_form(wide.read_wide(spark, path), samples, "MET_ID", kind, block=100)
    return back.select("TargetID", "MET_ID", F.round("AVG_Beta", 6).alias("AVG_Beta"))


@query(with_tables("readings", "SELECT TargetID::VARCHAR AS TargetID, MET_ID::VARCHAR AS MET_ID, round(AVG_Beta, 6) AS AVG_Beta FROM readings WHERE det_p < 0.5"))
def archived_samples(spark, sf_dir):
    """Readings packed into archives of a text per sample, read from there without unpacking."""
    index = archives.write_archives(readings(spark, sf_dir), scratch_path(spark, "zip"))
    paths = [r[0] for r in index.select("archive").collect()]  # names of files
    return archives.read_archived_samples(spark, paths, limit=0.5).select("TargetID", "MET_ID", F.round("AVG_Beta", 6).alias("AVG_Beta"))
