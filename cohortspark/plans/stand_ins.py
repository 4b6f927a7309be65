"""Cohort-shaped tables derived from the test tables, in Spark and as SQL.

The SQL pieces are common table expressions; :func:`with_tables` puts the ones a
check needs in front of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.numeric import uniform
from cohortspark.operators.matrix import complete_readings

SEED = 30
LABEL_CUTOFF = 70000
FRAGILE, PRESENT = 5, 0.9
"""Every fifth probe is read in nine samples of ten only; the others in all, however many samples there are."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_uniform(*parts: str) -> str:
    """SQL form of :func:`cohortspark.functions.numeric.uniform`."""
    return f"(('0x' || substr(md5(concat_ws(':', '{SEED}', {', '.join(parts)})), 1, 13))::BIGINT / 4503599627370496.0)"


def sql_hash(*parts: str) -> str:
    return f"md5(concat_ws(':', '{SEED}', {', '.join(parts)}))"


def subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: summed quantities, a derived index and its label."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").alias("qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("price"),
            F.round(F.avg("l_discount"), 6).alias("disc"),
            F.round(F.avg("l_tax"), 6).alias("tax"),
        )
    )
    orders = table(spark, sf_dir, "orders")
    idx = F.col("qty") * F.col("o_totalprice") / 405
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderstatus").alias("sex"),
        F.col("o_orderpriority").alias("cohort"),
        "qty",
        "price",
        "disc",
        "tax",
        F.col("o_totalprice").alias("total"),
        idx.alias("idx"),
        (idx > LABEL_CUTOFF).alias("label"),
    )


def complete_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject(spark, sf_dir).where("qty IS NOT NULL AND total IS NOT NULL")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a probability that has many ties."""
    p = F.round(1 / (1 + F.exp(-(F.col("price") - 100000) / 50000)), 3)
    return complete_subject(spark, sf_dir).select("id", "cohort", F.col("label").cast("int").alias("y"), p.alias("p"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long probe readings: TargetID, MET_ID, AVG_Beta, det_p and the group."""
    exploded = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x"))
    return exploded.select(
        F.col("dim").cast("bigint").alias("TargetID"),
        F.col("vec_id").alias("MET_ID"),
        ((1 + F.col("x").cast("double")) / 2).alias("AVG_Beta"),
        uniform(SEED, "vec_id", "dim").alias("det_p"),
        (F.col("label") < 2).alias("positive"),
    ).where((F.col("TargetID") % FRAGILE != 0) | (F.col("det_p") < PRESENT))


def kept_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of the probes that every sample has."""
    # A vector is exploded by position, so a (probe, sample) pair occurs once.
    return complete_readings(readings(spark, sf_dir), None, table(spark, sf_dir, "embeddings").count(), unique=True)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe manifest, every column text, one probe per part."""
    number = F.col("p_partkey")
    place = number % 24
    chrom = F.when(place == 0, "X").when(place == 23, "Y").otherwise(place.cast("string"))
    prefix = F.when(number % 10 == 9, "rs").otherwise("cg")
    return table(spark, sf_dir, "part").select(
        F.concat(prefix, F.lpad(number.cast("string"), 8, "0")).alias("Probe_ID"),
        chrom.alias("CHR"),
        (number * 30).cast("string").alias("MAPINFO"),
        F.replace("p_name", F.lit(" "), F.lit(";")).alias("UCSC_REFGENE_NAME"),
        F.replace("p_type", F.lit(" "), F.lit(";")).alias("UCSC_REFGENE_GROUP"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).alias("RELATION_TO_UCSC_CPG_ISLAND"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of very different lengths with a coding part and a status."""
    part = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    status = F.expr("CASE WHEN p_partkey % 4 = 0 THEN 'none' WHEN p_partkey % 4 = 1 THEN 'incmpl' ELSE 'cmpl' END")
    return part.select(
        F.col("p_name").alias("name"),
        key.alias("transcript"),
        (key % 24).alias("chrom"),
        key.alias("txStart"),
        (key + size * 10).alias("txEnd"),
        key.alias("cdsStart"),
        (key + size * 3).alias("cdsEnd"),
        status.alias("cdsStartStat"),
        status.alias("cdsEndStat"),
    )


def probe_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One position per supplier, spread over all transcripts and a tenth beyond them."""
    last = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("TargetID"),
        (F.col("s_suppkey") % 24).alias("chrom"),
        (F.col("s_suppkey") * 7919 % (last * 11 // 10 + 1)).alias("Position"),
    )


def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("library"), F.col("p_brand").alias("term"), F.col("p_name").alias("gene")
    )


def query_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_name").startswith("red ")).select(F.col("p_name").alias("gene")).distinct()


TABLES = {
    "subject": f"""
        SELECT o_orderkey AS id, o_custkey AS custkey, o_orderstatus AS sex, o_orderpriority AS cohort,
               qty, price, disc, tax, o_totalprice AS total, qty * o_totalprice / 405 AS idx,
               qty * o_totalprice / 405 > {LABEL_CUTOFF} AS label
        FROM orders LEFT JOIN (
            SELECT l_orderkey, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS price,
                   round(avg(l_discount), 6) AS disc, round(avg(l_tax), 6) AS tax
            FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
    "complete_subject": "SELECT * FROM subject WHERE qty IS NOT NULL AND total IS NOT NULL",
    "predictions": """
        SELECT id, cohort, label::INT AS y, round(1 / (1 + exp(-(price - 100000) / 50000)), 3) AS p
        FROM complete_subject""",
    "readings": f"""
        SELECT dim AS TargetID, vec_id AS MET_ID, (1 + x::DOUBLE) / 2 AS AVG_Beta,
               {sql_uniform('vec_id', 'dim')} AS det_p, label < 2 AS positive
        FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings)
        WHERE dim % {FRAGILE} <> 0 OR {sql_uniform('vec_id', 'dim')} < {PRESENT}""",
    "kept_readings": """
        SELECT * FROM readings WHERE TargetID IN (
            SELECT TargetID FROM readings GROUP BY TargetID
            HAVING count(DISTINCT MET_ID) = (SELECT count(*) FROM embeddings))""",
    "manifest": """
        SELECT (CASE WHEN p_partkey % 10 = 9 THEN 'rs' ELSE 'cg' END) || lpad(p_partkey::VARCHAR, 8, '0') AS Probe_ID,
               CASE p_partkey % 24 WHEN 0 THEN 'X' WHEN 23 THEN 'Y' ELSE (p_partkey % 24)::VARCHAR END AS CHR,
               (p_partkey * 30)::VARCHAR AS MAPINFO, replace(p_name, ' ', ';') AS UCSC_REFGENE_NAME,
               replace(p_type, ' ', ';') AS UCSC_REFGENE_GROUP,
               CASE WHEN p_size > 25 THEN p_brand END AS RELATION_TO_UCSC_CPG_ISLAND
        FROM part""",
    "transcripts": """
        SELECT p_name AS name, p_partkey AS transcript, p_partkey % 24 AS chrom, p_partkey AS txStart,
               p_partkey + p_size::BIGINT * 10 AS txEnd, p_partkey AS cdsStart, p_partkey + p_size::BIGINT * 3 AS cdsEnd,
               CASE p_partkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'incmpl' ELSE 'cmpl' END AS cdsStartStat,
               CASE p_partkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'incmpl' ELSE 'cmpl' END AS cdsEndStat
        FROM part""",
    "probe_positions": """
        SELECT s_suppkey AS TargetID, s_suppkey % 24 AS chrom, s_suppkey * 7919 % ((SELECT max(p_partkey) FROM part) * 11 // 10 + 1) AS "Position" FROM supplier""",
    "gene_sets": "SELECT DISTINCT p_type AS library, p_brand AS term, p_name AS gene FROM part",
    "query_genes": "SELECT DISTINCT p_name AS gene FROM part WHERE starts_with(p_name, 'red ')",
}

_NEEDS = {
    "complete_subject": ["subject"],
    "predictions": ["subject", "complete_subject"],
    "kept_readings": ["readings"],
}


def with_tables(names: str, body: str) -> str:
    """``body`` preceded by the named stand-ins (comma separated) and what they need."""
    ordered: list[str] = []
    for name in names.replace(" ", "").split(","):
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    heads = ",\n".join(f"{n} AS ({TABLES[n]})" for n in ordered)
    body = body.strip()
    joint = ",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body
    return f"WITH {heads}{joint}"


def sql_normal_two_sided(z: str) -> str:
    """P(|Z| >= z) through the series of the error function."""
    return (
        f"(CASE WHEN {z} IS NULL THEN NULL WHEN {z} > 10 THEN 0.0 WHEN {z} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 200), "
        f"lambda k: exp((k + 0.5) * ln({z} * {z} / 2) - {z} * {z} / 2 - lgamma(k + 1.5))))) END)"
    )


def sql_student_two_sided(t: str, df: str) -> str:
    y = f"({t} * {t} / ({df} + {t} * {t}))"
    return (
        f"(CASE WHEN {t} = 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 400), lambda k: exp((0.5 + k) * ln({y}) + {df} / 2 * ln(1 - {y}) "
        f"+ lgamma(0.5 + {df} / 2 + k) - lgamma(1.5 + k) - lgamma({df} / 2))))) END)"
    )
