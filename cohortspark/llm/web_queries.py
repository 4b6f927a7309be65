"""Queries of the operators on pages and of those that count and score text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import ppm, resampling, rollups, url_rules, warc
from cohortspark.llm.registry import query, table
from cohortspark.llm.text import LOWER, UPPER
from cohortspark.session import materialise, scratch_path

# Fixed values of the contract: host, path and verdict of each rule.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
RULE_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

URL_SQL = rf"""
WITH rules(h, p, v) AS (VALUES {RULE_VALUES}),
parts AS (
    SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
fits AS (
    SELECT r, h || p AS rule, v FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits USING (r)
"""


@query(URL_SQL)
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


WARC_SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages),
hashed AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS sha, keeper FROM payloads),
kinds AS (SELECT *, CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to FROM hashed)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(sha, i // 8 * 10 + 1, 10))::bigint >> (35 - i % 8 * 5)) & 31) + 1)::bigint, 1)), '') AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM kinds
"""


@query(WARC_SQL)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back through the index."""
    found = warc.archive(spark, table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op4_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-model and byte-model log10 probability of every document."""
    return ppm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


ROLLUP_SQL = rf"""
WITH held AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
rows AS (
    SELECT source, lang, good, CASE WHEN good = 1 THEN 'letters-1' ELSE 'spaced-1' END AS tokenizer_version,
           CASE WHEN good = 1 THEN len(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))
                ELSE len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) END AS n
    FROM documents LEFT JOIN held USING (doc_id))
SELECT source, lang, tokenizer_version, count(*) AS n_docs, sum(n)::bigint AS n_tokens FROM rows WHERE good IS DISTINCT FROM 0
GROUP BY source, lang, tokenizer_version
"""


@query(ROLLUP_SQL)
def op2_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after all documents came, those labelled bad went, and those labelled good were counted anew; one batch is sent twice."""
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("good"))
    first, second = rollups.TOKENIZERS
    text = F.col("text")
    counted = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", rollups.token_count(text, first).alias("first"), rollups.token_count(text, second).alias("second"))
    counted = materialise(counted)
    under = lambda rows, version, column: rows.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.col(column).alias("n_tokens"))
    known = counted.join(labels, "doc_id")
    bad, good = known.where("good = 0"), known.where("good = 1")
    totals = rollups.Rollup(spark, scratch_path(spark, "rollup"))
    totals.commit("load", rollups.inserts(under(counted, first, "first")))
    totals.commit("removal", rollups.deletes(under(bad, first, "first")))
    totals.commit("recount", rollups.revisions(under(good, first, "first"), under(good, second, "second")))
    totals.commit("removal", rollups.deletes(under(bad, first, "first")))
    return totals.totals()


@query()
def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every document towards texts labelled good, and a draw of as large a share as is good among the labelled."""
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL")
    share = labels.agg(F.avg("quality")).first()[0] or 0.0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampling.resample(docs, labels.where("quality = 1").select("doc_id"), share)
