"""Queries of the operators that work on the whole corpus: duplicates, contamination and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import decontaminate, mixing, simhash
from cohortspark.llm.registry import query, table
from cohortspark.llm.text import LOWER, UPPER


@query()
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    judged = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=simhash.SHINGLE, radius=simhash.RADIUS)
    return judged.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def _letter_words(of: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({of}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


HITS_CTES = f"""
docs AS (SELECT row_number() OVER () AS r, doc_id, {_letter_words("text")} AS w FROM documents),
items AS (SELECT item_id::varchar AS item, {_letter_words("text")} AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), {decontaminate.WINDOW}) AS l FROM items WHERE len(w) > 0),
test_windows AS (SELECT DISTINCT item, l, unnest(list_transform(range(1, len(w) - l + 2), lambda s: array_to_string(w[s:s + l - 1], ' '))) AS g FROM sized),
grams AS (
    SELECT r, l, list_transform(range(1, len(w) - l + 2), lambda s: array_to_string(w[s:s + l - 1], ' ')) AS g
    FROM docs, (SELECT DISTINCT l FROM test_windows) WHERE len(w) >= l),
windows AS (SELECT r, l, unnest(g) AS g, generate_subscripts(g, 1) AS s FROM grams),
met AS (SELECT DISTINCT r, item, s, w.l FROM windows w JOIN test_windows t ON w.g = t.g AND w.l = t.l),
hit AS (SELECT r, count(DISTINCT s + k) AS n_hit FROM met, unnest(range({decontaminate.WINDOW})) AS x(k) WHERE k < l GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
"""

HITS_SQL = f"""
WITH {HITS_CTES}
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


@query(HITS_SQL)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of benchmark windows in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    met = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"))
    met = met.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return met.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def _mix_sql(x: str, key: str, round_: int) -> str:
    (first, second), (p, q, r) = mixing.ROUNDS[round_], mixing.PRIMES
    return f"(((({x}) + {key}) % {p} * {first} % {q} + 1) * {second} % {r})"


def _permuted_sql(rows: str, x: str, n: str, key: str, out: str) -> str:
    """The permutation of ``mixing.permuted`` over a sub-query."""
    sql = f"SELECT *, greatest(floor(sqrt({n}::double)), 1)::bigint AS _a, {x}::bigint AS _x FROM ({rows})"
    sql = f"SELECT *, {n} // _a AS _b FROM ({sql})"
    for half in (0, 1):
        sql = f"SELECT *, _x < _a * _b AS _in, _x // _b AS _l0, _x % _b AS _r0 FROM ({sql})"
        sql = f"SELECT *, (_l0 + {_mix_sql('_r0', key, 2 * half)}) % _a AS _l1 FROM ({sql})"
        sql = f"SELECT *, (_r0 + {_mix_sql('_l1', key, 2 * half + 1)}) % _b AS _r1 FROM ({sql})"
        moved = "CASE WHEN _in THEN _l1 * _b + _r1 ELSE _x END"
        if not half:
            moved = f"(({moved}) + {n} // 2 + {key}) % {n}"
        sql = f"SELECT * EXCLUDE (_x, _in, _l0, _r0, _l1, _r1), {moved} AS _x FROM ({sql})"
    return f"SELECT * EXCLUDE (_x, _a, _b), _x AS {out} FROM ({sql})"


B = mixing.BLOCK_WORDS
MIX_SQL = rf"""
WITH sizes AS (
    SELECT row_number() OVER () AS r, doc_id, source, md5(coalesce(text, '')) AS digest,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size FROM documents),
by_source AS (SELECT source, sum(size)::bigint AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM by_source),
weighed AS (SELECT *, {list(mixing.WEIGHTS)}[rank % {len(mixing.WEIGHTS)} + 1] AS weight, {mixing.MOST_TIMES} * source_size AS cap FROM ranked),
levels AS (
    SELECT *, ((sum(source_size) OVER ())::double * {mixing.SHARE}
        - coalesce(sum(cap) OVER (ORDER BY cap::double / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double)
        / (sum(weight) OVER (ORDER BY cap::double / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::double AS level FROM weighed),
goals AS (
    SELECT rank, source, source_size, least((max(level) OVER ()) * weight, cap::double) AS target FROM levels),
placed AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY rank, bucket ORDER BY doc_id NULLS FIRST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS pos
    FROM (SELECT s.*, rank, source_size, target,
                 ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':' || digest), 1, 8))::bigint
                     % greatest(ceil(source_size / {mixing.BUCKET_WORDS}.0), 1)::bigint AS bucket
          FROM sizes s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)),
buckets AS (
    SELECT rank, bucket, blocks, coalesce(sum(blocks) OVER (PARTITION BY rank ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS first_block
    FROM (SELECT rank, bucket, ceil(sum(size) / {B}.0)::bigint AS blocks FROM placed GROUP BY rank, bucket)),
quota AS (
    SELECT rank, blocks, tickets, coalesce(sum(tickets) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS first_ticket
    FROM (SELECT rank, blocks, round(target * blocks / source_size)::bigint AS tickets
          FROM goals JOIN (SELECT rank, sum(blocks)::bigint AS blocks FROM buckets GROUP BY rank) USING (rank) WHERE source_size > 0) WHERE tickets > 0),
total AS (SELECT coalesce(sum(tickets), 0)::bigint AS total FROM quota),
dealt AS ({_permuted_sql("SELECT unnest(range(total)) AS slot, total FROM total", "slot", "total", "0", "ticket")}),
owned AS (
    SELECT rank, blocks, (ticket - first_ticket) % blocks AS k, 1000003 + rank * 7919 + (ticket - first_ticket) // blocks * 104729 AS own_key
    FROM dealt JOIN quota ON ticket >= first_ticket AND ticket < first_ticket + tickets),
times AS (SELECT rank, block, count(*) AS times FROM ({_permuted_sql("SELECT * FROM owned", "k", "blocks", "own_key", "block")}) GROUP BY rank, block),
touched AS (
    SELECT r, rank, pos, size, first_block, unnest(range(pos // {B}, (pos + size - 1) // {B} + 1)) AS local FROM placed JOIN buckets USING (rank, bucket) WHERE size > 0),
sums AS (
    SELECT r, sum((least((local + 1) * {B} - pos, size) - greatest(local * {B} - pos, 0)) * times)::bigint AS taken
    FROM touched t JOIN times m ON t.rank = m.rank AND first_block + local = m.block GROUP BY r)
SELECT doc_id, source, size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN sums USING (r)
"""


@query(MIX_SQL)
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.taken(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
