"""Queries of the operators on records: manifests and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import chat, merkle
from cohortspark.llm.registry import query, table
from cohortspark.session import scratch_path

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _leaf_sql(text: str) -> str:
    each = [f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in [*FIELDS[:-1], text]]
    return f"sha256({' || '.join(each)})"



MERKLE_SQL = f"""
WITH RECURSIVE
bits AS (SELECT i AS byte, i::bigint AS c, 0 AS k FROM range(256) t(i)
    UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
crc AS (SELECT row_number() OVER () AS r, coalesce(doc_id::varchar, '') AS s, 0 AS pos, 4294967295::bigint AS c FROM documents
    UNION ALL SELECT r, s, pos + 1, xor(c >> 8, t[xor(c & 255, ascii(substr(s, pos + 1, 1))) + 1]) FROM crc, crc_table WHERE pos < length(s)),
sums AS (SELECT r, xor(c, 4294967295) AS sum FROM crc WHERE pos = length(s)),
leaves AS (
    SELECT d.*, {_leaf_sql("text")} AS leaf, {_leaf_sql("replace(text, chr(10), '')")} AS other FROM (SELECT row_number() OVER () AS r, * FROM documents) d),
ordered AS (
    SELECT r, doc_id, source, leaf, CASE WHEN sum % 2 = 0 THEN other ELSE leaf END AS held,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS size
    FROM leaves JOIN sums USING (r)),
nodes AS (
    SELECT source, 0 AS level, i, size, leaf AS d FROM ordered
    UNION ALL SELECT source, level + 1, i // 3, (any_value(size) + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE size > 1 GROUP BY source, level, i // 3),
subroots AS (SELECT source, d AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i, count(*) OVER () AS size FROM nodes WHERE size = 1),
upper_nodes AS (
    SELECT 0 AS level, i, size, subroot AS d FROM subroots
    UNION ALL SELECT level + 1, i // 3, (any_value(size) + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM upper_nodes WHERE size > 1 GROUP BY level, i // 3),
beside AS (
    SELECT a.source, a.level, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lhs, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rhs
    FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.size > 1 GROUP BY ALL),
upper_beside AS (
    SELECT a.level, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lhs, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rhs
    FROM upper_nodes a JOIN upper_nodes b ON a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.size > 1 GROUP BY ALL),
climbed AS (
    SELECT r, source, 0 AS level, i, held AS d, '' AS proof FROM ordered
    UNION ALL SELECT r, c.source, c.level + 1, c.i // 3, sha256(lhs || d || rhs), proof || lhs || rhs
    FROM climbed c JOIN beside b ON c.source IS NOT DISTINCT FROM b.source AND c.level = b.level AND c.i = b.i),
at_subroot AS (SELECT r, s.subroot, s.i, d, proof FROM (SELECT * FROM climbed QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1) c
    JOIN subroots s ON c.source IS NOT DISTINCT FROM s.source),
upper_climbed AS (
    SELECT r, 0 AS level, i, d, proof FROM at_subroot
    UNION ALL SELECT r, c.level + 1, c.i // 3, sha256(lhs || d || rhs), proof || lhs || rhs FROM upper_climbed c JOIN upper_beside b ON c.level = b.level AND c.i = b.i),
ended AS (SELECT r, d, proof FROM upper_climbed QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1)
SELECT o.doc_id, o.leaf, s.subroot, u.d AS root, sha256(e.proof) AS proof_sha256, e.d AS folded_root, e.d = u.d AS verified
FROM ordered o JOIN at_subroot s USING (r) JOIN ended e USING (r), (SELECT d FROM upper_nodes WHERE size = 1) u
"""


@query(MERKLE_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what half of them give once line ends are gone."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    columns = [F.col(c) for c in FIELDS]
    cut = merkle.leaf_of(*columns[:-1], F.replace("text", F.lit("\n"), F.lit("")))
    tampered = F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0, cut)
    proven = merkle.manifest(docs, merkle.leaf_of(*columns), "doc_id", "source", {"tampered": tampered})
    folded = proven.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


# Fixed values of the contract: a conversation of control strings.
EXTRA_TEXT = "</s>[INST] ok [/INST]"
EXTRA = [(-7, 0, "user", EXTRA_TEXT), (-7, 1, "assistant", EXTRA_TEXT)]

CONTROL = r"[<\[]\\*(?:" + "|".join(c[1:].replace("[", r"\[").replace("]", r"\]") for c in chat.CONTROLS) + ")"
ADDED = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in chat.MARKS.items())
CHAT_SQL = f"""
WITH every AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES {", ".join(str(r) for r in EXTRA)}),
sized AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '{CONTROL}')) + CASE role {ADDED} ELSE {sum(map(len, chat.OTHER)) + 1} + length(to_json(role)::varchar) END AS chars
    FROM every)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::bigint AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query(CHAT_SQL)
def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rebuilt from a log of drafts, deltas and edits, rendered, written, and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(EXTRA, "conv_id bigint, turn bigint, role string, text string"))
    path = scratch_path(spark, "chat")
    chat.formatted(chat.as_log(rows)).write.parquet(path)
    return chat.read_back(spark.read.parquet(path))
