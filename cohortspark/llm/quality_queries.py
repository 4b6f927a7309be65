"""Queries of the operators that judge documents: quality rules and toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import quality_rules, toxicity
from cohortspark.llm.registry import query, table
from cohortspark.llm.text import fold
from cohortspark.session import materialise

RULE_ROWS = ", ".join(
    f"('{rule}', {step}, {cutoff})" for rule, (_, _, cutoffs) in quality_rules.RULES.items() for step, cutoff in enumerate(cutoffs)
)
COUNT_OF = " ".join(f"WHEN '{rule}' THEN {count}" for rule, (count, _, _) in quality_rules.RULES.items())
PER_OF = " ".join(f"WHEN '{rule}' THEN {per}" for rule, (_, per, _) in quality_rules.RULES.items())
N_RULES = len(quality_rules.RULES)

QUALITY_SQL = rf"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
windows AS (
    SELECT r, unnest(g) AS gram, generate_subscripts(g, 1) AS i
    FROM (SELECT r, list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) AS g FROM texts WHERE len(words) >= 5)),
repeated AS (
    SELECT r, count(DISTINCT i + k) AS n_repeat_words
    FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM windows), unnest(range(5)) AS s(k) WHERE c > 1 GROUP BY r),
stats AS (
    SELECT r, doc_id, stratum, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words,
           length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_marks
    FROM texts LEFT JOIN repeated USING (r)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM stats),
cutoffs(rule, step, cutoff) AS (VALUES {RULE_ROWS}),
cells AS (
    SELECT r, stratum, rule, step, cutoff, 1000 * (CASE rule {COUNT_OF} END) > cutoff * (CASE rule {PER_OF} END) AS above, base_failed
    FROM based, cutoffs),
held AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
counted AS (
    SELECT c.stratum, rule, step, cutoff, count(*) FILTER (good = 1) AS n, count(*) FILTER (good = 0) AS m,
           count(*) FILTER (good = 1 AND above) AS k, count(*) FILTER (good = 0 AND above) AS b
    FROM cells c JOIN based USING (r) JOIN held USING (doc_id) WHERE NOT c.base_failed GROUP BY ALL),
tested AS (
    SELECT *, list_sum(list_transform(range(0, k + 1),
        lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({quality_rules.RISK / N_RULES!r}) + (n - j) * ln(1 - {quality_rules.RISK / N_RULES!r}))))
        <= {quality_rules.ERROR} / ((SELECT count(DISTINCT stratum) FROM counted) * {N_RULES}) AS passes,
        b::double / greatest(m, 1) - {quality_rules.GOOD_WEIGHT} * k / greatest(n, 1) AS value
    FROM counted),
stopped AS (SELECT *, min(step) FILTER (NOT passes) OVER (PARTITION BY stratum, rule) AS stop FROM tested),
chosen AS (
    SELECT stratum, rule, cutoff FROM stopped WHERE value > 0 AND (stop IS NULL OR step < stop)
    QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY value DESC, step) = 1),
failed AS (SELECT DISTINCT r FROM cells JOIN chosen USING (stratum, rule, cutoff) WHERE above)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::bigint AS n_repeat_words, base_failed,
       NOT base_failed AND r NOT IN (SELECT r FROM failed) AS kept
FROM based
"""


@query(QUALITY_SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the verdict of every document, cutoffs certified per language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = materialise(quality_rules.described(docs).drop("text"))
    known = quality_rules.with_labels(rows, table(spark, sf_dir, "labels"))
    cutoffs = quality_rules.fit_cutoffs(known.where(~quality_rules.base_failed()))
    judged = quality_rules.verdicts(rows, cutoffs)
    figures = [F.col(f"_stats.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *figures, quality_rules.base_failed().alias("base_failed"), F.col("_kept").alias("kept"))


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, trained outside fold 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (fold(F.col("doc_id"), toxicity.FOLDS) == 0).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
