"""Over-representation of a gene list in gene-set libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import pvalues
from cohortspark.functions.text import wrap_term
from cohortspark.operators.joins import lookup_join
from cohortspark.operators.multiple import adjust_pvalues
from cohortspark.session import materialise

ALPHA = 0.05


def term_overlaps(genes: DataFrame, sets: DataFrame, library: str = "library", term: str = "term", gene: str = "gene") -> DataFrame:
    """Per library and term: overlap with the query, term, query and library sizes."""
    members = sets.select(F.col(library).alias("library"), F.col(term).alias("term"), F.col(gene).alias("gene")).distinct()
    query = genes.select(F.col("gene"), F.lit(True).alias("_hit")).distinct()
    marked = lookup_join(members, query, ["gene"], "left")
    # Distinct genes of a library: its background, and the query genes it knows.
    background = marked.groupBy("library", "gene").agg(F.bool_or(F.coalesce("_hit", F.lit(False))).alias("_hit"))
    sizes = background.groupBy("library").agg(F.count(F.lit(1)).alias("n_background"), F.count_if("_hit").alias("n_query"))
    terms = marked.groupBy("library", "term").agg(
        F.count(F.lit(1)).alias("n_term"), F.count_if(F.coalesce("_hit", F.lit(False))).alias("n_overlap")
    )
    return lookup_join(terms.where("n_overlap > 0"), sizes, ["library"], "inner")


def over_representation(genes: DataFrame, sets: DataFrame, alpha: float | None = ALPHA, **names: str) -> DataFrame:
    """Hypergeometric tail, corrected within each library, with a combined score.

    ``odds`` adds one half to each cell; ``combined = -ln(p) * odds``.  Only terms
    sharing a gene with the query are tested.  ``alpha`` keeps corrected p below it.
    """
    k, marked, drawn, population = (F.col(c) for c in ("n_overlap", "n_term", "n_query", "n_background"))
    table = term_overlaps(genes, sets, **names)
    table = table.withColumn("p", pvalues.hypergeometric("n_overlap", "n_term", "n_query", "n_background"))
    odds = ((k + 0.5) * (population - marked - drawn + k + 0.5)) / ((marked - k + 0.5) * (drawn - k + 0.5))
    table = table.withColumn("odds", odds)
    table = table.withColumn("combined", -F.log(F.when(F.col("p") > 0, F.col("p"))) * F.col("odds"))
    corrected = adjust_pvalues(materialise(table), ["p"], by=["library"])
    return corrected if alpha is None else corrected.where(F.col("adj_p") < alpha)


def overlap_genes(genes: DataFrame, sets: DataFrame, kept: DataFrame, library: str = "library", term: str = "term", gene: str = "gene") -> DataFrame:
    """The shared genes of each reported term as a sorted ``;`` list.

    Each list is at most the query, which is the number of significant symbols.
    """
    members = sets.select(F.col(library).alias("library"), F.col(term).alias("term"), F.col(gene).alias("gene")).distinct()
    shared = lookup_join(members, genes.select("gene").distinct(), ["gene"], "left_semi")
    lists = shared.groupBy("library", "term").agg(F.concat_ws(";", F.sort_array(F.collect_set("gene"))).alias("genes"))
    return kept.join(lists, ["library", "term"], "left")


def reported_terms(genes: DataFrame, sets: DataFrame, alpha: float | None = ALPHA, **names: str) -> DataFrame:
    """Over-represented terms with the genes they share, numbered by falling combined score, ties by library and term."""
    found = over_representation(genes, sets, alpha, **names)
    listed = overlap_genes(genes, sets, found, **names)
    rank = F.row_number().over(Window.orderBy(F.desc("combined"), "library", "term"))  # one row per reported term
    return listed.withColumn("rank", rank).orderBy("rank")


def top_terms(results: DataFrame, n: int = 3, wrap: bool = True) -> DataFrame:
    """The ``n`` terms with the highest combined score per library."""
    rank = F.row_number().over(Window.partitionBy("library").orderBy(F.desc("combined"), "term"))
    top = results.withColumn("rank", rank).where(F.col("rank") <= n)
    return top.withColumn("shown", wrap_term(F.col("term"))) if wrap else top
