"""Retrieval quality: precision, recall, term coverage, reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_queries(queries: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """Scores of each query from its ranked hits (query_id, rank, text, title).

    A hit is relevant if an expected source is part of its title, or if it
    holds at least half (rounded down) of the expected terms; so with one or
    no term every hit is.  Precision divides by ``k``; recall asks for any
    expected source; no expected term is full coverage.
    """
    has = lambda c, x: F.contains(F.lower(c), F.lower(x))
    joined = hits.where(F.col("rank") <= k).join(queries, "query_id")
    by_source = F.exists("expected_sources", lambda s: has(F.col("title"), s))
    matched = F.filter("expected_terms", lambda t: has(F.col("text"), t))
    enough = F.size(matched) >= F.floor(F.size("expected_terms") / 2)
    judged = joined.select("query_id", "rank", by_source.alias("source"), matched.alias("matched"), (by_source | enough).alias("relevant"))
    per_query = judged.groupBy("query_id").agg(F.count_if("relevant").alias("relevant_count"), F.bool_or("source").alias("found"), F.array_distinct(F.flatten(F.collect_list("matched"))).alias("terms"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    out = queries.join(per_query, "query_id", "left")
    expected = F.size("expected_terms")
    return out.select(
        "query_id", (F.coalesce("relevant_count", F.lit(0)) / k).alias("precision_at_k"), F.coalesce(F.col("found").cast("double"), F.lit(0.0)).alias("recall"),
        F.when(expected == 0, 1.0).otherwise(F.coalesce(F.size(F.array_intersect("terms", "expected_terms")), F.lit(0)) / expected).alias("term_coverage"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce("relevant_count", F.lit(0)).alias("relevant_count"),
    )


def report(scores: DataFrame, *keys: str) -> DataFrame:
    """Means, and how many queries fail (recall or term coverage under a half)."""
    mean = lambda c: F.avg(c).alias(f"mean_{c}")
    return scores.groupBy(*keys).agg(F.count("*").alias("queries"), mean("precision_at_k"), mean("recall"), mean("term_coverage"), mean("mrr"), F.count_if((F.col("recall") < 0.5) | (F.col("term_coverage") < 0.5)).alias("failures"))
