"""Retrieval quality: recall, reciprocal rank, discounted gain, and their averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """recall@k, MRR@k and nDCG@k of each query, binary relevance.

    ``ranked`` is (query, record, rank), ``gold`` (query, record). A query without
    gold has recall and nDCG 1 and MRR 0."""
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_gold"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    size = gold.groupBy("query").agg(F.count("*").cast("int").alias("n_gold"))
    hits = ranked.where(F.col("rank") <= k).join(gold, ["query", "record"]).groupBy("query").agg(
        F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("gain")
    )
    rows = queries.select("query").join(size, "query", "left").join(hits, "query", "left")
    none = F.col("n_gold").isNull()
    return rows.select(
        "query",
        F.round(F.when(none, 1.0).otherwise(F.coalesce("hits", F.lit(0)) / F.col("n_gold")), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.when(none, 1.0).otherwise(F.coalesce("gain", F.lit(0.0)) / ideal), 6).alias("ndcg"),
    )


def average(metrics: DataFrame, *names: str) -> DataFrame:
    return metrics.agg(*[F.round(F.avg(n), 6).alias(n) for n in names], F.count("*").alias("n_queries"))
