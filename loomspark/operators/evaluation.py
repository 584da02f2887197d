"""Retrieval quality: graded relevance of hits and its measures per query, type and overall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def relevance(hits: DataFrame, judgments: DataFrame, keys: list[str]) -> DataFrame:
    """Each hit with its relevance: the lowest negative judgment, else the highest positive one, else 0."""
    best = judgments.groupBy(*keys).agg(F.min(F.when(F.col("relevance") < 0, F.col("relevance"))).alias("_bad"), F.max(F.when(F.col("relevance") > 0, F.col("relevance"))).alias("_good"))
    return hits.join(best, keys, "left").withColumn("relevance", F.coalesce("_bad", "_good", F.lit(0))).drop("_bad", "_good")


def query_metrics(judged: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, hit_at_1, hit_at_3, bad_at_3, mrr, ndcg_at_3, ndcg_at_10, first_rank) from (key, rank, relevance).

    The ideal order is the observed one sorted."""
    ideal = judged.withColumn("_best", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("relevance"), "rank")))
    r, rank, best = F.col("relevance"), F.col("rank"), F.col("_best")
    dcg = lambda at, k: F.sum(F.when(at <= k, T.gain(r, at)).otherwise(F.lit(0.0)))
    flag = lambda c: F.max(F.when(c, 1.0).otherwise(0.0))
    sums = ideal.groupBy(key).agg(
        flag((rank <= 1) & (r > 0)).alias("hit_at_1"), flag((rank <= 3) & (r > 0)).alias("hit_at_3"), flag((rank <= 3) & (r < 0)).alias("bad_at_3"),
        F.min(F.when(r > 0, rank)).alias("first_rank"), *[f for k in (3, 10) for f in (dcg(rank, k).alias(f"d{k}"), dcg(best, k).alias(f"i{k}"))],
    )
    share = lambda k: F.round(F.when(F.col(f"i{k}") > 0, F.col(f"d{k}") / F.col(f"i{k}")).otherwise(0.0), 6)
    return sums.select(key, "hit_at_1", "hit_at_3", "bad_at_3", F.round(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), 6).alias("mrr"), share(3).alias("ndcg_at_3"), share(10).alias("ndcg_at_10"), "first_rank")


def rollup(metrics: DataFrame, by: str) -> DataFrame:
    """Means overall ('all') and by type, in one pass."""
    names = ["hit_at_1", "hit_at_3", "bad_at_3", "mrr", "ndcg_at_3", "ndcg_at_10"]
    out = metrics.rollup(by).agg(F.grouping(by).alias("_g"), F.count("*").alias("queries"), *[F.round(F.avg(n), 6).alias(n) for n in names])
    return out.select(F.when(F.col("_g") == 1, "all").otherwise(F.col(by)).alias(by), "queries", *names)


def outcomes(metrics: DataFrame, by: str) -> DataFrame:
    """Counts by type and outcome."""
    return metrics.groupBy(by).agg(F.count_if(F.col("first_rank").isNotNull()).alias("matched"), F.count_if(F.col("first_rank").isNull()).alias("missed"), F.count("*").alias("queries"))
