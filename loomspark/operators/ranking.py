"""Reranking by signals, diversification and paging of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import urls as U


def term_matches(terms: Column, text: Column) -> Column:
    """How many terms equal a token of the text or are its prefix or have it as theirs."""
    tokens = T.query_tokens(text)
    return F.size(F.filter(terms, lambda t: F.exists(tokens, lambda k: k.startswith(t) | t.startswith(k))))


def source_match(url: str, domains: tuple[str, ...], paths: tuple[str, ...]) -> Column:
    """0 for another host, 1 for one of the domains, 2 for below one of the paths, 3 for one of the paths."""
    host, path = U.host(url), F.when(U.path(url) == "", "/").otherwise(U.path(url))
    ours = host.isin(*domains, *[f"www.{d}" for d in domains])
    below = F.lit(False)
    for p in paths:
        below = below | ((path == "/") if p == "/" else path.startswith(p))
    return F.when(~ours, 0).when(path.isin(*paths), 3).when(below, 2).otherwise(1)


def rerank(hits: DataFrame, intent: list[str], domains: tuple[str, ...] = (), paths: tuple[str, ...] = (), partition: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """New ranks by source match, title and path matches, page and domain rank, and last the old rank.

    hits: url, title, rank, page_rank, domain_rank; null ranks count as 0."""
    terms = F.array(*map(F.lit, intent)) if intent else F.array().cast("array<string>")
    signals = hits.select(
        "*", source_match("url", domains, paths).alias("source_match"), term_matches(terms, F.col("title")).alias("title_match"), term_matches(terms, U.path("url")).alias("path_match"),
    )
    order = [F.desc("source_match"), F.desc("title_match"), F.desc("path_match"), F.desc(F.coalesce("page_rank", F.lit(0.0))), F.desc(F.coalesce("domain_rank", F.lit(0.0))), F.col("rank")]
    ranked = signals.withColumn("new_rank", F.row_number().over(Window.partitionBy(*(partition or [F.lit(0)])).orderBy(*order)))
    return ranked if limit is None else ranked.where(F.col("new_rank") <= limit)


def diversify(hits: DataFrame, limit: int, per_domain: int = 3, partition: list[str] | None = None) -> DataFrame:
    """At most `per_domain` hits of a registered domain, then the first `limit`; order kept."""
    keys = partition or []
    capped = hits.withColumn("domain", U.registered_domain("url")).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "domain").orderBy("rank"))).where(F.col("_n") <= per_domain)
    return capped.withColumn("position", F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("rank"))).where(F.col("position") <= limit).drop("_n")


def domains_first(hits: DataFrame, partition: list[str]) -> DataFrame:
    """First one hit of each host, then the repeats; order kept within both."""
    seen = hits.withColumn("_n", F.row_number().over(Window.partitionBy(*partition, U.host("url")).orderBy("rank")))
    return seen.withColumn("position", F.row_number().over(Window.partitionBy(*partition).orderBy(F.col("_n") > 1, "rank"))).drop("_n")


def page_of(total: int, page: int, size: int) -> dict[str, int]:
    return {"offset": (page - 1) * size, "last_page": max(-(-total // size), 1)}


def impressions(hits: DataFrame, page: int, size: int) -> DataFrame:
    return hits.withColumn("position", F.lit((page - 1) * size) + F.col("rank"))
