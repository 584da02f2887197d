"""Joins that aren't on equal keys: aliases, rules on hits, and merges of configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import urls as U


# Fixed value: what stands between the sides of a comparison.
VERSUS = r"\s+(?:vs|versus)\s+"


def prefixes(query: Column, most: int = 8) -> Column:
    """The first one to `most` words of a query: what an alias of so many words may equal."""
    words = F.split(query, " ")
    return F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(most))), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))


def match_alias(queries: DataFrame, aliases: DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, query, source, alias, rest): the longest alias that a query equals or starts with, by whole words.

    Exploding a query's few prefixes makes the theta join an equi join.  queries: query_id, query (normalised); aliases:
    source, alias.  Ties go to the smaller source.  `most`: words of the longest alias; looked up if it isn't given."""
    if most is None:
        most = aliases.agg(F.max(F.size(F.split("alias", " ")))).head()[0] or 1
    hit = queries.select("query_id", "query", F.explode(prefixes(F.col("query"), most)).alias("alias")).join(aliases, "alias")
    best = hit.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.length("alias")), "source"))).where("_n = 1").drop("_n")
    return best.select("query_id", "query", "source", "alias", F.trim(F.substring(F.col("query"), F.length("alias") + 1, F.length("query"))).alias("rest"))


def comparison(query: Column) -> Column:
    """The two sides of `a vs b`; null where there aren't two different ones."""
    parts = F.split(query, VERSUS, 2)
    left, right = F.trim(F.get(parts, 0)), F.trim(F.get(parts, 1))
    return F.when((left != "") & (right != "") & (left != right), F.array(left, right))


def judge(hits: DataFrame, judgments: DataFrame) -> DataFrame:
    """Relevance of each hit: the lowest negative judgment that fits it, else the highest positive one, else 0.

    A judgment (query_id, relevance, url, domain, path_prefix, title_terms) fits if all its parts that aren't null do; its
    query is an equal key, so only the few judgments of a query meet its hits."""
    j = judgments.select(F.col("query_id").alias("_q"), *[F.col(c).alias(f"_{c}") for c in ("relevance", "url", "domain", "path_prefix", "title_terms")])
    host = F.regexp_replace(U.host("url"), r"^www\.", "")
    fits = (
        (F.col("query_id") == F.col("_q"))
        & (F.col("_url").isNull() | (F.col("url") == F.col("_url")))
        & (F.col("_domain").isNull() | (host == F.col("_domain")) | host.endswith(F.concat(F.lit("."), F.col("_domain"))))
        & (F.col("_path_prefix").isNull() | U.path("url").startswith(F.col("_path_prefix")))
        & (F.col("_title_terms").isNull() | F.forall("_title_terms", lambda t: F.contains(F.lower(F.coalesce("title", F.lit(""))), t)))
    )
    met = hits.join(j, fits, "left").groupBy(*hits.columns).agg(F.min(F.when(F.col("_relevance") < 0, F.col("_relevance"))).alias("_bad"), F.max(F.when(F.col("_relevance") > 0, F.col("_relevance"))).alias("_good"))
    return met.select(*hits.columns, F.coalesce("_bad", "_good", F.lit(0)).alias("relevance"))


def first_wins(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Of rows with the same normalised key the first in order."""
    names = rows.columns
    return rows.groupBy(key.alias("_k")).agg(F.min(F.struct(*order, F.struct(*names).alias("_r"))).alias("_m")).where("_k is not null").select("_m._r.*")


def query_key(query) -> Column:
    return F.array_join(T.query_tokens(query), " ")
