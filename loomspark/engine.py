"""One object over the tables of a folder: search, lookup, counts, evaluation and refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, ranking, retrieval, snippets, tables
from .operators.matching import judge
from .session import cut


class Engine:
    """documents: url, title, content, indexed_at; links: src, dst."""

    def __init__(self, spark: SparkSession, documents: DataFrame, links: DataFrame):
        self.spark, self.documents, self.links = spark, documents, links
        self._index: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> "Engine":
        return cls(spark, spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/links.parquet"))

    def index(self) -> DataFrame:
        """The search projection with ranks, built once and kept in the shared folder."""
        if self._index is None:
            newest = tables.last_per_key(self.documents.select("url", "title", "content", "indexed_at"), ["url"], ["indexed_at"])
            pages = graph.pagerank(newest.select("url"), graph.page_edges(self.links, newest.select("url")))
            nodes, edges = graph.domain_edges(self.links)
            domains = graph.pagerank(nodes, edges)
            rows = retrieval.index_documents(newest)
            ranked = rows.join(pages.select("url", F.col("score").alias("page_rank")), "url", "left").join(domains.select(F.col("url").alias("host"), F.col("score").alias("domain_rank")), "host", "left")
            self._index = cut(ranked.withColumn("page_rank", F.coalesce("page_rank", F.lit(0.0))).withColumn("domain_rank", F.coalesce("domain_rank", F.lit(0.0))))
        return self._index

    def document(self, url: str) -> DataFrame:
        return self.documents.where(F.col("url") == F.lit(url)).limit(1)

    def index_count(self) -> int:
        return self.index().count()

    def search(self, query: str, limit: int = 10, page: int = 1, window: int = 100) -> DataFrame:
        """Page 1 is reranked from a wider window; later pages come in the order of retrieval."""
        terms = query.lower().split()
        if page > 1:
            hits = retrieval.search(self.index(), query, limit, (page - 1) * limit)
        else:
            hits = retrieval.search(self.index(), query, max(limit, window))
        full = hits.join(self.index().select("url", "content", "page_rank", "domain_rank"), "url")
        from pyspark.sql.window import Window

        placed = full.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "url")))
        if page == 1:
            placed = ranking.rerank(placed, terms, limit=limit).drop("rank").withColumnRenamed("new_rank", "rank")
        return placed.select("rank", "url", "title", "score", snippets.snippets("content", terms)["text"].alias("snippet")).orderBy("rank")

    def search_many(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        return retrieval.search_many(self.index(), queries, limit)

    def evaluate(self, queries: DataFrame, judgments: DataFrame) -> DataFrame:
        from .operators.evaluation import query_metrics

        hits = self.search_many(queries).join(self.index().select("url", "title"), "url")
        return query_metrics(judge(hits, judgments))

    def upsert(self, batch: DataFrame) -> "Engine":
        """A new engine with the batch in; titles over 1,000 and contents over 1,000,000 characters are refused."""
        if batch.where((F.length("title") > 1000) | (F.length("content") > 1_000_000)).limit(1).count():
            raise ValueError("a title or content is too long")
        columns = ["url", "title", "content", "indexed_at"]
        return Engine(self.spark, tables.upsert(self.documents.select(columns), batch.select(columns), ["url"], ["indexed_at"]), self.links)

    def delete(self, urls: DataFrame) -> "Engine":
        return Engine(self.spark, tables.delete_by_key(self.documents, urls, "url"), self.links)
