"""A stored inverted index: postings in buckets by the hash of their term, read for the terms of a query only.

Built once per index version: per-document counts of the terms of both fields, the lengths of the documents, and one row of
statistics.  A query lists the partitions of its few terms' buckets and pushes the terms down to the files, whose rows are sorted
by term; the texts are read for the hits only.  Phrases and exclusions need positions and stay with `retrieval.search`."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import retrieval as R


def bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class Postings:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        head = spark.read.parquet(f"{path}/stats").head()
        self.n, self.means, self.buckets = head.n, (head.t, head.c), head.buckets

    @classmethod
    def build(cls, index: DataFrame, path: str, buckets: int = 64) -> "Postings":
        """Rows that repeat a url count once.  A term's postings lie in one bucket, in as many files as there are tasks."""
        found = R.postings(index).groupBy("term", "url").agg(
            *(F.coalesce(F.max(F.when(F.col("field") == f, F.col(c))), F.lit(0)).cast("int").alias(n) for n, f, c in (("tf_t", "title", "tf"), ("tf_c", "content", "tf"))),
        )
        docs = R.lengths(index)
        found.withColumn("bucket", bucket("term", buckets)).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        docs.write.mode("overwrite").parquet(f"{path}/documents")
        kept = index.sparkSession.read.parquet(f"{path}/documents")
        kept.agg(F.count("*").alias("n"), F.coalesce(F.avg("len_t"), F.lit(0.0)).alias("t"), F.coalesce(F.avg("len_c"), F.lit(0.0)).alias("c")).withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        return cls(index.sparkSession, path)

    def read(self, terms: list[str]) -> DataFrame:
        """(term, url, tf_t, tf_c) of the terms: their partitions only."""
        which = sorted({r.b for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(bucket("t", self.buckets).alias("b")).collect()})
        return self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(*which) & F.col("term").isin(*terms)).drop("bucket")

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """(url, score) of the best documents for the words of a query, as `retrieval.search` scores them; ties by url."""
        words = list(dict.fromkeys(T.parse_query(query).text.lower().split()))
        if not words:
            return self.spark.createDataFrame([], "url string, score double")
        hits = self.read(words)
        df = hits.groupBy("term").agg(F.greatest(F.count_if(F.col("tf_t") > 0), F.count_if(F.col("tf_c") > 0)).alias("df"))
        idf = F.create_map(*[x for r in df.collect() for x in (F.lit(r.term), F.lit(math.log(1 + (self.n - r.df + 0.5) / (r.df + 0.5))))]) if words else None
        sizes = self.spark.read.parquet(f"{self.path}/documents")
        gain = lambda tf, size, mean: F.col(tf) * (R.K1 + 1) / (F.col(tf) + R.K1 * (1 - R.B + R.B * F.col(size) / F.lit(max(mean, 1e-9))))
        part = F.greatest(R.TITLE * gain("tf_t", "len_t", self.means[0]), gain("tf_c", "len_c", self.means[1])) * idf[F.col("term")]
        found = hits.join(sizes, "url").groupBy("url").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("_m"))
        return found.where(F.col("_m") >= T.minimum_should_match(len(words))).select("url", "score").orderBy(F.desc("score"), "url").limit(min(limit, R.CANDIDATES))
