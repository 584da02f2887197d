"""Generated documents for trials, the same at every call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = ["river", "garden", "archive", "lamp", "market", "bridge", "letter", "harbour", "window", "map"]


def documents(spark: SparkSession, n: int, words: int = 60) -> DataFrame:
    word = lambda i: F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(F.xxhash64("id", i), F.lit(len(WORDS))) + 1).cast("int"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), word), " ")
    return spark.range(n).select(F.concat(F.lit("https://site-"), (F.col("id") % 50).cast("string"), F.lit(".example/page/"), F.col("id").cast("string")).alias("url"), F.concat(F.lit("Page "), F.col("id").cast("string")).alias("title"), text.alias("content"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(secs=F.col("id"))).alias("indexed_at"))
