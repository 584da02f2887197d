"""The link graph: edges, degrees, referring hosts and PageRank of pages and domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import cut, cut_bucketed
from .tables import max_normalized


def edges(links: DataFrame) -> DataFrame:
    """Distinct normalised edges without self links; targets that can't be normalised are left out."""
    pages = U.with_links(links.select("src").distinct(), "src", "src", "page")
    clean = U.with_links(links.select("src", "dst").distinct(), "src", "dst", "target").join(pages, "src").select(F.col("page").alias("src"), F.col("target").alias("dst"))
    return clean.where("src is not null and dst is not null and src <> dst").distinct()


def page_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges between nodes (column url)."""
    plain = links.where("src <> dst").select("src", "dst").distinct()
    return plain.join(nodes.select(F.col("url").alias("src")), "src", "left_semi").join(nodes.select(F.col("url").alias("dst")), "dst", "left_semi").select("src", "dst")


def domain_edges(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, distinct edges between different hosts); links within a host only add their node."""
    pairs = links.select(U.host("src").alias("src"), U.host("dst").alias("dst")).where("src <> '' and dst <> ''").distinct()
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("url")).distinct()
    return nodes, pairs.where("src <> dst")


def degrees(edge: DataFrame) -> DataFrame:
    return (
        edge.select(F.explode(F.array(F.struct(F.col("src").alias("url"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("url"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
        .groupBy("x.url").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))
    )


def referring_hosts(edge: DataFrame) -> DataFrame:
    return edge.select(F.col("dst").alias("dst_url"), U.host("src").alias("referring_host")).where("referring_host <> ''").distinct()


def referring_counts(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """Referring hosts of each key, 0 where there are none."""
    n = pairs.groupBy("dst_url").agg(F.count("*").alias("n"))
    return keys.join(n, keys["url"] == n["dst_url"], "left").select("url", F.coalesce("n", F.lit(0)).alias("referring_hosts"))


def pagerank(nodes: DataFrame, edge: DataFrame, iterations: int = 20, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(url, score), divided by the maximum; the mass of dangling nodes is spread over all nodes.

    Nodes get numbers, so that iterations move 16 bytes a row.  Edges are written once in buckets of their source, scores in the same
    buckets, so that an iteration shuffles the gains only, summed up before; its mass and change are observed while it is written."""
    ids = cut(nodes.select("url").distinct().withColumn("id", F.monotonically_increasing_id()))
    n = ids.count()
    if not n:
        return ids.select("url", F.lit(0.0).alias("score"))
    out = edge.groupBy("src").agg(F.count("*").alias("d"))
    buckets = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    graph = cut_bucketed(
        edge.join(out, "src").join(ids.select(F.col("url").alias("src"), F.col("id").alias("s")), "src").join(ids.select(F.col("url").alias("dst"), F.col("id").alias("t")), "dst").select("s", "t", (1.0 / F.col("d")).alias("w")),
        "s", buckets,
    )
    sources = graph.select(F.col("s").alias("id")).distinct().withColumn("linked", F.lit(True))
    scores = cut_bucketed(ids.select("id").join(sources, "id", "left").select("id", F.coalesce("linked", F.lit(False)).alias("linked"), F.lit(1.0 / n).alias("score")), "id", buckets)
    lost = scores.agg(F.sum(F.when(~F.col("linked"), F.col("score")))).head()[0] or 0.0
    for _ in range(iterations):
        moved = graph.join(scores.select(F.col("id").alias("s"), "score"), "s").groupBy(F.col("t").alias("id")).agg(F.sum(F.col("score") * F.col("w")).alias("gain"))
        seen = Observation()
        new = scores.join(moved, "id", "left").select("id", "linked", F.col("score").alias("old"), (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("gain", F.lit(0.0))).alias("score"))
        scores = cut_bucketed(new.observe(seen, F.sum(F.abs(F.col("score") - F.col("old"))).alias("change"), F.sum(F.when(~F.col("linked"), F.col("score"))).alias("lost")).drop("old"), "id", buckets)
        lost, change = seen.get["lost"] or 0.0, seen.get["change"] or 0.0
        if change < tolerance:
            break
    return max_normalized(ids.join(scores, "id").select("url", "score"), "score")


def refill_candidates(links: DataFrame, documents: DataFrame, queue: DataFrame) -> DataFrame:
    """For each host one target that is neither indexed nor queued; plain http(s) addresses only.

    The pick is the smallest hash, so it is random but the same each time; min_by needs no window."""
    shaped = links.select("dst").where(F.col("dst").rlike("(?i)^https?://") & ~F.col("dst").rlike(r"[?#*]")).distinct()
    fresh = shaped.join(documents.select(F.col("url").alias("dst")), "dst", "left_anti").join(queue.select(F.col("url").alias("dst")), "dst", "left_anti")
    return fresh.groupBy(U.host("dst").alias("host")).agg(F.min_by("dst", F.concat(F.sha2("dst", 256), F.col("dst"))).alias("url")).where("host <> ''").select("host", "url")
