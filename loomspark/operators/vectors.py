"""Dense vectors: pending rows, cosine similarity and its best matches for stated queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Queries of a block.
BLOCK = 2_000


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def vector_text(v) -> Column:
    """[x,y,…] with eight significant digits; the JVM has no format that drops trailing zeros."""
    @F.pandas_udf("string")
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda x: None if x is None else "[" + ",".join(f"{y:.8g}" for y in x) + "]")

    return run(v)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest of each stated query among all vectors.

    The queries are a stated set.  They go to the tasks in blocks of about BLOCK, whose size is bounded by it; a task keeps its k
    best per query over all its batches, so no pairs are moved and k rows per query and task are shuffled."""
    stated = queries.select("vec_id", "embedding").where("embedding is not null")
    blocks = max(1, -(-stated.count() // BLOCK))
    found = None
    for b in range(blocks):
        part = _block(vectors, stated.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b), k)
        found = part if found is None else found.unionByName(part)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))).where(F.col("rank") <= k)


def _block(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    rows = queries.collect()
    ids = [r.vec_id for r in rows]
    q = np.array([r.embedding for r in rows], dtype=np.float64).reshape(len(rows), -1)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12) if len(q) else q

    def best(parts):
        kept: list[pd.DataFrame] = []
        for p in parts:
            p = p[p.embedding.notna()]
            if not len(p) or not len(ids):
                continue
            v = np.stack(p.embedding.to_numpy()).astype(np.float64)
            s = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)) @ q.T
            vec = p.vec_id.to_numpy()
            for j, i in enumerate(ids):
                score = np.where(vec == i, -np.inf, s[:, j])
                top = np.lexsort((vec, -np.round(score, 6)))[:k]
                kept.append(pd.DataFrame({"query_id": i, "vec_id": vec[top], "similarity": np.round(score[top], 6)}))
            both = pd.concat(kept).sort_values(["query_id", "similarity", "vec_id"], ascending=[True, False, True])
            kept = [both.groupby("query_id").head(k)]
        yield from kept

    return vectors.select("vec_id", "embedding").mapInPandas(best, "query_id long, vec_id long, similarity double").where("similarity > -2")
