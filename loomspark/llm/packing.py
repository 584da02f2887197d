"""Problem 8: filling containers of fixed capacity with documents, sizes in tokens.

Harmonic packing: lengths fall into reciprocal-capacity classes (class k holds the lengths
in (C/(k+1), C/k]) and each bin of class k takes k documents.  Filled with one class only,
a bin wastes up to 1/(k+1) of its space, so the classes are refined to single lengths and
a bin type is a fixed count of documents of several classes, planned from the histogram of
lengths (its size is bounded by the capacities, not by the data).  As in the plain method
each worker then places its documents independently: a document's rank within its class
gives its bin by arithmetic.

The histograms go to the driver, at most CAPACITIES lengths of them: beyond that, lengths are counted in steps, rounded
up, so that no container is overfull and nothing is left out, at the price of less than one step per document.

A document longer than a container is cut into full pieces and a rest; no other document
is split.  Null and empty texts have no tokens and lie in no container.  Limits that are
null or below 1 are left out.
"""

from __future__ import annotations

import base64
import uuid
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's public tokenizer splits text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths that the histograms of a group of limits have at most; larger capacities are counted in coarser steps.
CAPACITIES = 2_000_000
#: Limits that are planned together; more of them are packed group by group.
LIMITS = 1_000

_encoders: dict[str, object] = {}


def token_counts(df: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(key, tokens) of every row whose text has a token."""
    import os

    folder, name = os.path.split(path)
    with open(os.path.join(folder, name), "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    mark = uuid.uuid4().hex

    def run(batches):
        import tiktoken

        enc = _encoders.get(mark)
        if enc is None:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
            enc = _encoders[mark] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32())], names=[key, "tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, tokens int").where("tokens > 0")


def plan(capacity: int, histogram: dict[int, int]) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bin types as (how many bins, [(length, documents of it in each bin)]), by best fit of the largest lengths left.

    Each type uses up at least one length or all but a few of it, so there are at most about twice as many types as lengths."""
    left = {s: n for s, n in histogram.items() if n > 0}
    sizes = sorted(left)
    out = []
    while sizes:
        room, uses = capacity, []
        at = len(sizes)
        while at:
            at = bisect_right(sizes, room, 0, at)
            if not at:
                break
            s = sizes[at - 1]
            n = min(left[s], room // s)
            uses.append((s, n))
            room -= n * s
            at -= 1
        many = min(left[s] // n for s, n in uses)
        out.append((many, uses))
        for s, n in uses:
            left[s] -= many * n
            if not left[s]:
                del left[s]
                sizes.pop(bisect_right(sizes, s) - 1)
    return out


def pack(sizes: DataFrame, limits: list[tuple[str, int]], key: str = "doc_id", refined: bool = True) -> DataFrame:
    """(limit_name, container, key, piece, tokens).  sizes: key, tokens; limits: (name, capacity)."""
    spark = sizes.sparkSession
    limits = [(n, c) for n, c in limits if n is not None and c is not None and c >= 1]
    schema = f"limit_name string, container long, {key} {sizes.schema[key].dataType.simpleString()}, piece int, tokens int"
    if not limits:
        return spark.createDataFrame([], schema)
    if len(limits) > LIMITS:
        return pack(sizes, limits[:LIMITS], key, refined).unionByName(pack(sizes, limits[LIMITS:], key, refined))
    steps = {n: max(1, -(-c * len(limits) // CAPACITIES)) for n, c in limits}
    names = F.array(*[F.struct(F.lit(n).alias("limit_name"), F.lit(c).alias("capacity"), F.lit(steps[n]).alias("step")) for n, c in limits])
    pieces = (
        sizes.select(key, "tokens", F.explode(names).alias("l")).select(key, "tokens", "l.*")
        .select(key, "limit_name", "capacity", "step", "tokens", F.posexplode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / F.col("capacity")).cast("int"))).alias("piece", "_"))
        .select(key, "limit_name", "capacity", "step", "piece", F.least(F.col("capacity"), F.col("tokens") - F.col("piece") * F.col("capacity")).cast("int").alias("held"))
        .select(key, "limit_name", "piece", "held", F.least(F.ceil(F.col("held") / F.col("step")), F.floor(F.col("capacity") / F.col("step"))).cast("int").alias("size"))
    )
    histogram: dict[str, dict[int, int]] = {n: {} for n, _ in limits}
    for r in pieces.groupBy("limit_name", "size").count().collect():
        histogram[r.limit_name][r["size"]] = r["count"]
    rows, bin0 = [], 0
    for name, capacity in limits:
        bin0, taken = 0, {}
        capacity //= steps[name]
        types = plan(capacity, histogram[name]) if refined else None
        if refined:
            for many, uses in types:
                for s, n in uses:
                    lo = taken.get(s, 0)
                    taken[s] = lo + many * n
                    rows.append((name, s, lo, lo + many * n, n, bin0))
                bin0 += many
        else:
            for k in sorted({capacity // s for s in histogram[name]}):
                total = 0
                for s in sorted(s for s in histogram[name] if capacity // s == k):
                    # the lengths of a class stand one behind the other
                    rows.append((name, s, -total, 1 << 62, k, bin0))
                    total += histogram[name][s]
                bin0 += -(-total // k)
    table = spark.createDataFrame(rows, "limit_name string, size int, lo long, hi long, uses int, first long")
    # ranks within a length: counted in buckets, so that no length has to fit into one task
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    group = ["limit_name", "size", "bucket"]
    placed = pieces.withColumn("bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)).cast("int"))
    before = (
        placed.groupBy(*group).count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("limit_name", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select(*group, F.coalesce("before", F.lit(0)).alias("before"))
    )
    ranked = (
        placed.withColumn("row", F.row_number().over(Window.partitionBy(*group).orderBy(F.col(key), F.col("piece"))))
        .join(before, group).withColumn("rank", F.col("row") - 1 + F.col("before"))
    )
    hit = ranked.join(F.broadcast(table), ["limit_name", "size"]).where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return hit.select("limit_name", (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("uses"))).cast("long").alias("container"), key, F.col("piece").cast("int").alias("piece"), F.col("held").alias("tokens"))


def limits_of(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Names and capacities; of several capacities with one name the largest counts."""
    rows = spark.read.parquet(f"{folder}/pack_limits.parquet").where("limit_name is not null").groupBy("limit_name").agg(F.max("capacity_tokens").alias("c")).orderBy("limit_name").toLocalIterator()
    return [(r.limit_name, r.c) for r in rows]


def p8_pack(spark: SparkSession, folder: str, path: str = TOKENIZER) -> DataFrame:
    sizes = cut(token_counts(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text", path))
    return pack(sizes, limits_of(spark, folder))


def p8_use(spark: SparkSession, folder: str, path: str = TOKENIZER) -> DataFrame:
    """(limit_name, method, containers, tokens, unused) of the refined and the plain packing."""
    sizes = cut(token_counts(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text", path))
    limits = limits_of(spark, folder)
    capacity = spark.createDataFrame(limits, "limit_name string, capacity int")
    out = None
    for method, refined in (("refined", True), ("plain", False)):
        part = pack(sizes, limits, refined=refined).groupBy("limit_name", "container").agg(F.sum("tokens").alias("tokens")).groupBy("limit_name").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
        part = part.join(F.broadcast(capacity), "limit_name").select("limit_name", F.lit(method).alias("method"), "containers", "tokens", "fullest", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("unused"))
        out = part if out is None else out.unionByName(part)
    return out
