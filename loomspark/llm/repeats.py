"""Problem 6: lines that stand in very many pages of one host.

The pages of a host are numbered densely: their hashed lines are partitioned by ranges of (host, url) and numbered in
that order, so that a host's pages lie side by side.  Every line of a host keeps the pages it
stands in as a compressed bitmap, split into containers of 2^15 pages; a container is
a sorted array while it is sparse and a bitmap of 4 KB beyond ARRAY pages.  The spellings of one
line share its key, so that their bitmaps are united as they are made: first those of one task, which holds
whole stretches of a host, then all.  Exact cardinalities are summed over the containers, and the bitmaps of the lines
at or over both thresholds tell which lines of which pages go.

A host may hold a third of all pages: groups are keyed by line and container, so that
none exceeds 2^15 pages, sizes of hosts are joined by salted keys, and lines are looked up by page, not by line.
Pages count once per url.  Null hosts, urls or contents give no rows; an empty line is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

CONTAINER, ARRAY = 15, 2048
#: Parts that the lines of a host are split into when they are joined with its size.
SALTS = 16


def normal(line: Column) -> Column:
    """Trimmed, white space collapsed, case ignored, digits replaced by one mark."""
    flat = F.regexp_replace(F.lower(line), r"[\s\x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " ")
    return F.regexp_replace(F.trim(flat), r"\p{Nd}+", "0")


def _lines(host: Column, content: Column) -> Column:
    """Of a text's lines that aren't empty: their numbers, and 96 bits of hash of host and line in two arrays."""
    norm = F.transform(F.split(content, "\n"), lambda x, i: F.struct((i + 1).alias("no"), normal(x).alias("norm")))
    kept = F.filter(norm, lambda x: F.length(x["norm"]) > 0)
    each = F.transform(kept, lambda x: F.struct(x["no"].alias("no"), F.xxhash64(host, x["norm"]).alias("key"), F.hash(host, x["norm"], F.lit(7)).alias("check")))
    return each


def positions(bitmap: str) -> Column:
    """The numbers of the bits that are set in a bitmap of one container."""
    bit = f"shiftright(conv(hex(substring({bitmap}, cast(i div 8 as int) + 1, 1)), 16, 10), cast(i % 8 as int)) & 1 = 1"
    return F.expr(f"filter(sequence(0, {(1 << CONTAINER) - 1}), i -> {bit})")


def numbered_pages(pages: DataFrame) -> DataFrame:
    """(page, source, host, url, nos, keys, checks) of every page with its lines; dense numbers within a host but for the ends of partitions."""
    hashed = (
        pages.where("host is not null and url is not null")
        .select("host", "url", _lines(F.col("host"), F.col("content")).alias("l"))
        .select("host", "url", F.struct(F.col("l.no").alias("nos"), F.col("l.key").alias("keys"), F.col("l.check").alias("checks")).alias("l"))
    )
    # versions of one url are united; sorting makes the numbers the same at every attempt
    whole = cut(hashed).repartitionByRange("host", "url").groupBy("host", "url").agg(F.collect_set("l").alias("l"))
    united = lambda c, kind: F.flatten(F.transform("l", lambda x: F.coalesce(x[c], F.array().cast(f"array<{kind}>")))).alias(c)
    flat = whole.select("host", "url", united("nos", "int"), united("keys", "long"), united("checks", "int"))
    return cut(flat.sortWithinPartitions("host", "url").withColumn("page", F.monotonically_increasing_id()).withColumn("source", F.xxhash64("host")))


def bitmaps(numbered: DataFrame) -> DataFrame:
    """(key, check, part, source, n, sparse, dense) of each line of a host and container: the bitmap of its pages and its exact cardinality."""
    where = ["key", "check", "part"]
    each = numbered.select("page", "source", F.explode(F.arrays_zip("keys", "checks")).alias("l")).select(
        F.col("l.keys").alias("key"), F.col("l.checks").alias("check"), F.shiftright("page", CONTAINER).alias("part"), "source", F.col("page").bitwiseAND((1 << CONTAINER) - 1).cast("int").alias("at")
    )
    united = each.groupBy(*where).agg(F.first("source").alias("source"), F.collect_set("at").alias("at")).withColumn("n", F.size("at").cast("long"))
    sparse = united.where(F.col("n") <= ARRAY).select(*where, "source", "n", F.sort_array("at").alias("sparse"), F.lit(None).cast("binary").alias("dense"))
    dense = (
        united.where(F.col("n") > ARRAY).select(*where, "source", "n", F.explode("at").alias("at"))
        .groupBy(*where).agg(F.first("source").alias("source"), F.first("n").alias("n"), F.bitmap_construct_agg("at").alias("dense"))
        .select(*where, "source", "n", F.lit(None).cast("array<int>").alias("sparse"), "dense")
    )
    return sparse.unionByName(dense)


def repeated(pages: DataFrame, least: int = 3, share: float = 0.05) -> DataFrame:
    """(host, url, line_no, pages) of the lines whose like stands in `least` urls and in a `share` of the urls of their host.

    pages: host, url, content.  `pages` of the result is the exact number of urls."""
    numbered = numbered_pages(pages)
    parts = bitmaps(numbered)
    whole = Window.partitionBy("key", "check")  # a line has as many rows as containers
    counted = parts.withColumn("pages", F.sum("n").over(whole)).where(F.col("pages") >= least).withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int"))
    sizes = numbered.groupBy("source").agg(F.count("*").alias("urls")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    many = counted.join(sizes.hint("merge"), ["source", "salt"]).where(F.col("pages") >= F.lit(share) * F.col("urls"))
    hits = many.select("key", "check", "pages", "part", F.explode(F.when(F.col("dense").isNull(), F.col("sparse")).otherwise(positions("dense"))).alias("at"))
    by_page = hits.groupBy((F.shiftleft("part", CONTAINER) + F.col("at")).alias("page")).agg(F.collect_list(F.struct("key", "check", "pages")).alias("hits"))
    found = numbered.select("page", "host", "url", "nos", "keys", "checks").join(by_page, "page")
    # a page has as many hits as different repeated lines
    lines = F.transform(F.arrays_zip("nos", "keys", "checks"), lambda x: F.struct(x["nos"].alias("line_no"), F.get(F.filter("hits", lambda h: (h["key"] == x["keys"]) & (h["check"] == x["checks"])), 0)["pages"].alias("pages")))
    return found.select("host", "url", F.explode(F.array_distinct(F.filter(lines, lambda x: x["pages"].isNotNull()))).alias("l")).select("host", "url", "l.line_no", "l.pages")


def cleaned(pages: DataFrame, least: int = 3, share: float = 0.05) -> DataFrame:
    """Each distinct (host, url, content) with `clean`: the content without its repeated lines."""
    drop = repeated(pages, least, share).groupBy("host", "url").agg(F.collect_set("line_no").alias("drop"))
    kept = F.filter(F.split("content", "\n"), lambda x, i: ~F.array_contains(F.coalesce("drop", F.array().cast("array<int>")), i + 1))
    return pages.select("host", "url", "content").distinct().join(drop, ["host", "url"], "left").select("host", "url", "content", F.array_join(kept, "\n").alias("clean"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated(spark.read.parquet(f"{folder}/search_index.parquet")).select("url", "line_no").distinct()
