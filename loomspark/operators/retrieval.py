"""Full-text retrieval over the search index: BM25 (k1 1.2, b 0.75) on two fields, with operators.

A query touches the index once: its few terms are counted in each document by array
expressions inside code generation, and the statistics come from one aggregation.  Many
queries at once are a join of exploded terms with the query terms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import urls as U
from ..session import cut

K1, B, TITLE, CANDIDATES = 1.2, 0.75, 3.0, 200
#: Different terms of a table of queries.
VOCABULARY = 20_000


def index_documents(pages: DataFrame, *more: str) -> DataFrame:
    """Index row of each page: bounded content and analysed terms, and further columns; excluded pages are left out by the caller."""
    return pages.select(
        *more,
        F.when(F.octet_length("url") <= 512, F.col("url")).otherwise(F.sha2("url", 256)).alias("id"),
        "url", U.host("url").alias("host"), F.when(U.path("url") == "", "/").otherwise(U.path("url")).alias("path"),
        F.coalesce("title", F.lit("")).alias("title"), F.substring(F.coalesce("content", F.lit("")), 1, 20000).alias("content"),
        T.analyzed("title").alias("title_terms"), T.analyzed(F.substring("content", 1, 20000)).alias("content_terms"),
    )


def _prepared(index: DataFrame) -> DataFrame:
    return index.dropDuplicates(["url"]).withColumn("_t", T.terms(F.coalesce("title_terms", F.lit("")))).withColumn("_c", T.terms(F.coalesce("content_terms", F.lit(""))))


def _tf(array: Column, term: str) -> Column:
    return F.size(F.filter(array, lambda x: x == F.lit(term)))


def _gain(tf: Column, length: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(max(mean, 1e-9))))


def _score(words: list[str], at: dict[str, int], n: int, means: tuple[float, float], df: dict[str, int]) -> tuple[Column, Column]:
    """(score, how many of the words occur); a word has one document frequency, the larger of its fields'."""
    import math

    score, matched = F.lit(0.0), F.lit(0)
    for w in words:
        idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
        title, content = F.col(f"_t{at[w]}"), F.col(f"_c{at[w]}")
        part = F.greatest(TITLE * _gain(title, F.col("_lt"), means[0]), _gain(content, F.col("_lc"), means[1])) * idf
        score = score + F.when((title > 0) | (content > 0), part).otherwise(F.lit(0.0))
        matched = matched + ((title > 0) | (content > 0)).cast("int")
    return score, matched


def _has_phrase(array: Column, words: list[str]) -> Column:
    return F.instr(F.concat(F.lit(" "), F.array_join(array, " "), F.lit(" ")), " " + " ".join(words) + " ") > 0


def search(index: DataFrame, query: str | T.ParsedQuery, limit: int = 10, offset: int = 0, required_domains: tuple[str, ...] = (), hosts: tuple[str, ...] = (), paths: tuple[str, ...] = (), host_boost: float = 3.0, exact_path_boost: float = 5.0, path_prefix_boost: float = 4.0, homepage_boost: float = 6.0) -> DataFrame:
    """(url, title, score) of the best documents; ties by url.  Without terms or phrases nothing matches."""
    q = T.parse_query(query) if isinstance(query, str) else query
    words = list(dict.fromkeys(q.text.lower().split()))
    phrases = [p.lower().split() for p in q.exact_phrases]
    negative = [[x.lower()] for x in q.exclude_terms] + [p.lower().split() for p in q.exclude_phrases]
    columns = ["url", "title", F.round("score", 6).alias("score")]
    if not words and not phrases:
        return index.where("false").select("url", "title", F.lit(0.0).alias("score"))
    every = list(dict.fromkeys(words + [w for p in phrases for w in p]))
    at = {w: i for i, w in enumerate(every)}
    t, c = T.terms(F.coalesce("title_terms", F.lit(""))), T.terms(F.coalesce("content_terms", F.lit("")))
    split = index.select("url", "title", "host", "path", t.alias("_t"), c.alias("_c"))
    t, c = F.col("_t"), F.col("_c")
    both = lambda p: _has_phrase(t, p) | _has_phrase(c, p)
    # texts become counts before repeated rows are taken out, so that no text is moved
    docs = split.select(
        "url", "title", "host", "path", F.size("_t").alias("_lt"), F.size("_c").alias("_lc"), *[_tf(t, w).alias(f"_t{i}") for w, i in at.items()], *[_tf(c, w).alias(f"_c{i}") for w, i in at.items()],
        *[both(p).alias(f"_p{i}") for i, p in enumerate(phrases)], *[both(p).alias(f"_n{i}") for i, p in enumerate(negative)],
    ).dropDuplicates(["url"])
    stats = docs.agg(
        F.count("*").alias("n"), F.avg("_lt").alias("t"), F.avg("_lc").alias("c"),
        *[F.greatest(F.count_if(F.col(f"_t{i}") > 0), F.count_if(F.col(f"_c{i}") > 0)).alias(f"w{i}") for i in at.values()],
    ).head()
    df = {w: stats[f"w{i}"] for w, i in at.items()}
    means = (stats.t or 0.0, stats.c or 0.0)
    score, matched = _score(words, at, stats.n, means, df)
    found = docs.where(matched >= T.minimum_should_match(len(words))) if words else docs
    for i, p in enumerate(phrases):
        found = found.where(F.col(f"_p{i}"))
        score = score + _score(p, at, stats.n, means, df)[0]
    for i in range(len(negative)):
        found = found.where(~F.col(f"_n{i}"))
    if q.site_filter:
        found = found.where(U.wildcard("url", q.site_filter))
    if required_domains:
        found = found.where(domain_filter(required_domains))
    return found.withColumn("score", score + boosts(hosts, paths, host_boost, exact_path_boost, path_prefix_boost, homepage_boost)).select(*columns).orderBy(F.desc("score"), "url").offset(offset).limit(min(limit, CANDIDATES))


def domain_filter(domains: tuple[str, ...]) -> Column:
    """Host is a domain or its www form, or the URL starts with one of them."""
    names = [x for d in domains for x in (d, f"www.{d}")]
    starts = [F.col("url").startswith(f"{s}://{x}/") for x in names for s in ("https", "http")]
    return reduce(lambda a, b: a | b, starts, F.col("host").isin(*names))


def boosts(hosts=(), paths=(), host_boost=3.0, exact=5.0, prefix=4.0, homepage=6.0) -> Column:
    total = F.lit(0.0)
    for d in hosts:
        total = total + F.when(F.col("host").isin(d, f"www.{d}"), host_boost).otherwise(0.0)
    for p in paths:
        total = total + F.when(F.col("path") == p, homepage if p == "/" else exact).otherwise(0.0)
        if p != "/":
            total = total + F.when(F.col("path").startswith(p), prefix).otherwise(0.0)
    return total


def postings(index: DataFrame) -> DataFrame:
    """(term, url, field, tf) of all documents.

    No text is moved: each row's tokens are counted where the row is, and rows that repeat a url and its texts, which have one
    fingerprint, are told from repeated tokens by their number.  Of versions of a url with other texts the larger count holds."""
    t, c = T.terms(F.coalesce("title_terms", F.lit(""))), T.terms(F.coalesce("content_terms", F.lit("")))
    rows = index.select("url", F.xxhash64("title_terms", "content_terms").alias("_v"), t.alias("_t"), c.alias("_c"))
    copies = index.groupBy("url", F.xxhash64("title_terms", "content_terms").alias("_v")).agg(F.count("*").alias("_n"))
    token = lambda f: lambda x: F.struct(F.lit(f).alias("field"), x.alias("term"))
    each = rows.select("url", "_v", F.explode(F.concat(F.transform("_t", token("title")), F.transform("_c", token("content")))).alias("x")).groupBy("url", "_v", "x.field", "x.term").agg(F.count("*").alias("tf"))
    once = each.join(copies, ["url", "_v"]).withColumn("tf", F.expr("tf div _n"))
    return once.groupBy("term", "url", "field").agg(F.max("tf").alias("tf"))


def lengths(index: DataFrame) -> DataFrame:
    """(url, len_t, len_c): terms of each document's fields, one row per url."""
    t, c = T.terms(F.coalesce("title_terms", F.lit(""))), T.terms(F.coalesce("content_terms", F.lit("")))
    return index.select("url", F.size(t).alias("len_t"), F.size(c).alias("len_c")).groupBy("url").agg(F.max("len_t").alias("len_t"), F.max("len_c").alias("len_c"))


def term_statistics(index: DataFrame) -> DataFrame:
    """(field, term, documents, occurrences)."""
    return postings(index).groupBy("field", "term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


def search_many(index: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, url, score, rank) for a table of queries (query_id, query) against all documents.

    Hot words of the corpus that no query holds cost nothing: a document yields only the queries' terms."""
    docs = _prepared(index).select("url", "_t", "_c")
    wanted = queries.select("query_id", F.explode(F.array_distinct(T.terms("query"))).alias("term")).distinct().withColumn("needed", F.count("*").over(Window.partitionBy("query_id")))
    terms = wanted.select("term").distinct()
    if terms.limit(VOCABULARY + 1).count() > VOCABULARY:
        raise ValueError(f"the queries hold more than {VOCABULARY} different terms; search for them in parts")
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size("_t")).alias("mean_t"), F.avg(F.size("_c")).alias("mean_c"))
    # one narrow row per token; those that no query holds go before the counts, which are complete within a task
    token = lambda t, c: lambda x: F.struct(x.alias("term"), F.lit(t).alias("t"), F.lit(c).alias("c"))
    tokens = docs.select("url", F.size("_t").alias("len_t"), F.size("_c").alias("len_c"), F.explode(F.concat(F.transform("_t", token(1, 0)), F.transform("_c", token(0, 1)))).alias("x")).select("url", "len_t", "len_c", "x.*")
    hits = cut(tokens.join(F.broadcast(terms), "term", "left_semi").groupBy("term", "url", "len_t", "len_c").agg(F.sum("t").alias("tf_t"), F.sum("c").alias("tf_c")))
    df = hits.groupBy("term").agg(F.greatest(F.count_if(F.col("tf_t") > 0), F.count_if(F.col("tf_c") > 0)).alias("df"))
    gain = lambda tf, size, mean: F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(size) / F.greatest(F.col(mean), F.lit(1e-9))))
    scored = (
        hits.join(df, "term").crossJoin(F.broadcast(stats))
        .select("term", "url", (F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.greatest(TITLE * gain("tf_t", "len_t", "mean_t"), gain("tf_c", "len_c", "mean_c"))).alias("part"))
    )
    required = F.when(F.col("needed") <= 2, F.col("needed")).when(F.col("needed") <= 5, F.floor(F.col("needed") * 60 / 100)).otherwise(F.floor(F.col("needed") * 50 / 100))
    totals = scored.join(wanted, "term").groupBy("query_id", "url").agg(F.round(F.sum("part"), 6).alias("score"), F.count("*").alias("matched"), F.first("needed").alias("needed")).where(F.col("matched") >= required)
    ranked = totals.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "url")))
    return ranked.where(F.col("rank") <= limit).select("query_id", "url", "score", "rank")
